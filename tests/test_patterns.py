"""The pattern language, against Python's engine where the two agree and against stated answers elsewhere."""

import random
import re

import pytest
from pyspark.sql import functions as F
from strandmill.functions.patterns import PatternError, byte_sequences, java_pattern

CASES = [
    ("[[:alpha:]]", "ACGT", True), ("^[[:upper:]]+$", "ACGT", True), ("A++A", "AAA", True), ("A(?i)c", "AC", True), ("A(?i)c", "aC", False), (r"\(?=", "=", True),
    ("^TC", "ATC", False), ("a|b|", "", True), ("^.$", "é", True), ("^.{2}$", "é", False), (r"^\w+$", "aé_1", True), (r"(?-u)^\w+$", "é", False), ("(?i)k", "K", True),
    ("[a-c&&b-d]", "a", False), ("[a-c&&b-d]", "b", True), ("[a-c--b]", "b", False), ("[a-c~~b-d]", "b", False), ("[a-c~~b-d]", "d", True), ("[]a]", "]", True), ("[a-]", "-", True),
    ("(?x) A  C # x\n G", "ACG", True), ("(?m)^C$", "A\nC\nG", True), ("^C$", "A\nC", False), ("A$", "A\n", False), (r"\u{e9}", "é", True), ("[[:^alpha:]]", "A", False),
    (r"\bAC\b", "T AC G", True), (r"\bAC\b", "TAC", False), (".", "\n", False), ("(?s).", "\n", True), ("(?R).", "\r", False), ("(?mR)A$", "A\r\nC", True), ("(?P<x>A)(?<y>C)", "AC", True),
    ("(?i:a)b", "AB", False), (r"\p{Lu}", "a", False), (r"\pL", "a", True), (r"\P{Lu}", "a", True), ("^(?:a{2}){3}$", "aaaaa", False), ("a{2}{3}$", "aaaaaa", True), (r"^[^\n]*X$", "é" * 5 + "X", True),
    (r"\x41\t\.\-", "A\t.-", True), ("[^\\x00-\\x{10FFFF}]", "a", False), ("", "", True), ("()+", "", True), (r"[\d\s]", "٣", True), (r"\<AC\>", "AC", True), (r"\Aa\z", "a", True),
]
BAD = ["(", "a)", "[a", "*", "a{", "a{,3}", "(?=a)", "(?!a)", "(?<!a)", "(?<=a)", r"(a)\1", r"\k<a>", "(?z)", r"\q", "[z-a]", r"\p{Foo}", "(?", "a{3,2}", "(?-)", r"[a-\d]", r"\x{110000}", r"\ud800", "(?i)*", "\\", "[[:foo:]", "a{1"]


def in_python(pattern):
    """The Java pattern uses nothing else that Python's engine has under another name."""
    return java_pattern(pattern).replace(r"\z", r"\Z")


@pytest.mark.parametrize("pattern, text, found", CASES)
def test_answers(pattern, text, found):
    assert (re.search(in_python(pattern), text.encode().decode("latin-1")) is not None) == found


@pytest.mark.parametrize("pattern", BAD)
def test_malformed(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_on_the_engine(spark):
    rows = [(i, text.encode().decode("latin-1")) for i, (_, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string")
    met = F.lit(False)
    for i, (pattern, _, _) in enumerate(CASES):
        met = F.when(F.col("i") == i, F.col("t").rlike(java_pattern(pattern))).otherwise(met)
    assert [r.met for r in df.select("i", met.alias("met")).orderBy("i").collect()] == [found for _, _, found in CASES]
    long = spark.createDataFrame([("AC" * 200_000,)], "t string")
    assert long.where(F.col("t").rlike(java_pattern("^(A|C)*$")) & F.col("t").rlike(java_pattern("^[^T]*$")) & ~F.col("t").rlike(java_pattern("^.*G"))).count() == 1


def random_pattern(rng, depth=0):
    kinds = ["char", "char", "class", "dot", "seq", "alt", "rep"] if depth < 4 else ["char", "class"]
    kind = rng.choice(kinds)
    inner = lambda: random_pattern(rng, depth + 1)
    if kind == "char":
        return rng.choice("abé𝒳")
    if kind == "class":
        return rng.choice(["[ab]", "[^a]", "[a-zé]", "[^é]", r"\d", r"[^\n𝒳]"])
    if kind == "dot":
        return "."
    if kind == "seq":
        return inner() + inner()
    if kind == "alt":
        return f"(?:{inner()}|{inner()})"
    return f"(?:{inner()}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '{2,}'])}"


def test_random_patterns_find_what_pythons_find():
    rng = random.Random(4)
    for _ in range(1500):
        pattern = "^" + random_pattern(rng) + rng.choice(["", "$"])
        text = "".join(rng.choice("abé𝒳z1") for _ in range(rng.randrange(7)))
        want = re.search(pattern.removesuffix("$") + (r"\Z" if pattern.endswith("$") else ""), text) is not None
        assert (re.search(in_python(pattern), text.encode().decode("latin-1")) is not None) == want, (pattern, text)


def test_byte_sequences_are_exact():
    rng = random.Random(2)
    points = [0, 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]
    for _ in range(40):
        low, high = sorted(rng.choice(points + [rng.randrange(0xD800)]) for _ in range(2))
        if low <= 0xD7FF and high >= 0xE000:
            continue
        sequences = byte_sequences(low, high)
        inside = lambda c: any(len(s) == len(chr(c).encode()) and all(a <= b <= z for (a, z), b in zip(s, chr(c).encode())) for s in sequences)
        assert all(inside(c) for c in {low, high, (low + high) // 2})
        assert not any(inside(c) for c in (low - 1, high + 1) if 0 <= c <= 0x10FFFF and not 0xD800 <= c < 0xE000)
