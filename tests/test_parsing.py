"""Lint-log lines: the reason for each failure, against a slow reading of the rules."""

import csv
import io
import random

import pytest
from strandmill.operators import parsing as P

GOOD = "runs/a.fq,1,2,3,4,S001,PlusLine,7,text"


def slow(text):
    """The rules of a good line, character by character."""
    text = text[:-1] if text.endswith("\r") else text
    fields, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            value, at = "", at + 1
            while True:
                if at >= len(text):
                    return "quoting"
                if text[at] == '"':
                    if text[at + 1 : at + 2] == '"':
                        value, at = value + '"', at + 2
                        continue
                    at += 1
                    break
                value, at = value + text[at], at + 1
            if at < len(text) and text[at] != ",":
                return "quoting"
        else:
            stop = text.find(",", at)
            stop = len(text) if stop < 0 else stop
            value, at = text[at:stop], stop
            if '"' in value:
                return "quoting"
        fields.append(value)
        if at >= len(text):
            break
        at += 1
    if len(fields) != 9:
        return "columns"
    number = lambda x: int(x[-25:]) if x and all(c in "0123456789" for c in x) and not x[:-25].strip("0") and int(x[-25:]) < 2**63 else -1
    n = [number(x) for x in fields[1:5]]
    ok = fields[0] and min(n) >= 0 and 0 < n[1] < n[2] < n[3] and (not fields[7] or number(fields[7]) > 0)
    kinds = (fields[5] in P.CODES and fields[6] in P.LINE_TYPES) or fields[5] == fields[6] == ""
    return None if ok and kinds else "value"


@pytest.mark.parametrize(
    "text, reason",
    [
        (GOOD, None), (GOOD + "\r", None), ("", "columns"), ("\r", "columns"), (GOOD.replace("S001,PlusLine", ","), None), (GOOD.replace("S001", ""), "value"),
        (GOOD.replace("text", '"a ""b"", c\nd\r"'), None), (GOOD.replace("text", 'a"b'), "quoting"), (GOOD.replace("text", '"a"b'), "quoting"), (GOOD.replace("text", '"a'), "quoting"),
        (GOOD.replace("text", ' "a"'), "quoting"), (GOOD + ",x", "columns"), (GOOD.replace(",text", ""), "columns"), (GOOD.replace(",1,", ",-1,"), "value"), (GOOD.replace(",1,", ",١,"), "value"),
        (GOOD.replace(",1,", ",9223372036854775807,"), None), (GOOD.replace(",1,", ",9223372036854775808,"), "value"), (GOOD.replace(",1,", "," + "0" * 5000 + "1,"), None), (GOOD.replace("2,3", "3,3"), "value"),
        (GOOD.replace(",7,", ",,"), None), (GOOD.replace(",7,", ",0,"), "value"), (GOOD.replace("runs/a.fq", '""'), "value"), (GOOD.replace("runs/a.fq", '"a,b"'), None), (GOOD.replace("7", '"7"'), None),
        ("a,b\"c", "quoting"), (GOOD.replace("text", "a\rb"), None), (GOOD.replace("text", 'a\rb,"c'), "quoting"), ('"', "quoting"), ('""', "columns"), (GOOD.replace("text", "x" * 300_000), None), (GOOD.replace("text", '"' + "x" * 300_000 + '"'), None),
    ],
)
def test_reasons(text, reason):
    csv.field_size_limit(2**31)
    assert P.parse_line(text)[-1] == reason == slow(text)


def test_against_the_slow_reading():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(['"', '""', ",", "1", "a", "\r", "\n", ',"', '",']) for _ in range(rng.randrange(12)))
        assert P.parse_line(text)[-1] == slow(text), text
        changed = list(GOOD)
        for _ in range(rng.randrange(4)):
            changed[rng.randrange(len(changed))] = rng.choice(['"', ",", "0", "\r", "S", ""])
        assert P.parse_line("".join(changed))[-1] == slow("".join(changed)), changed


def test_values_come_back():
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(["s,\n", 0, 1, 2, 3, "P001", "Name", "", 'say "x"'])
    assert P.parse_line(out.getvalue()) == ("s,\n", 0, 1, 2, 3, "P001", "Name", None, 'say "x"', None)


def test_tables(spark):
    df = spark.createDataFrame([(1, GOOD, None), (2, None, "x"), (2, GOOD + '"', "x"), (None, GOOD, "y")], "id long, line_text string, text string")
    good, bad = P.split_loaded(P.parse_lines(df, keep=["id", "text"]))
    assert sorted(((r.id, r.source, r.plus_line_end) for r in good.collect()), key=str) == [(1, "runs/a.fq", 4), (None, "runs/a.fq", 4)]
    assert sorted((r.id, r.text, r.reason) for r in bad.collect()) == [(2, "x", "columns"), (2, "x", "quoting")]
    assert P.parse_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.parse_lines(df.withColumnRenamed("text", "message"), keep=["message"])


def test_assembly():
    lines = 'a,"b\nc",d\n\nx,"y""\nz"\n"open'.split("\n")
    assert list(P.assemble(iter(lines))) == ['a,"b\nc",d', "", 'x,"y""\nz"', '"open']
    good = [GOOD, GOOD.replace("text", '"a\nb"'), GOOD.replace("text", '"c"')]
    for broken in (GOOD.replace("text", '"open'), GOOD.replace("text", 'a"b'), 'x,"y" z', '"', ',"a""'):
        texts = [good[0], broken, *good, broken, good[1], broken]
        assert list(P.assemble(iter("\n".join(texts).split("\n")))) == texts
    assert list(P.assemble(iter(["a", '"b', "c", "d", 'e"', "f"]), 3)) == ["a", '"b', "c", "d", 'e"', "f"]
    assert list(P.assemble(iter(["a", '"b', "c", "d", 'e"', "f"]), 4)) == ["a", '"b\nc\nd\ne"', "f"]


def test_every_record_meets_the_strict_reader(monkeypatch):
    read = []
    strict = csv.reader
    monkeypatch.setattr(P.csv, "reader", lambda rows, **how: read.append(how) or strict(rows, **how))
    for text in (GOOD, GOOD + "\r", "", "a,,b", "a\rb\nc,d", GOOD.replace("text", '"a"')):
        assert P.split_fields(text) == [f.strip('"') for f in text.split(",")]
    assert read == [{"strict": True}] * 6


def test_logs_are_read_by_record(spark, tmp_path):
    from strandmill.sources.text import read_log

    texts = [GOOD, GOOD.replace("text", '"a\nb ""c"""') + "\r", "", GOOD.replace("text", '"é\n\n,"'), GOOD + ",x", GOOD.replace("text", '"open\nto the end')]
    (tmp_path / "1.log").write_bytes("\n".join(texts).encode())
    (tmp_path / "2.log").write_bytes((GOOD + "\n").encode())
    (tmp_path / "3.log").write_bytes(b"")
    logs = read_log(spark, [str(tmp_path / f"{i}.log") for i in (1, 2, 3)])
    found = [*texts[:-1], *texts[-1].split("\n")]  # a quote that never closes breaks its own line alone
    assert sorted((r.path[-5:], r.line_no, r.line_text) for r in logs.collect()) == [*[("1.log", i, t) for i, t in enumerate(found)], ("2.log", 0, GOOD)]
    good, bad = P.split_loaded(P.parse_lines(logs, keep=["path", "line_no"]))
    assert sorted((r.line_no, r.message) for r in good.where("path like '%1.log'").collect()) == [(0, "text"), (1, 'a\nb "c"'), (3, "é\n\n,")]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(2, "columns"), (4, "columns"), (5, "quoting"), (6, "columns")]
