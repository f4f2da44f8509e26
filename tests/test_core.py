"""Rules, filters, samples and metrics on small tables."""

import math

import pytest
from pyspark.sql import functions as F
from strandmill.functions import names as N
from strandmill.functions.bytestrings import display, from_bytes
from strandmill.functions.quality import phred_score
from strandmill.operators import filters, lint, metrics, pairs, sampling
from strandmill.operators import validators as V
from strandmill.schema import records

GOOD = ("@r1/1", "ACGT", "+", "FFFF")


def codes(df):
    return [r.validator_code for r in df.orderBy(*lint.ORDER).collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "d string").select(column(F.col("d"))).first()[0]


@pytest.mark.parametrize(
    "definition, separator, name",
    [("@lane:1/1", None, "@lane:1"), ("@lane:1 1", None, "@lane:1"), ("@lane:1/1 2", None, "@lane:1"), ("@lane:1 1/2", None, "@lane:1"), ("@lane_1", "_", "@lane"), ("@lane", None, "@lane"), ("/1", None, ""), ("", None, ""), ("@a/b", "_", "@a/b")],
)
def test_lint_name_ends_at_the_first_separator(spark, definition, separator, name):
    assert one(spark, definition, lambda c: N.first_part(c, separator)) == name


@pytest.mark.parametrize("definition, name", [("@lane:1/1", "lane:1"), ("@lane:1 1", "lane:1"), ("@lane:1", "lane:1"), ("@a/b/c", "a/b"), ("@a b/c", "a b"), ("xyz", "yz")])
def test_allowlist_name_ends_at_the_last_separator(spark, definition, name):
    assert one(spark, definition, N.check_allowlist_name) == name


@pytest.mark.parametrize("definition", ["", "/1", " x"])
def test_allowlist_name_of_nothing_is_an_error(spark, definition):
    with pytest.raises(Exception, match="invalid definition"):
        one(spark, definition, N.check_allowlist_name)


def test_separator_argument():
    assert N.parse_separator("_x") == "_" and N.parse_separator("é") == "é"
    for bad in ("", "Ā"):
        with pytest.raises(ValueError):
            N.parse_separator(bad)


@pytest.mark.parametrize(
    "record, found",
    [
        (GOOD, []),
        (("@r", "acgtnACGTN", "+", "!~FFFFFFFF"), []),
        (("+r", "ACGT", "+", "FFFF"), ["S003"]),
        (("/1", "ACGT", "+", "FFFF"), ["S003", "S004"]),
        (("@r", "", "+", "F"), ["S004", "S005"]),
        (("@r", "ACGT", "", "FFFF"), ["S004", "S001"]),
        (("@r", "ACGT", "+", ""), ["S004", "S005"]),
        (("@r", "ACQZ", "+", "FFFF"), ["S002"]),
        (("@r", "ACGT", "+", "FFF"), ["S005"]),
        (("@r", "ACGT", "+", "F FF"), ["S006"]),
        (("", "", "", ""), ["S003", "S004", "S001"]),
    ],
)
def test_record_rules(spark, record, found):
    assert codes(lint.lint(records(spark, [record]))) == found


def test_places_and_messages(spark):
    rows = [GOOD, ("@r", "ACXT", "x", "FFé"), ("@r", "A", "+", "")]
    found = {(r.record_no, r.validator_code): r for r in lint.lint(records(spark, rows), sources={0: "a.fq"}).collect()}
    assert {k: (v.line_no, v.col_no, v.message) for k, v in found.items()} == {
        (1, "S002"): (6, 3, "invalid sequence character: 'X'"),
        (1, "S001"): (7, 1, "missing + prefix"),
        (1, "S005"): (6, 1, "sequence-quality scores lengths mismatch: expected 4, got 3"),
        (1, "S006"): (8, 3, "invalid quality score character: 'é'"),
        (2, "S004"): (12, 1, "empty quality"),
        (2, "S005"): (10, 1, "sequence-quality scores lengths mismatch: expected 1, got 0"),
    }
    assert {r.src for r in found.values()} == {"a.fq"}


def test_registry():
    picked = lambda *a: sorted(s.code for s in V.select(V.SINGLE, *a))
    assert picked("low") == ["S001", "S004"]
    assert picked("medium") == ["S001", "S002", "S004", "S006"]
    assert picked("high", ["S003", "X999"]) == ["S001", "S002", "S004", "S005", "S006"]
    assert [len(V.select(V.PAIRED, x)) for x in V.LEVELS] == [0, 1, 1]
    with pytest.raises(ValueError):
        V.select(V.SINGLE, "extreme")


def test_own_alphabet(spark):
    spec = V.ValidatorSpec("S002", "AlphabetValidator", "medium", V.alphabet("AC-]^"))
    df = records(spark, [("@r", "AC-]^", "+", "F"), ("@r", "ACG", "+", "F")])
    assert [(r.record_no, r.col_no) for r in lint.single_violations(df, [spec]).collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        V.alphabet("")


def pair(spark, first, second):
    return records(spark, first).unionByName(records(spark, second, 1))


def test_pairs_in_order_of_report(spark):
    first = [("@a/1", "ACGT", "+", "FFFF"), ("@b/1", "AXGT", "+", "FFFF"), ("@a/1", "ACGT", "+", "FFFF"), ("@a/1", "ACGT", "+", "FFFF")]
    second = [("@a/2", "ACGT", "+", "FFFF"), ("@c/2", "AYGT", "+", "FFFF"), ("@a/2", "ACGT", "+", "FFFF"), ("@a/2", "ACGT", "+", "FFFF")]
    df = pair(spark, first, second)
    rows = lint.lint(df, paired=True).orderBy(*lint.ORDER).collect()
    assert [(r.validator_code, r.segment, r.record_no) for r in rows] == [("S002", 0, 1), ("S002", 1, 1), ("P001", 0, 1), ("S007", 0, 2), ("S007", 0, 3)]
    assert rows[2].message == "names mismatch: expected '@c', got '@b'" and rows[3].message == "duplicate name: '@a'"
    assert codes(lint.lint(df, paired=True, disabled=["S007", "P001"])) == ["S002", "S002"]
    assert codes(lint.lint(df, paired=True, single_level="low", paired_level="low")) == ["S007", "S007"]
    assert lint.first_violation(lint.lint(df, paired=True)).first().validator_code == "S002"
    assert "S007" not in codes(lint.lint(df)) and "S007" in codes(lint.lint(df, duplicates=True))


def test_parity(spark):
    three, two = [GOOD] * 3, [GOOD] * 2
    assert pairs.parity(pair(spark, three, three)).collect() == []
    assert tuple(pairs.parity(pair(spark, three, two)).first()) == (2, 1)
    assert tuple(pairs.parity(pair(spark, two, three)).first()) == (2, 0)


def test_filters_follow_the_first_segment(spark):
    first = [("@a:1/1", "AGCT", "+", "FFFF"), ("@a:2/1", "TCGA", "+", "FFFF"), ("@a:3/1", "GCCA", "+", "FFFF")]
    second = [("@a:1/2", "TCTC", "+", "FFFF"), ("@a:2/2", "AAAA", "+", "FFFF"), ("@a:3/2", "TCTC", "+", "FFFF")]
    df = pair(spark, first, second)
    names = spark.createDataFrame([("a:2",), ("a:2",), (None,), ("zzz",)], "name string")
    for kept in (filters.filter_names(df, names), filters.filter_pattern(df, "^TC"), filters.filter_where(df, F.col("sequence") == "TCGA")):
        assert sorted((r.segment, r.definition) for r in kept.collect()) == [(0, "@a:2/1"), (1, "@a:2/2")]
        assert kept.columns == df.columns
    assert filters.missing_segments(filters.filter_pattern(df.where("segment = 0 or record_no <> 1"), "^TC"), 2).count() == 1
    assert filters.filter_names(df, names.limit(0)).count() == 0


def test_patterns(spark):
    df = spark.createDataFrame([("AC\r",), ("A\rC",), ("AC",)], "sequence string")
    hit = lambda p: [r.sequence for r in df.where(F.col("sequence").rlike(filters.java_pattern(p))).collect()]
    assert hit("AC$") == ["AC"] and hit("A.C") == ["A\rC"] and hit("(?P<x>A)C") == ["AC\r", "AC"]
    for bad in ("(", "(?=A)", "(A)\\1", "(?<!A)C", "[", "*"):
        with pytest.raises(ValueError):
            filters.java_pattern(bad)


def test_samples(spark):
    df = pair(spark, [GOOD] * 400, [GOOD] * 400)
    kept = sampling.sample_fraction(df, 0.25, 3)
    again = sampling.sample_fraction(df.repartition(7), 0.25, 3)
    place = lambda d: sorted((r.record_no, r.segment) for r in d.select("record_no", "segment").collect())
    assert place(kept) == place(again) != place(sampling.sample_fraction(df, 0.25, 4))
    assert 60 < kept.count() / 2 < 140 and {r["count"] for r in kept.groupBy("record_no").count().collect()} == {2}
    for n, size in ((0, 0), (1, 2), (123, 246), (400, 800), (999, 800)):
        exact = sampling.sample_exact(df, n, 3)
        assert exact.count() == size and place(exact) == place(sampling.sample_exact(df.repartition(3), n, 3))
    with pytest.raises(ValueError, match="invalid uniform range"):
        sampling.sample_exact(df.limit(0), 0)
    for p in (0.0, 1.0, -1.0, math.nan):
        with pytest.raises(ValueError, match="invalid probability"):
            sampling.check_quantity(p, None)
    for p, n in ((None, None), (0.5, 1)):
        with pytest.raises(ValueError, match="exactly one"):
            sampling.check_quantity(p, n)


def quality(df, strict=None):
    return [r.mean_quality for r in metrics.mean_quality(df, strict).orderBy("position").collect()]


def test_describe(spark):
    df = records(spark, [("@a", "ACGT", "+", "!+5?"), ("@b", "AC", "+", "!!")])
    row = metrics.describe(df).first()
    assert (row.record_count, row.min_sequence_length, row.max_sequence_length) == (2, 2, 4)
    mean = -10 * math.log10((0.1 + 1) / 2)
    assert row.avg_quality_score_per_position == pytest.approx([0, mean, 20, 30])
    assert math.copysign(1, row.avg_quality_score_per_position[0]) == -1
    empty = metrics.describe(df.limit(0)).first()
    assert (empty.record_count, empty.min_sequence_length, empty.max_sequence_length, empty.avg_quality_score_per_position) == (0, None, 0, [])


def test_quality_follows_the_longest_sequence_so_far(spark):
    df = records(spark, [("@a", "AC", "+", "IIII"), ("@b", "ACGTA", "+", "55")])
    found = quality(df)
    assert len(found) == 5 and all(math.isnan(x) for x in found[2:])
    later = quality(records(spark, [("@b", "ACGTA", "+", "55"), ("@a", "AC", "+", "IIII")]))
    assert later[2:4] == pytest.approx([40, 40]) and math.isnan(later[4])
    with pytest.raises(Exception, match="invalid quality score"):
        quality(records(spark, [("@a", "AC", "+", "I ")]))
    assert quality(records(spark, [("@a", "", "+", "")])) == []


def test_scores(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.1, 0.01, 0.001, 0.0001)], "p double")
    assert [r[0] for r in df.select(phred_score(F.col("p"))).collect()] == pytest.approx([0, 10, 20, 30, 40])


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"@\xe9\xc3\xa9"),)], "b binary").select(from_bytes(F.col("b")).alias("t"))
    row = df.select("t", F.length("t").alias("n"), display(F.col("t")).alias("d")).first()
    assert (row.t, row.n, row.d) == ("@\xe9\xc3\xa9", 4, "@�é")


def test_own_rules_of_pairs_and_staging(spark):
    longer = V.ValidatorSpec("X001", "LongName", "low", lambda field, failed: F.when(F.length(field("name_1")) > F.length(field("name_2")), failed(V.NAME, 1, "longer")))
    df = pair(spark, [("@abc/1", "ACGT", "+", "FFFF"), ("@b", "AXGT", "+", "FFFF"), ("@b", "", "+", "")], [("@a/2", "ACGT", "+", "FFFF"), ("@b", "ACGT", "+", "FFFF"), ("@b", "A", "+", "F")])
    assert codes(lint.lint(df, paired=True, mates=[longer])) == ["X001", "S002", "S004", "S007"]
    assert codes(lint.lint(df, paired=True, mates=[longer], paired_level="low", single=[], duplicates=False)) == ["X001"]
    key = lambda r: tuple(map(str, r))
    for how in ({}, {"single_level": "low"}, {"disabled": ["S007"]}, {"disabled": ["P001"]}, {"single": []}, {"separator": "b"}):
        plain, staged = (sorted(map(key, lint.lint(df, paired=True, staged=s, **how).collect())) for s in (False, True))
        assert plain == staged
    totals = {r["pass"]: (r.record_count, r.failure_count) for r in lint.totals(df, lint.lint(df, paired=True), True).collect()}
    assert totals == {1: (3, 3), 2: (3, 1)}
    assert [tuple(r) for r in lint.totals(df.limit(0), lint.lint(df.limit(0))).collect()] == [(1, 0, 0)]


def test_bloom_filters_hold_back_names_that_do_not_repeat(spark):
    rows = [(f"@n{i % 700}", "A", "+", "F") for i in range(1000)] + [("@hot", "A", "+", "F")] * 50
    df = records(spark, rows).repartition(5)
    numbers = df.select(F.xxhash64("definition").alias("n")).unionByName(spark.createDataFrame([(None,)], "n long"))
    again = {r.number for r in lint.possible_duplicates(numbers, 0.001, 64).collect()}
    repeated = {r.h for r in df.groupBy("definition").count().where("count > 1").select(F.xxhash64("definition").alias("h")).collect()}
    assert again >= repeated and len(again) < len(repeated) + 20
    place = lambda found: sorted((r.record_no, r.message) for r in found.collect())
    assert place(lint.duplicate_names(df, prefilter=True)) == place(lint.duplicate_names(df)) and lint.duplicate_names(df).count() == 349
    assert lint.duplicate_names(df.limit(0), prefilter=True).count() == 0


def test_own_metrics(spark):
    df = records(spark, [("@a", "ACGT", "+", "!+5?"), ("@b", "AC", "+", "!!")])
    row = metrics.describe(df, more=[metrics.Metric("bases", F.sum(F.length("sequence"))), metrics.Metric("longest_name", F.max("definition"))]).first()
    assert (row.record_count, row.bases, row.longest_name, len(row.avg_quality_score_per_position)) == (2, 6, "@b", 4)


def test_descriptions_scan_once(spark):
    """Qualities no longer than their sequences need no second pass."""
    df = records(spark, [("@a", "ACGT", "+", "II"), ("@b", "AC", "+", "II")])
    passes = []
    original = metrics._with_longest
    try:
        metrics._with_longest = lambda *a: passes.append(1) or original(*a)
        assert metrics.describe(df).first().avg_quality_score_per_position[:2] == pytest.approx([40, 40]) and not passes
        assert quality(records(spark, [("@a", "AC", "+", "III")])) and passes == [1]
        assert quality(records(spark, [("@a", "AC", "+", "III")]), strict=False) == pytest.approx([40, 40]) and passes == [1]
    finally:
        metrics._with_longest = original
    assert [r.record_no for r in metrics.undecodable(records(spark, [("@a", "AC", "+", "I "), ("@b", "AC", "+", "II "), ("@c", "ACG", "+", "II "), ("@d", "A", "+", "II ")])).orderBy("record_no").collect()] == [0, 2, 3]
