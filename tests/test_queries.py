"""Each registered query runs over empty and small tables and keeps its schema; SQL names match."""

import importlib.util
import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"


def entry():
    spec = importlib.util.spec_from_file_location("entry_under_test", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_sql_belongs_to_queries():
    assert set(entry().oracle_sql()) <= set(entry().queries())


def test_queries_are_named_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert len(e.queries()) > 30 and e.oracle_sql(); assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.join(os.path.dirname(__file__), ".."), check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_core_queries_match_sql(spark):
    import duckdb
    from strandmill.plans import queries as Q

    base = duckdb.connect()
    for name in os.listdir(DATA):
        base.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in Q.oracle_sql().items():
        df = Q.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
        found = base.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert got == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall()), name


def test_descriptions_take_every_row_the_reference_decodes(spark, tmp_path):
    import math

    from strandmill.plans import queries as Q

    rows = [("AC", "5555"), ("ACGT", "5\xe9"), ("ACGTAC", "+ 55"), (None, None), ("A", "5555555 "), ("ACG", "\x7f+\U0001f600"), ("ACGTACGTAC", "!\x1f")]
    spark.createDataFrame([(i, 1, i, 0, "@r", x, "+", q) for i, (x, q) in enumerate(rows)],
                          "read_id long, file_id long, record_no long, segment int, definition string, sequence string, plus_line string, quality string").write.parquet(f"{tmp_path}/fastq_reads.parquet")
    longest, so_far, sums = 0, [], {}
    for i, (x, q) in enumerate(rows):
        longest = max(longest, len(x or ""))
        so_far.append((i, longest))
        scores = (q or "").encode()[:longest]
        if all(b >= 33 for b in scores):
            for p, b in enumerate(scores):
                sums.setdefault(p, []).append(10 ** (-(b - 33) / 10))
    mean = [round(-10 * math.log10(sum(sums[p]) / len(sums[p])), 6) if p in sums else math.nan for p in range(longest)]
    run = lambda name: Q.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, run("running_longest_all").collect())) == so_far
    found = [r.mean_quality for r in run("describe_quality_all").orderBy("position").collect()]
    assert found == pytest.approx(mean, nan_ok=True)
    row, lengths = run("describe_all").first(), run("describe_lengths").first()
    assert row[:3] == lengths[:3] == (7, 0, 10)
    assert [float(x) for x in row.avg_quality_score_per_position.split(",")] == pytest.approx(mean, nan_ok=True)
