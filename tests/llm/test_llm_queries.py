"""The problems' queries over the smallest tables against SQL."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_queries_match_sql(spark):
    import duckdb
    from strandmill.llm import queries as Q

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


def test_columns(spark):
    from strandmill.llm import queries as Q

    want = {"p1_found": ["read_id"], "p2_found": ["sequence"], "p3_found": ["run_day", "instrument_id", "field"], "p4_found": ["run_day", "instrument_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id_a", "doc_id_b"]}
    for name, columns in want.items():
        assert Q.queries()[name](spark, DATA).columns == columns
