"""Streams give what batches give."""

import datetime

from strandmill.operators import lint
from strandmill.schema import as_reads
from strandmill.streaming import reads as S


def test_streams(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    rows = [(i, i // 2, i % 2, f"@r{i // 4}/1", "ACGX" if i % 5 == 0 else "ACGT", "+" if i % 7 else None, "FFFF", day + datetime.timedelta(hours=i)) for i in range(40)]
    schema = "read_id long, record_no long, segment int, definition string, sequence string, plus_line string, quality string, received_at timestamp"
    path = str(tmp_path / "reads")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    batch = as_reads(spark.read.parquet(path))
    place = lambda d: sorted((r.record_no, r.segment, r.validator_code) for r in d.collect())
    found = S.collected(S.lint_stream(as_reads(S.stream_reads(spark, path))))
    assert place(found) == place(lint.single_violations(batch, lint.V.SINGLE)) and found.count() > 5
    daily = S.collected(S.windowed_counts(S.stream_reads(spark, path), "received_at"), "complete")
    assert sorted(r.record_count for r in daily.collect()) == [16, 24]
    repeats = S.collected(S.repeated_names(as_reads(S.stream_reads(spark, path, 1)), "read_id", "received_at"))
    assert repeats.count() == 20 - 10


def test_names_are_forgotten_when_event_time_has_passed(spark, tmp_path):
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    batches = [[(1, "@a", day(0)), (2, "@b", day(0)), (3, "@a", day(1))], [(4, "@a", day(2)), (5, "@c", day(12))], [(6, "@c", day(12)), (7, "@b", day(12)), (8, None, day(12)), (9, "@c", None)], [(10, "@b", day(13)), (11, "@a", day(13))]]
    schema = "read_id long, record_no long, segment int, definition string, sequence string, plus_line string, quality string, received_at timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, n, 0, d, "A", "+", "F", t) for n, d, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    found = S.collected(S.repeated_names(as_reads(S.stream_reads(spark, str(tmp_path / "r"), 1)), "read_id", "received_at", "3 days", ranges=2))
    # Event time reaches day 12 with the second batch, so the third begins at day 9, when a and b are forgotten.
    assert sorted((r.name, r.read_id) for r in found.collect()) == [("@a", 3), ("@a", 4), ("@b", 10), ("@c", 6)]
