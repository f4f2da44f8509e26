"""Repeated keys, frequent values, distinct counts, percentiles and samples against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandmill.llm import distinct, frequent, percentiles, prefilter, sampling, seen
from strandmill.llm.perfect_hash import SealedPartition, mix
from strandmill.plans import runtime


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        prints = (mix(keys, 9) >> np.uint64(32)).astype(np.uint32)
        made = SealedPartition.seal(keys, prints)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        other = rng.integers(0, 2**63, 100_000).astype(np.uint64) | np.uint64(1 << 63)
        again = SealedPartition.from_bytes(made.to_bytes())
        for p in (made, again):
            assert p.holds(keys, prints).all() and not p.holds(other, (mix(other, 9) >> np.uint64(32)).astype(np.uint32)).any()
        if n == 50_000:
            assert len(made.to_bytes()) < 5 * n


def test_narrow_fingerprints_err_as_expected():
    keys = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    made = SealedPartition.seal(keys, (mix(keys, 9) & np.uint64(0xFF)).astype(np.uint32))
    other = keys + np.uint64(12345)
    rate = made.holds(other, (mix(other, 9) & np.uint64(0xFF)).astype(np.uint32)).mean()
    assert 0 < rate < 2 / 256


def names(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "hot", "hot", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", f"x{i}"])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def repeats(rows):
    first = {}
    for i, k in sorted(rows):
        if k:
            first.setdefault(k, i)
    return sorted(i for i, k in rows if k and i > first[k])


@pytest.mark.parametrize("seal", [1, 64, 100_000])
def test_seen_before(spark, seal):
    rows = names(800 if seal == 1 else 4000)
    df = spark.createDataFrame(rows, "read_id long, name string").withColumn("how", F.lit(1)).withColumn("_key", F.lit("x")).repartition(5)
    assert sorted(r.read_id for r in seen.seen_before(df, "name", "read_id", seal_keys=seal).collect()) == repeats(rows)
    if seal == 64:
        kinds = {r.how: r["count"] for r in seen.seen_candidates(df, "name", "read_id", 7, seal_keys=64).groupBy("how").count().collect()}
        assert kinds[seen.SEALED] > 100
        report = seen.error_report(df, "name", "read_id", seal_keys=64).first()
        assert report.lookups == sum(bool(k) for _, k in rows) and report.wrong_answers == 0
        assert report.exact_in_piece + report.exact_in_batch + report.by_fingerprint == len(repeats(rows))


def test_ranges_bound_what_a_key_is_compared_with(spark):
    assert seen.ranges_for(0) == 1 and seen.ranges_for(10**9) == math.ceil(10**9 / (4096 * 8))
    df = spark.createDataFrame([(i, f"k{i}") for i in range(4000)], "o long, k string")
    placed = seen.seen_candidates(df, "k", "o", seen.ranges_for(4000, 16), seal_keys=16, emit_sealed=True)
    per_range = [r["count"] for r in seen.sealed_rows(placed).groupBy("range_no").count().collect()]
    assert len(per_range) == seen.ranges_for(4000, 16) and max(per_range) <= 16


def test_wrong_fingerprints_are_caught(spark):
    rows = [(1, "a"), (2, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "o long, k string")
    claimed = spark.createDataFrame([(2, "b"), (3, "a")], "o long, _key string")
    assert {r.o: r.wrong for r in seen.exact_repeats(claimed, df, "k", ["o"]).collect()} == {2: True, 3: False}


def test_seen_before_of_nothing(spark):
    df = spark.createDataFrame([], "o long, k string")
    assert seen.seen_before(df, "k", "o").count() == 0 and seen.error_report(df, "k", "o").first().measured_rate == 0
    same = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (6, "")], "o long, k string")
    assert [r.o for r in seen.seen_before(same, "k", "o").collect()] == [5]


def test_index_is_stored_and_read_again(spark, tmp_path):
    rows = names(3000, 8)
    df = spark.createDataFrame(rows, "o long, k string")
    seen.new_index(spark, 4).write.parquet(str(tmp_path / "0"))
    found = []
    for low in range(0, 3000, 1000):
        index = spark.read.parquet(*[str(p) for p in tmp_path.iterdir()])
        assert seen.index_ranges(index) == 4
        part = df.where((F.col("o") >= low) & (F.col("o") < low + 1000))
        out = runtime.keep(seen.seen_candidates(part, "k", "o", seen.index_ranges(index), index, seal_keys=128, emit_sealed=True), "test")
        found += [r.ord for r in out.where("how >= 0").collect()]
        seen.sealed_rows(out).write.parquet(str(tmp_path / str(low + 1)))
    assert sorted(found) == repeats(rows)
    index = spark.read.parquet(*[str(p) for p in tmp_path.iterdir()])
    with pytest.raises(Exception, match="another number of ranges"):
        seen.seen_candidates(df, "k", "o", 16, index).collect()
    with pytest.raises(ValueError):
        seen.index_ranges(index.unionByName(seen.new_index(spark, 16)))
    with pytest.raises(ValueError):
        seen.index_ranges(index.limit(0))


def test_piece_after_piece(spark):
    rows = [(i, k, random.Random(i).choice([None, 1, 2, 3])) for i, k in names(1500, 9)]
    df = spark.createDataFrame(rows, "o long, k string, piece int").withColumn("ord", F.lit(1))
    first, want = {}, []
    for piece, i, k in sorted(((p or 0), i, k) for i, k, p in rows if k):
        if k in first:
            want.append((piece or None, i))
        first[k] = True
    got = [tuple(r) for r in seen.seen_by_piece(df, "k", "o", "piece", ranges=5, seal_keys=32).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert seen.seen_by_piece(df.limit(0), "k", "o", "piece", ranges=5).count() == 0


def test_map_of_bits_loses_nothing(spark):
    df = spark.range(2000).withColumn("_bits", F.lit(1))
    wanted = df.where("id % 7 = 0").select(F.xxhash64("id").alias("h"))
    passed = {r.id for r in prefilter.may_match(df, F.xxhash64("id"), wanted, "h").collect()}
    assert passed >= set(range(0, 2000, 7)) and len(passed) < 400
    assert prefilter.may_match(df, F.xxhash64("id"), wanted.limit(0), "h").count() == 0


def test_frequent_values(spark):
    rng = random.Random(1)
    values = [rng.choice(["a"] * 30 + ["b"] * 10 + [f"v{rng.randrange(5000)}"] * 60 + ["", None]) for _ in range(6000)]
    df = spark.createDataFrame([(v, 1) for v in values], "s string, n int")
    real = Counter(v for v in values if v)
    total = sum(real.values())
    for share in (0.5, 0.05, 0.001):
        assert {r.s: r.n for r in frequent.frequent_values(df, "s", share).collect()} == {v: c for v, c in real.items() if c >= share * total}
    assert frequent.frequent_values(df.limit(0), "s", 0.1).count() == 0
    assert {r.s for r in frequent.frequent_values(spark.createDataFrame([("x",), ("y",)], "s string"), "s", 0.5).collect()} == {"x", "y"}
    for share in (0, 1e-7):
        with pytest.raises(ValueError):
            frequent.frequent_values(df, "s", share)


def test_distinct_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([None, "", "hot", f"v{rng.randrange(50)}"]), "w") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, v string, field string").drop("field")
    df = df.withColumn("w", F.lit("w"))
    pairs = distinct.distinct_pairs(df, ["v", "w"], ["g", "h"], buckets=8)
    halves = [distinct.distinct_pairs(df.where(c), ["v", "w"], ["g", "h"], buckets=8) for c in ("g = 'a'", "g <> 'a'")]
    sets = [["g"], ["h"], ["g", "h"], []]
    for p in (pairs, distinct.merge_pairs(halves + [halves[0].limit(0)], ["g", "h"])):
        want = {}
        for s in sets:
            groups = defaultdict(list)
            for g, h, v, w in rows:
                key = (",".join(s), g if "g" in s else None, h if "h" in s else None)
                for f, x in (("v", v), ("w", w)):
                    if x:
                        groups[(*key, f)].append(x)
            want |= {k: (len(x), len(set(x))) for k, x in groups.items()}
        assert {(r.grouping, r.g, r.h, r.field): (r.n_values, r.n_distinct) for r in distinct.count_combinations(p, sets).collect()} == want
    fine = {(r.g, r.h, r.field): (r.n_values, r.n_distinct) for r in distinct.count_groups(pairs, ["g", "h"]).collect()}
    assert fine == {k[1:]: v for k, v in want.items() if k[0] == "g,h"}
    assert distinct.count_combinations(pairs.limit(0), sets).count() == 0


def test_percentiles(spark):
    rng = random.Random(3)
    odd = [None, float("nan"), 0.0, -0.0, 1e300, -1e300, float("inf")]
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([rng.gauss(0, 1), 7.0, rng.choice(odd)])) for _ in range(3000)] + [("c", 1.0), ("d", None), ("e", 2.0), ("e", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("value", F.lit(1)).repartition(6)
    ps = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    halves = percentiles.merge_counts([percentiles.value_counts(df.where(c), "x", ["g"]) for c in ("x < 0", "x >= 0")])
    merged = {r.g: r for r in percentiles.percentiles_of_counts(halves, ps).collect()}
    found = {r.g: r for r in percentiles.percentiles(df, "x", ["g"], ps).collect()}
    assert set(found) == {"a", "b", "c", "e", None} and found["e"].p_50 == 3.0 and len(merged) == 5
    for g, r in found.items():
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        assert r.n_values == len(v)
        for p in ps:
            at = p * (len(v) - 1)
            low, high, part = v[int(at)], v[min(len(v) - 1, int(at) + 1)], at - int(at)
            want = low if part == 0 or low == high else low * (1 - part) + high * part
            assert r[percentiles.percent_name(p)] == pytest.approx(want, rel=1e-12), (g, p)
    assert percentiles.percentiles(df.limit(0), "x", ["g"], [0.5]).count() == 0
    assert percentiles.percentiles(df, "x", [], [0.5]).count() == 1
    with pytest.raises(ValueError):
        percentiles.percentiles(df, "x", ["g"], [1.5])


def test_permutation_is_a_bijection_and_even():
    for n in (1, 2, 3, 7, 64, 1000):
        i = np.arange(n)
        for seed in range(20):
            assert sorted(sampling.permuted(i, np.full(n, n), np.full(n, seed)).tolist()) == list(range(n))
    n, seeds = 10, 6000
    first = sampling.permuted(np.tile(np.arange(3), seeds), np.full(3 * seeds, n), np.repeat(mix(np.arange(seeds, dtype=np.uint64), 1), 3))
    counts = np.bincount(first, minlength=n)
    expected = 3 * seeds / n
    assert ((counts - expected) ** 2 / expected).sum() < 28  # 9 degrees of freedom, p about 0.001
    pairs = Counter(tuple(sorted(x)) for x in first.reshape(-1, 3)[:, :2].tolist())
    assert len(pairs) == 45 and sum((c - seeds / 45) ** 2 / (seeds / 45) for c in pairs.values()) < 80  # 44 degrees


def test_samples_of_files(spark):
    rows = [(100 * f + 2 * i + s, f, i * 3, s) for f, n in ((1, 40), (2, 5)) for i in range(n) for s in (0, 1)]
    rows += [(9000, 1, 0, 0), (9001, 1, None, 0), (9002, None, 1, 0)]  # delivered again; no place; no file
    reads = spark.createDataFrame(rows, "read_id long, file_id long, record_no long, segment int").repartition(4)
    jobs = [(1, 1, 10, None, 5), (2, 1, 10, None, 5), (3, 1, 4, None, 5), (4, 1, 10, None, 6), (5, 1, 10, None, None), (6, 1, 10, None, None), (7, 2, 99, None, 1), (8, 2, 0, None, 1), (9, 2, -1, None, 1), (10, None, 3, None, 1), (11, 3, 3, None, 1), (12, 1, None, 0.5, 1), (13, 1, 3, 0.5, 1)]
    args = spark.createDataFrame(jobs, "job_id long, file_id long, record_count long, probability double, seed long")
    out = sampling.subsample_files(reads, args).collect()
    got = defaultdict(set)
    for r in out:
        got[r.job_id].add(r.record_no)
    assert {j: len(s) for j, s in got.items()} == {1: 10, 2: 10, 3: 4, 4: 10, 5: 10, 6: 10, 7: 5}
    assert got[1] == got[2] > got[3] and got[4] != got[1] and got[5] != got[6]
    assert Counter((r.job_id, r.read_id) for r in out).most_common(1)[0][1] == 1
    for job, records in got.items():
        want = sorted(i for i, f, n, _ in rows if f == (2 if job == 7 else 1) and n in records)
        assert sorted(r.read_id for r in out if r.job_id == job) == want
    assert sampling.subsample_files(reads.limit(0), args).count() == 0 and sampling.subsample_files(reads, args.limit(0)).count() == 0


def test_no_job_disappears(spark):
    reads = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 1, 0), (3, 2, None, 0)], "read_id long, file_id long, record_no long, segment int")
    jobs = [(1, 1, 1, None, 5), (2, 1, 1, 0.5, 5), (3, None, 1, 0.5, 5), (4, 1, None, 0.5, 5), (5, 1, 0, None, 5), (6, 1, -1, 0.5, 5), (7, 9, 1, None, 5), (8, 2, 1, None, 5), (9, 1, None, None, 5), (10, 1, 7, float("nan"), 5)]
    args = spark.createDataFrame(jobs, "job_id long, file_id long, record_count long, probability double, seed long")
    refused = {r.job_id: r.reason for r in sampling.refused_jobs(args, reads).collect()}
    assert refused == {2: "both", 3: "file", 4: "count", 5: "count", 6: "count", 7: "records", 8: "records", 9: "count", 10: "both"}
    assert {r.job_id for r in sampling.subsample_files(reads, args).collect()} | set(refused) == {j[0] for j in jobs}
    assert sampling.refused_jobs(args.limit(0), reads).count() == 0


def test_layout_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_RECORDS", 16)
    units = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("u")).unionByName(spark.range(1).select(F.lit(7).cast("long").alias("g"), "id").toDF("g", "u"))
    places = defaultdict(list)
    for r in sampling.random_layout(units, "g", "u").collect():
        places[r.g].append(r.place)
        assert r.size == (1 if r.g == 7 else 500)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 3
