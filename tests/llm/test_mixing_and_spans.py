"""Mixes and shared spans against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandmill.llm import mixing, span_index, spans, windows

TARGETS = "source string, target_share double, max_repeats int"


def test_quotas():
    q = mixing.quotas({"a": 0.5, "b": 0.4, "none": 0.1}, {"a": 100.0, "b": 400.0})
    assert q == pytest.approx({"a": 100, "b": 80, "none": 0})
    assert mixing.quotas({"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 400.0}, 100) == pytest.approx({"a": 10, "b": 90})
    assert mixing.quotas({"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 20.0}, 100) == pytest.approx({"a": 10, "b": 20})
    assert mixing.quotas({"a": 1.0}, {}) == {"a": 0.0}


def test_splitting_keeps_numbers():
    for shards in (1, 2, 7, 64):
        dealt = mixing.split_blocks({"a": 1000, "b": 37, "c": 0}, shards, 3)
        assert {k: int(v.sum()) for k, v in dealt.items()} == {"a": 1000, "b": 37, "c": 0}
        sizes = sum(dealt.values())
        assert sizes.max() - sizes.min() <= 7 and (np.array(list(dealt.values())) >= 0).all()
    mean = np.mean([mixing.split_blocks({"a": 30, "b": 10}, 4, s)["b"] for s in range(300)], axis=0)
    assert abs(mean - 2.5).max() < 0.4


def test_tasks_deal_as_one_process_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUBTREES", 4)
    blocks, want = {"a": 1000, "b": 37, "c": 0, "d": 1}, defaultdict(list)
    for source, per in mixing.split_blocks(blocks, 50, 3).items():
        ends = np.cumsum(per)
        want |= {(source, shard): (int(e - n + 1), int(e)) for shard, (n, e) in enumerate(zip(per, ends)) if n}
    assert {(r.source, r.shard): (r.first, r.last) for r in mixing.dealt_blocks(spark, blocks, 50, 3).collect()} == want
    assert mixing.dealt_blocks(spark, {}, 5).count() == 0


def test_running_sums(spark):
    rows = [(g, i * 7919 * 0x9E3779B97F4A7C15 % 2**64 - 2**63, i) for i in range(500) for g in ("a", "b")]
    found = mixing.running_sum(spark.createDataFrame(rows, "g string, h long, v long").repartition(3), ["g"], "h", "v", "upto").collect()
    want, total = {}, Counter()
    for g, h, v in sorted(rows, key=lambda r: r[1]):
        total[g] += v
        want[g, h] = total[g]
    assert {(r.g, r.h): r.upto for r in found} == want


def documents(spark, n=300):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice(["big"] * 6 + ["small", "mid", "mid", "other", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "big"), (n + 1, "", "big"), (n + 2, "x", "big")], "doc_id long, text string, source string")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 900)
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.1, 5), (None, 0.1, 1)], TARGETS)
    rows = mixing.mix_sources(docs, targets).collect()
    uses = Counter((r.doc_id, r.source) for r in rows)
    most = {"big": 1, "small": 3, "mid": 2}
    assert all(c <= most[s] for (_, s), c in uses.items()) and max(c for (_, s), c in uses.items() if s == "small") == 3
    assert Counter((r.doc_id, r.copy_no) for r in rows).most_common(1)[0][1] == 1
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    assert set(tokens) == set(most)
    for source, share in (("big", 4 / 9), ("small", 3 / 9), ("mid", 2 / 9)):
        assert abs(tokens[source] - share * total) < 120
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.shard_pos)
    assert len(places) > 1 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3), targets).collect()))
    report = {r.source: r for r in mixing.mix_report(docs, targets).collect()}
    assert {s: report[s].tokens for s in most} == dict(tokens) and report["absent"].reached_share == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1) and report["small"].most_uses == 3


def test_mix_of_all_tokens_repeats_and_reports_the_short(spark):
    rows = [(i, "word " * 40, "big") for i in range(60)] + [(100, "word " * 20, "small"), (101, "word " * 20, "small")] + [(200 + i, "word " * 30, "mid") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("mid", 0.1, 2), ("absent", 0.1, 4)], TARGETS)
    report = {r.source: r for r in mixing.report_whole(docs, targets).collect()}
    have = {s: r.available_tokens for s, r in report.items()}
    total = sum(have.values())
    assert {s for s, r in report.items() if r.short} == {"small", "absent"}
    assert report["small"].tokens == 3 * have["small"] and report["small"].most_uses == 3 and report["absent"].tokens == 0
    left = total - 3 * have["small"]
    assert abs(report["big"].tokens - left * 5 / 6) <= have["big"] / 60 and abs(report["mid"].tokens - left / 6) <= have["mid"] / 20
    assert report["small"].wanted_tokens == pytest.approx(0.3 * total)
    uses = Counter((r.source, r.doc_id) for r in mixing.mix_whole(docs, targets).collect())
    assert all(uses["small", i] == 3 for i in (100, 101))
    assert mixing.mix_whole(docs.limit(0), targets).count() == 0


def test_mix_of_a_given_size(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    for total in (500, 10**9):
        got = Counter()
        for r in mixing.mix_sources(docs, targets, total_tokens=total).collect():
            got[r.source] += r.n_tokens
        if total == 500:
            assert abs(got["big"] - 250) <= 31 and abs(got["small"] - 250) <= 31
        else:
            assert got["big"] == sum(len(r.text.split()) + 1 for r in docs.where("source = 'big' and text like 'word%'").collect()) + 1
    for empty in (mixing.mix_sources(docs.limit(0), targets), mixing.mix_sources(docs, targets.limit(0))):
        assert empty.count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, targets.unionAll(targets))


def test_window_hashes_agree_with_windows():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(3000))
    h = windows.window_hashes(windows.code_points(text), 12)
    by = defaultdict(set)
    for i, x in enumerate(h.tolist()):
        by[text[i : i + 12]].add(x)
    assert all(len(s) == 1 for s in by.values()) and len({next(iter(s)) for s in by.values()}) == len(by)


def brute(rows, span):
    where = defaultdict(set)
    for i, t in rows:
        for at in range(len(t or "") - span + 1):
            where[t[at : at + span]].add(i)
    pairs = {(a, b) for s in where.values() if len(s) > 1 for a in s for b in s if a < b}
    cover = {}
    for i, t in rows:
        hit = set()
        for at in range(len(t or "") - span + 1):
            if len(where[t[at : at + span]]) > 1:
                hit.update(range(at, at + span))
        cover[i] = len(hit)
    return pairs, cover


def corpus(seed, n=60):
    rng = random.Random(seed)
    phrase = "".join(rng.choice("abcdefgh é𝒳") for _ in range(70))
    passages = ["".join(rng.choice("abcdefgh é𝒳") for _ in range(rng.randrange(30, 130))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice("abcdefgh é𝒳") for _ in range(rng.randrange(80))) for _ in range(3)]
        text = parts[0] + rng.choice(["", rng.choice(passages), phrase[:39] if i % 2 else phrase[:25]]) + parts[1] + rng.choice(["", rng.choice(passages)]) + parts[2]
        rows.append((i, text))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "z" * 300), (n + 5, "z" * 41), (n + 6, "y" * 39), (n + 7, "y" * 39), (n + 8, rows[4][1] * 2)]


@pytest.mark.parametrize("crowd, batch", [(64, 1 << 18), (3, 1 << 18), (2, 50)])
def test_shared_spans(spark, monkeypatch, crowd, batch):
    monkeypatch.setattr(span_index, "BATCH_ROWS", batch)
    span = 40
    rows = corpus(crowd + batch)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("x")).withColumn("a", F.lit(1)).repartition(5)
    pairs, cover = brute(rows, span)
    found = spans.pairs_of_records(*spans.shared_pairs(df, span=span, crowd=crowd))
    assert sorted(map(tuple, found.collect())) == sorted(pairs)
    if batch == 50:
        lengths = {r.doc_id: r for r in spans.shared_lengths(df, span=span, crowd=crowd).collect()}
        assert {i: r.shared_chars for i, r in lengths.items()} == cover
        assert lengths[3].class_id == lengths[60].class_id == lengths[61].class_id == 3 and lengths[62].shared_share == 0


def test_long_texts_come_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef") for _ in range(50_000))
    rows = [(1, long), (2, "x" * 50 + long[24_990:25_240] + "y" * 50), (3, long[100:299]), (4, long[48_000:48_200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, spans.pairs_of_records(*spans.shared_pairs(df)).collect())) == [(1, 2), (1, 4)]
    numbers = list(windows.pieces([long, "short", long], 200))
    assert {i for g, _ in numbers for i in g} == {0, 2}
    assert spans.shared_lengths(df.limit(0)).count() == 0


def test_parts_overlap(monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_CHARS", 1000)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    covered = set()
    for _, parts in windows.pieces([text], 200):
        for p in parts:
            at = text.index(p)
            covered.update(range(at, at + len(p) - 199))
    assert covered == set(range(4801))


def test_batches_through_a_stored_index(spark, monkeypatch):
    monkeypatch.setattr(span_index, "BATCH_ROWS", 70)
    rows = corpus(11, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs, _ = brute(rows, 40)
    for crowd in (64, 3):
        batches = [df.where(F.pmod("doc_id", F.lit(4)) == i) for i in range(4)] + [df.limit(0), df.where("doc_id < 3")]
        found = spans.pairs_of_records(*spans.shared_pairs_in_batches(batches, span=40, crowd=crowd))
        assert sorted(map(tuple, found.collect())) == sorted(pairs)


def test_index_is_opened_again_and_compacts(spark, tmp_path):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = spans.new_index(spark, f"{tmp_path}/index", 3, span=40)
    verified = []
    for low in range(0, 80, 10):
        index = span_index.SpanIndex.open(spark, f"{tmp_path}/index")
        part = df.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + 10))
        pairs, _ = spans.shared_pairs(part, index=index, earlier=df.where(F.col("doc_id") < low))
        verified += [(r.a.doc, r.b.doc) for r in pairs.collect()]
    assert index.span == 40 and len(index.runs) <= 4 and sum(n for _, n in index.runs) > 100
    assert {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run-")} == {r for r, _ in index.runs}
    one = {(r.a.doc, r.b.doc) for r in spans.shared_pairs(df, span=40)[0].collect()}
    assert {tuple(sorted(p)) for p in verified} == {tuple(sorted(p)) for p in one} and one


@pytest.mark.parametrize("crowd", [64, 2])
def test_ids_of_two_texts_and_hot_texts_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(spans, "HOT_PAIRS", 5)
    rng = random.Random(3)
    common = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, common + f"{i:05d}" * 4) for i in range(40)] + [(i, f"{i:06d}" * 9) for i in range(40)] + [(100 + i, common) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = {(a, b) for a in [*range(40), *range(100, 130)] for b in [*range(40), *range(100, 130)] if a < b}
    verified, classes = spans.shared_pairs(df, span=40, crowd=crowd)
    found = {tuple(r) for r in spans.pairs_of_records(verified, classes).collect()}
    assert found >= pairs and {p for p in found if p not in pairs} <= {(a, b) for a in range(40) for b in range(40)}
    told = {(r.doc_id, r.class_id, r.class_size, r.links) for r in spans.class_rows(verified, classes).collect() if r.doc_id >= 100}
    assert told == {(100 + i, 100, 30, 40) for i in range(30)}


def test_streams_of_entries_hold_little(monkeypatch):
    e = lambda h, d: (np.array(h), np.array(d), np.zeros(len(h), dtype=np.int64))
    new = [e([1, 1, 2], [1, 2, 1]), e([2, 2, 2, 2], [2, 3, 4, 5]), e([2, 2, 5, 6], [6, 7, 1, 9])]
    old = [[e([0, 1, 2, 5], [8, 8, 8, 8]), e([5, 7], [9, 9])], []]
    links = [(a, b, c) for x in span_index.merge_joined(new, old, 3, 0) for a, b, c in zip(*(y.to_pylist() for y in x.columns))]
    assert {(a, b) for a, b, c in links if not c} == {(1, 2), (1, 8), (2, 8), (1, 9)}
    assert sorted(a for a, b, c in links if c and b == 2) == [1, 2, 3, 4, 5, 6, 7, 8]
