"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import keep, shuffle_partitions
from .tokens import count_tokens

#: Tokens a block and an output shard hold on average; there are as many as that takes.
BLOCK_TOKENS, SHARD_TOKENS = 200_000, 2_000_000

#: Parts of the splitting tree that tasks go on with; the driver splits no further.
SUBTREES = 256

#: Cells of a running sum over one group, as a power of two: rows of a window, whatever the group's size.
CELL_BITS = 10

#: Rows the table of targets may have; it is read by the driver.
MOST_SOURCES = 10_000


def quotas(shares: dict[str, float], capacity: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives.

    Without ``total``: the most tokens at which all sources that have any keep their
    shares to each other.  With it: each source its share of the total, as far as it
    can; what is short is spread over the others by their shares.
    """
    out = dict.fromkeys(shares, 0.0)
    open_ = {s for s in shares if shares[s] > 0 and capacity.get(s, 0) > 0}
    if not open_:
        return out
    if total is None:
        whole = sum(shares[s] for s in open_)
        most = min(capacity[s] / (shares[s] / whole) for s in open_)
        return out | {s: min(capacity[s], most * shares[s] / whole) for s in open_}
    left = float(total)
    while open_:
        whole = sum(shares[s] for s in open_)
        full = {s for s in open_ if capacity[s] <= left * shares[s] / whole}
        if not full:
            return out | {s: left * shares[s] / whole for s in open_}
        out |= {s: float(capacity[s]) for s in full}
        left -= sum(capacity[s] for s in full)
        open_ -= full
    return out


def split_node(first: int, last: int, have: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals blocks of all sources to the two halves of the shards from ``first`` to ``last``.

    In proportion to the halves' numbers of shards; how many of each source go left is a
    multivariate hypergeometric draw.  The same wherever it is made.
    """
    middle, total = (first + last) // 2, int(have.sum())
    share = total * (middle - first)
    rng = np.random.default_rng([seed & 0xFFFFFFFF, first, last])
    take = share // (last - first) + int(rng.random() < (share % (last - first)) / (last - first))
    left = rng.multivariate_hypergeometric(have, take, method="marginals") if 0 < take < total else have * (take >= total > 0)
    return left, have - left


Node = tuple[int, int, np.ndarray, np.ndarray]


def split_tree(root: Node, seed: int, leaves: int | None = None) -> list[Node]:
    """The parts of a splitting tree in order: ``(first shard, last, blocks of each source, blocks of each source before)``.

    Down to single shards, or to the first level that has ``leaves`` parts.  Numbers
    stay exact: each source's sum over the parts is its blocks.  Parts without blocks
    are left out.
    """
    level = [root]
    while any(last - first > 1 for first, last, _, _ in level) and (leaves is None or len(level) < leaves):
        below: list[Node] = []
        for first, last, have, before in level:
            if last - first == 1:
                below.append((first, last, have, before))
                continue
            middle = (first + last) // 2
            left, right = split_node(first, last, have, seed)
            below += [(first, middle, left, before), (middle, last, right, before + left)]
        level = [node for node in below if node[2].any()]
    return level


def split_blocks(blocks: dict[str, int], shards: int, seed: int = 0) -> dict[str, np.ndarray]:
    """How many of each source's blocks every shard gets, in one process."""
    names = sorted(blocks)
    have = np.array([blocks[n] for n in names], dtype=np.int64)
    out = np.zeros((shards, len(names)), dtype=np.int64)
    for first, _, own, _ in split_tree((0, shards, have, np.zeros_like(have)), seed):
        out[first] = own
    return {n: out[:, i] for i, n in enumerate(names)}


_DEALT = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("shard", T.IntegerType()), ("first", T.LongType()), ("last", T.LongType()))])


def dealt_blocks(spark, blocks: dict[str, int], shards: int, seed: int = 0) -> DataFrame:
    """Rows ``(source, shard, first, last)``: the ranks of a source's blocks that a shard gets, from 1 on.

    The driver splits the tree into SUBTREES parts, a row of numbers each; tasks split
    these down to the shards.
    """
    names = sorted(blocks)
    have = np.array([blocks[n] for n in names], dtype=np.int64)
    parts = split_tree((0, shards, have, np.zeros_like(have)), seed, SUBTREES) if names else []
    rows = [(first, last, own.tolist(), before.tolist()) for first, last, own, before in parts if own.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, own, before in zip(*(c.to_pylist() for c in batch.columns)):
                for shard, _, own_here, before_here in split_tree((first, last, np.array(own), np.array(before)), seed):
                    at = np.flatnonzero(own_here)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in at]), pa.array(np.full(len(at), shard, dtype=np.int32)), pa.array(before_here[at] + 1), pa.array(before_here[at] + own_here[at])],
                        names=_DEALT.names,
                    )

    tree = spark.createDataFrame(rows, "first int, last int, own array<long>, before array<long>")
    return tree.repartition(max(1, min(len(rows), shuffle_partitions(spark)))).mapInArrow(run, _DEALT)


def running_sum(df: DataFrame, keys: list[str], number: str, value: str, into: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows before it and its own, by the random 64-bit ``number``.

    Two levels: the group's rows lie in cells by the first bits of the number, whose
    sums are added up first, so no task has to sort a group.
    """
    rows = df.withColumn("_cell", F.shiftright(F.col(number), 64 - CELL_BITS))
    cells = rows.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select(*keys, "_cell", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside)).join(cells, [*keys, "_cell"])
    return summed.withColumn(into, F.col("_before") + F.col("_inside")).drop("_cell", "_before", "_inside")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The table of targets; a repeated source is an error, null ones are left out."""
    rows = targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    out = {r.source: (float(r.target_share or 0), max(0, int(r.max_repeats or 0))) for r in rows if r.source is not None}
    if len(out) < sum(r.source is not None for r in rows):
        raise ValueError("a source has two targets")
    return out


def _sized(documents: DataFrame, names: list[str], vocabulary: str | None) -> DataFrame:
    rows = documents.where(F.col("source").isin(names)) if names else documents.where(F.lit(False))
    return keep(count_tokens(rows, ["doc_id", "source"], vocabulary=vocabulary).where(F.col("n_tokens") > 0), "sized")


def _stock(sized: DataFrame) -> dict[str, tuple[int, int]]:
    """Documents and tokens of each source: a row for each target at most."""
    return {r.source: (r.docs, r.tokens) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}


def mix_whole(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """mix_sources() at a total of all tokens of the targets' sources; what sources short of their share lack is spread over the others."""
    sized, total = _whole(documents, targets, vocabulary)
    return mix_sources(documents, targets, total, seed, vocabulary, sized)


def report_whole(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """mix_report() of mix_whole(), with ``wanted_tokens`` (the share of the total) and ``short``: whether max_repeats of all documents are fewer."""
    sized, total = _whole(documents, targets, vocabulary)
    report = mix_report(documents, targets, total, seed, vocabulary, sized)
    wanted = F.coalesce("target_share", F.lit(0.0)) * F.lit(total)
    most = F.col("available_tokens") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    return report.withColumns({"wanted_tokens": wanted, "short": most < wanted})


def _whole(documents: DataFrame, targets: DataFrame, vocabulary: str | None) -> tuple[DataFrame, float]:
    """The sized documents of the targets' sources, and all their tokens."""
    sized = _sized(documents, list(_targets(targets)), vocabulary)
    return sized, float(sum(tokens for _, tokens in _stock(sized).values()))


def _lookup(spark, rows: list[tuple], fields: list[T.StructField]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType(fields))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0,
                vocabulary: str | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Rows ``(doc_id, source, copy_no, n_tokens, shard, shard_pos)``: the mix, spread over shards and shuffled.

    A source's quota (see quotas()) is met by whole copies of it, each document once a
    copy, and a last copy cut off: its documents lie in random blocks; whole blocks are
    taken by their prefix sum, and in the block that crosses the quota documents in
    random order up to the nearest.  So a source misses its quota by half a document
    at most, and no document is used more than ``max_repeats`` times.  Blocks are dealt
    to shards by split_blocks(), disjointly, and shuffled within each shard.

    Documents of no target's source, or of no tokens, aren't used; a source without
    documents gives nothing.  A row is a document, also where its id repeats.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    sized = _sized(documents, list(wanted), vocabulary) if sized is None else sized
    stock = _stock(sized)
    quota = quotas({s: t[0] for s, t in wanted.items()}, {s: stock[s][1] * wanted[s][1] for s in stock if s in wanted}, total_tokens)
    plan = []
    for source, tokens in quota.items():
        if tokens > 0:
            have = stock[source][1]
            whole = min(int(tokens // have + 1e-9), wanted[source][1])
            rest = max(0.0, tokens - whole * have) if whole < wanted[source][1] else 0.0
            blocks = max(1, math.ceil(have / BLOCK_TOKENS))
            plan.append((source, whole, float(rest), blocks))
    names = [T.StructField("source", T.StringType())]
    # One row a source: sent to all tasks, at most MOST_SOURCES rows.
    chosen = F.broadcast(_lookup(spark, plan, [*names, T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType()), T.StructField("blocks", T.LongType())]))
    copies = (
        sized.join(chosen, "source")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .where((F.col("copy_no") < F.col("whole")) | (F.col("rest") > 0))
        .withColumn("dice", F.xxhash64(F.lit(seed), F.col("copy_no"), F.col("doc_id"), F.col("source")))
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("dice")), F.col("blocks")).cast("long"))
    )
    # Blocks of all copies, in random order within a copy: those before the quota, whole or cut; then in random order within the source.
    sums = copies.groupBy("source", "copy_no", "block").agg(F.sum("n_tokens").alias("sum"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    sums = sums.withColumns({"order": F.xxhash64(F.lit(seed), "block", "copy_no"), "deal": F.xxhash64(F.lit("deal"), F.lit(seed), "block", "copy_no")})
    taken = (
        running_sum(sums, ["source", "copy_no"], "order", "sum", "upto")
        .withColumn("before", F.col("upto") - F.col("sum"))
        .where((F.col("copy_no") < F.col("whole")) | (F.col("before") < F.col("rest")))
        .withColumn("left", F.when((F.col("copy_no") < F.col("whole")) | (F.col("upto") <= F.col("rest")), F.lit(None).cast("double")).otherwise(F.col("rest") - F.col("before")))
        .select("source", "copy_no", "block", "left", "deal", F.lit(1).alias("one"))
    )
    ranked = keep(running_sum(taken, ["source"], "deal", "one", "rank").select("source", "copy_no", "block", "left", "rank"), "blocks")
    counts = {r.source: r["count"] for r in ranked.groupBy("source").count().collect()}  # a row a source
    shards = max(1, math.ceil(sum(quota.values()) / SHARD_TOKENS))
    shard_of = dealt_blocks(spark, counts, shards, seed).select("source", "shard", F.explode(F.sequence("first", "last")).alias("rank"))
    placed = ranked.join(shard_of, ["source", "rank"]).select("source", "copy_no", "block", "left", "shard")
    rows = copies.select("doc_id", "source", "copy_no", "n_tokens", "dice", "block").join(placed, ["source", "copy_no", "block"])
    crossing = Window.partitionBy("source", "copy_no", "block").orderBy("dice", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.where(F.col("left").isNull())
    cut = rows.where(F.col("left").isNotNull()).withColumn("upto", F.sum("n_tokens").over(crossing)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).drop("upto")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit("shuffle"), F.col("dice"), F.col("shard")), "doc_id", "copy_no")
    return (
        whole.unionByName(cut)
        .withColumn("shard_pos", F.row_number().over(shuffled) - 1)
        .select("doc_id", "source", "copy_no", "n_tokens", "shard", "shard_pos")
    )


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0,
               vocabulary: str | None = None, sized: DataFrame | None = None) -> DataFrame:
    """One row per target: its share, the share reached, tokens, documents and uses of the mix, and what there is."""
    wanted = _targets(targets)
    sized = _sized(documents, list(wanted), vocabulary) if sized is None else sized
    mix = mix_sources(documents, targets, total_tokens, seed, vocabulary, sized)
    used = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    used = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    there = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    return (
        targets.select("source", "target_share", "max_repeats").join(used, "source", "left").join(there, "source", "left")
        .withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row a target
        .select(
            "source", "target_share",
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "most_uses", "available_tokens")],
            F.col("max_repeats").cast("long").alias("max_repeats"),
        )
    )
