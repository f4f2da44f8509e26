"""Exact percentiles per group by a full distributed sort with counts per partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import keep

def value_counts(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    """Rows ``(g, value, n)``: the partial result, one row per group and distinct value.

    ``g`` is a struct of the group's keys (a null key is a key of its own).  Null and NaN
    values are left out; negative zero counts as zero.
    """
    value = F.col(value_col).cast("double")
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    return (
        df.where(value.isNotNull() & ~F.isnan(value))
        .select(group.alias("g"), (value + F.lit(0.0)).alias("value"))
        .groupBy("g", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_counts(parts: list[DataFrame]) -> DataFrame:
    """Partial results of separate pieces or days as one."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("g", "value").agg(F.sum("n").alias("n"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the running count of each group within it; rows come sorted by group and value."""
    from pyspark import TaskContext

    part, group, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).flatten()
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for key in keys:
            codes = key.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new |= codes[1:] != codes[:-1]
        n = batch.column(2).to_numpy(zero_copy_only=False)
        total = np.cumsum(n)
        first = np.flatnonzero(np.concatenate([[True], new]))
        base = np.concatenate([[0], total])[first]
        if tuple(k[0].as_py() for k in keys) == group:
            base[0] -= before
        upto = total - np.repeat(base, np.diff(np.append(first, len(n))))
        group, before = tuple(k[-1].as_py() for k in keys), int(upto[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(upto, pa.int64())],
            names=["g", "value", "n", "part", "upto"],
        )


def percentiles_of_counts(counts: DataFrame, percentages: list[float]) -> DataFrame:
    """Rows ``(g, n_values, p_<percent> ...)`` from rows ``(g, value, n)``.

    A range partitioning of (group, value) sorts all values; hot groups spread over
    partitions and hot values are single rows already.  Each partition counts its rows
    per group; offsets of groups are sums over partitions, a row for each partition
    and group.  Target positions then name a partition and a place in it, and the
    neighbouring order statistics are interpolated: position ``p * (n - 1)``.
    """
    for p in percentages:
        if not 0 <= p <= 1:
            raise ValueError(f"a percentage must be in [0, 1], got {p}")
    with_place = T.StructType([
        counts.schema["g"], T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("upto", T.LongType()),
    ])
    # Written once: partition numbers must mean the same rows in each later use.
    ordered = keep(
        counts.select("g", "value", F.col("n").cast("long").alias("n"))
        .repartitionByRange("g", "value").sortWithinPartitions("g", "value").mapInArrow(_running, with_place),
        "sorted",
    )
    parts = ordered.groupBy("g", "part").agg(F.max("upto").alias("rows"))
    along = Window.partitionBy("g").orderBy("part")
    spans = parts.select(
        "g", "part", "rows",
        (F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"),
        F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    wanted = []
    for i, p in enumerate(percentages):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            wanted.append(F.struct(F.lit(f"{side}{i}").alias("what"), rank.cast("long").alias("rank")))
    targets = (
        spans.select("g", "part", "before", "rows", F.explode(F.array(*wanted)).alias("t"))
        .where((F.col("t.rank") >= F.col("before")) & (F.col("t.rank") < F.col("before") + F.col("rows")))
        .groupBy("g", "part")
        .agg(F.collect_list(F.struct(F.col("t.what").alias("what"), (F.col("t.rank") - F.col("before")).alias("place"))).alias("ts"))
    )
    hits = (
        ordered.join(targets, ["g", "part"])
        .select("g", "value", F.explode(F.filter("ts", lambda t: (t.place < F.col("upto")) & (t.place >= F.col("upto") - F.col("n")))).alias("t"))
    )
    found = hits.groupBy("g").agg(*[
        F.max(F.when(F.col("t.what") == f"{side}{i}", F.col("value"))).alias(f"{side}{i}")
        for i in range(len(percentages)) for side in ("low", "high")
    ])
    totals = parts.groupBy("g").agg(F.sum("rows").alias("n_values"))
    out = []
    for i, p in enumerate(percentages):
        at = F.lit(float(p)) * (F.col("n_values") - 1)
        part = at - F.floor(at)
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        gap = high - low
        between = F.when(F.abs(gap) < F.lit(float("inf")), low + gap * part).otherwise(low * (F.lit(1.0) - part) + high * part)
        out.append(F.when((part == 0) | (low == high), low).otherwise(between).alias(percent_name(p)))
    return totals.join(found, "g").select("g", "n_values", *out)


def percent_name(p: float) -> str:
    """The column of a percentage: p_50, p_99_9."""
    return "p_" + f"{p * 100:.10g}".replace(".", "_")


def percentiles(df: DataFrame, value_col: str, keys: list[str], percentages: list[float]) -> DataFrame:
    """Rows ``(*keys, n_values, p_50, ...)`` per group, exact.  A group without usable values has no row."""
    found = percentiles_of_counts(value_counts(df, value_col, keys), percentages)
    return found.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in found.columns if c != "g"])
