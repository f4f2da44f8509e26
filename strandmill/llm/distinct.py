"""Distinct counts by hash-range decomposition, exact within each range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Disjoint hash ranges; counts of ranges add up because a value lies in one range.  As many tasks can share the work.
BUCKETS = 1 << 16

#: Rows of the input put together before the shuffle.
LOCAL_ROWS = 1 << 17

#: What stands for a value: 128 bits of it.  Two of n values have the same with a chance of n * n / 2**129.
_VALUE = ["field", "bucket", "h1", "h2"]


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Equal rows of a piece of the input as one, with their number."""
    held: list[pa.RecordBatch] = []
    n = 0

    def counted() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        names = [c for c in whole.column_names if c != "n"]
        yield from whole.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"]).select(whole.column_names).cast(whole.schema).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from counted()
            held, n = [], 0
    if n:
        yield from counted()


def _by_bucket(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows once each with the sum of their numbers, a bucket's rows together: the one shuffle of all values."""
    return rows.repartition("bucket").groupBy(*_VALUE, *keys).agg(F.sum("n").alias("n"))


def distinct_pairs(df: DataFrame, fields: list[str], keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows ``(field, bucket, h1, h2, *keys, n)``: each value once per field and group, with its rows.

    The partial result: tables of separate days or pieces combine with merge_pairs().
    Null and empty values count nowhere; a null key is a key of its own.  Values travel
    as numbers of 128 bits, in one shuffle by bucket; equal rows of a piece of the
    input are put together before it, so a hot value or group sends a row a piece.
    """
    clash = {*_VALUE, "n"} & set(keys)
    if clash:
        raise ValueError(f"keys named like columns of the result: {', '.join(sorted(clash))}")
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = (
        df.select(*keys, F.explode(values).alias("_p")).where(F.col("_p.value").isNotNull() & (F.col("_p.value") != ""))
        .select(F.col("_p.field").alias("field"), F.xxhash64("_p.value").alias("h1"), F.xxhash64(F.lit("second"), F.col("_p.value")).alias("h2"), *keys)
        .select("field", F.pmod("h1", F.lit(buckets)).cast("int").alias("bucket"), "h1", "h2", *keys, F.lit(1).cast("long").alias("n"))
    )
    # Without nullability, which grouping in Arrow doesn't carry.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return _by_bucket(rows.mapInArrow(lambda b: _together(b, LOCAL_ROWS), schema), keys)


def merge_pairs(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The pairs of several partial results together; also of one that was stored and is read again."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return _by_bucket(both, keys)


def count_groups(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(*keys, field, n_values, n_distinct)`` over the pairs' own keys: counted in each bucket, where a bucket's pairs lie together, and added up."""
    return (
        pairs.groupBy("field", "bucket", *keys)
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
        .groupBy(*keys, "field")
        .agg(F.sum("n").alias("n_values"), F.sum("d").alias("n_distinct"))
    )


def count_combinations(pairs: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts for each list of keys in ``sets``: ``(grouping, *all keys, field, n_values, n_distinct)``.

    ``grouping`` names the keys of a row, joined by commas; the other keys are null.
    All combinations are counted inside a bucket, where its pairs lie together as
    distinct_pairs() and merge_pairs() leave them, so coarser groups drop repeats without
    moving rows; what moves are counts.  The pairs of a hot value are no more than there
    are groups.
    """
    every = list(dict.fromkeys(k for s in sets for k in s))
    types = dict(pairs.dtypes)
    views = F.array(*[
        F.struct(F.lit(i).alias("set_no"), *[(F.col(k) if k in s else F.lit(None).cast(types[k])).alias(k) for k in every])
        for i, s in enumerate(sets)
    ])
    counted = (
        pairs.select(*_VALUE, "n", F.explode(views).alias("_g"))
        .groupBy(*_VALUE, "_g")
        .agg(F.sum("n").alias("n"))
        .groupBy("field", "_g")
        .agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    )
    labels = F.array(*[F.lit(",".join(s)) for s in sets])
    return counted.select(
        F.element_at(labels, F.col("_g.set_no") + 1).alias("grouping"), *[F.col(f"_g.{k}").alias(k) for k in every], "field", "n_values", "n_distinct"
    )
