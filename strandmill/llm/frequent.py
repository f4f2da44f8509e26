"""Most frequent values by iceberg filtering: coarse counts under several hashes, then exact counts of survivors."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import keep

#: Independent hashes, and buckets of each for every value that could reach the share.
HASHES, ROOM = 4, 16

#: Buckets of a hash that may reach the threshold: rows of 4 bytes sent to every task.
MOST_HEAVY = 1_000_000


def _bucket(column: Column, hash_no: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(hash_no), column), F.lit(buckets)).cast("int")


def coarse_counts(df: DataFrame, column: str, buckets: int, hashes: int = HASHES) -> DataFrame:
    """Rows ``(hash_no, bucket, n)``: exact counts of non-null, non-empty values per bucket of each hash.

    At most ``hashes * buckets`` rows, however many values there are.  Tables of
    separate pieces combine by adding ``n``.
    """
    value = F.col(column)
    cells = F.array(*[
        F.struct(F.lit(j).alias("hash_no"), _bucket(value, j, buckets).alias("bucket")) for j in range(hashes)
    ])
    return (
        df.where(value.isNotNull() & (value != ""))
        .select(F.explode(cells).alias("c"))
        .groupBy("c.hash_no", "c.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_values(df: DataFrame, column: str, share: float, hashes: int = HASHES, room: int = ROOM) -> DataFrame:
    """Values that make up at least ``share`` of the rows whose value is neither null nor empty.

    Returns ``(column, n, share)``; the counts are exact and no such value is missed:
    a value's bucket holds at least as many rows as the value.  At most ``1 / share``
    buckets of a hash reach the threshold, and these are all that is broadcast; a share
    below 1 / MOST_HEAVY is an error.  The driver gets one number, the rows in all.  Only
    the survivors are counted, pre-aggregated before their shuffle, so a hot value costs
    one row a task.  An empty table gives no rows; ties at the threshold are kept.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share must be in (0, 1], got {share}")
    if share * MOST_HEAVY < 1:
        raise ValueError(f"a share below {1 / MOST_HEAVY:g} would broadcast too much, got {share}")
    exact = Fraction(str(share))
    buckets = 1 << max(8, math.ceil(math.log2(room / share)))
    cells = keep(coarse_counts(df, column, buckets, hashes), "cells")  # hashes * buckets rows at most
    total = cells.where("hash_no = 0").agg(F.sum("n")).first()[0] or 0
    reaches = F.col("n") * exact.denominator >= F.lit(exact.numerator * total)
    value = F.col(column)
    left = df.select(column).where(value.isNotNull() & (value != ""))
    for j in range(hashes):
        heavy = cells.where((F.col("hash_no") == j) & reaches).select(F.col("bucket").alias("_heavy"))
        left = left.join(F.broadcast(heavy), _bucket(value, j, buckets) == F.col("_heavy"), "left_semi")
    return (
        left.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(reaches)
        .select(column, "n", (F.col("n") / F.lit(float(max(total, 1)))).alias("share"))
    )
