"""Mates by position, as one aggregate instead of a join of two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import first_part


def names_of(reads: DataFrame, keys: list[str] | None = None, separator: str | None = None) -> DataFrame:
    """Rows ``(*keys, record_no, segment, name)``."""
    return reads.select(*(keys or []), "record_no", "segment", first_part(F.col("definition"), separator).alias("name"))


def pair_names(names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows ``(*keys, record_no, name_1, name_2)`` of names_of(); the name of a missing mate is null."""
    keys = keys or []
    return (
        names.where(F.col("segment").isin(0, 1))
        .groupBy(*keys, "record_no")
        .agg(*[F.max(F.when(F.col("segment") == s, F.col("name"))).alias(f"name_{s + 1}") for s in (0, 1)])
    )


def parity(reads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows ``(*keys, first_unmatched, ended)`` of files whose segments differ in records.

    ``ended`` is the segment, 0 or 1, that lacks the first record without a mate.
    """
    keys = keys or []
    records = reads.where(F.col("segment").isin(0, 1)).groupBy(*keys, "record_no").agg(
        F.max(F.when(F.col("segment") == 0, 1).otherwise(0)).alias("has_1"), F.max(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("has_2")
    )
    lone = records.where("has_1 <> has_2").groupBy(*keys) if keys else records.where("has_1 <> has_2").groupBy()
    out = lone.agg(F.min(F.struct("record_no", F.when(F.col("has_1") == 0, 0).otherwise(1).alias("ended"))).alias("m"))
    return out.where(F.col("m").isNotNull()).select(*keys, F.col("m.record_no").alias("first_unmatched"), F.col("m.ended").alias("ended"))
