"""Filters decided by the first segment and applied to all by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import check_allowlist_name
from ..functions.patterns import java_pattern


def filter_names(reads: DataFrame, names: DataFrame, keys: list[str] | None = None, name_col: str = "name") -> DataFrame:
    """Records whose first segment's name is in the list ``names`` (without prefix sign), with all their segments.

    A left semi join, so repeated and null names don't matter; Catalyst broadcasts the
    list if it is small.  A first segment's definition without a name is an error.
    """
    wanted = names.select(F.col(name_col).alias("_id"))
    first = reads.where(F.col("segment") == 0).withColumn("_id", check_allowlist_name(F.col("definition"))).join(wanted, "_id", "left_semi").drop("_id")
    return with_segments(reads, first, keys)


def filter_pattern(reads: DataFrame, pattern: str, keys: list[str] | None = None) -> DataFrame:
    """Records whose first segment's sequence matches the pattern anywhere, with all their segments.

    The pattern's language is that of functions.patterns; a malformed one fails before any plan is made.
    """
    return filter_where(reads, F.col("sequence").rlike(java_pattern(pattern)), keys)


def filter_where(reads: DataFrame, condition: Column, keys: list[str] | None = None) -> DataFrame:
    """Records whose first segment meets any condition, with all their segments."""
    return with_segments(reads, reads.where((F.col("segment") == 0) & condition), keys)


def with_segments(reads: DataFrame, first: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The chosen rows of the first segment and the rows of other segments at their positions."""
    on = [*(keys or []), "record_no"]
    chosen = first.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(on)]).distinct()
    others = reads.where(F.col("segment") != 0)
    met = F.lit(True)
    for i, k in enumerate(on):
        met = met & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    return first.unionByName(others.join(chosen, met, "left_semi"))


def missing_segments(filtered: DataFrame, segments: int, keys: list[str] | None = None) -> DataFrame:
    """Chosen records that lack a segment: an input ended too early."""
    return filtered.groupBy(*(keys or []), "record_no").agg(F.countDistinct("segment").alias("n")).where(F.col("n") < segments)
