"""Schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.bytestrings import from_bytes

#: The four lines of a record.
LINES = ["definition", "sequence", "plus_line", "quality"]

#: One record of a file; texts are in byte form.  Order is in ``record_no``, never in the rows.
READS = T.StructType([
    T.StructField("record_no", T.LongType(), False),
    T.StructField("segment", T.IntegerType(), False),
    *[T.StructField(name, T.StringType(), False) for name in LINES],
])


def as_reads(df: DataFrame) -> DataFrame:
    """Rows of a UTF-8 table with the lines in byte form; a missing line is an empty one."""
    return df.withColumns({c: F.coalesce(from_bytes(F.col(c)), F.lit("")) for c in LINES})


def records(spark: SparkSession, rows: list[tuple], segment: int = 0) -> DataFrame:
    """A small table of reads from (definition, sequence, plus_line, quality) rows, numbered in order."""
    return spark.createDataFrame([(i, segment, *row) for i, row in enumerate(rows)], READS)


def line_no(record_no: Column, line: Column) -> Column:
    """The 1-based line of a file for a record's line 0 to 3."""
    return record_no * 4 + line + 1
