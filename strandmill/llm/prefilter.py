"""A map of bits that keeps most rows that can't match out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map; its words, at most MAP_BITS / 64 = 131,072 rows of 16 bytes, are all that is ever broadcast.
MAP_BITS = 1 << 23


def _word(number: Column) -> Column:
    return F.shiftright(F.pmod(number, F.lit(MAP_BITS)).cast("long"), 6)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))


def may_match(df: DataFrame, number: Column, wanted: DataFrame, wanted_number: str) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``number`` may be among those of ``wanted``; none that is is lost.

    One scan, no shuffle of ``df``.  The map has a fixed size, whatever the data; the more
    numbers there are, the more rows pass in vain, so an exact join has to follow.
    A null number matches nothing.
    """
    asked = wanted.select(F.col(wanted_number).alias("n")).where("n IS NOT NULL")
    words = asked.select(_word(F.col("n")).alias("_map_word"), _bit(F.col("n")).alias("_map_bit")).groupBy("_map_word").agg(F.bit_or("_map_bit").alias("_map_bits"))
    met = df.withColumn("_map_number", number).join(F.broadcast(words), _word(F.col("_map_number")) == F.col("_map_word"))
    return met.where(F.col("_map_bits").bitwiseAND(_bit(F.col("_map_number"))) != 0).select(*df.columns)
