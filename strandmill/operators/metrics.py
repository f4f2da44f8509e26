"""Metrics of a file: records, sequence lengths, mean quality per position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quality import SCORE_ZERO, phred_score
from ..plans.runtime import keep

#: Records whose running maximum is found together.
CHUNK = 1 << 20

#: What a batch gives: sums of a position, or at position -1 how many records there are, their lengths, and qualities longer than their sequences.
_SUMS = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("error_sum", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("bad", T.LongType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("longer", T.LongType()),
])


@dataclass(frozen=True)
class Metric:
    """A metric of one's own for describe(): its name and an aggregate over reads."""

    name: str
    column: Column


def lengths(keys: list[str] | None = None) -> list[Column]:
    """Aggregates for any groupBy: records, shortest and longest sequence (null and 0 without records)."""
    n = F.length("sequence").cast("long")
    return [F.count(F.lit(1)).alias("record_count"), F.min(n).alias("min_sequence_length"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_sequence_length")]


def describe_lengths(reads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a file, or one in all."""
    return reads.groupBy(*(keys or [])).agg(*lengths())


def _position_sums(batches: Iterator[pa.RecordBatch], summary: bool, own: bool, skip_invalid: bool) -> Iterator[pa.RecordBatch]:
    """Sums per position of a batch: a row a position instead of a row a base.

    Rows are ``(quality, longest)``.  With ``summary`` the batch's records are told at
    position -1, and qualities beyond ``longest`` are left to the ordered pass unless
    ``own`` has them cut there.  With ``skip_invalid`` a record with a bad byte has no scores.
    """
    table = 10.0 ** (-(np.arange(256) - float(SCORE_ZERO)) / 10.0)
    for whole in batches:
        for at in range(0, whole.num_rows, 20000):
            batch = whole.slice(at, 20000)
            texts = [t.encode("latin-1") for t in batch.column(0).to_pylist()]
            n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            longest = batch.column(1).to_numpy()
            later = (n > longest) & (summary and not own)
            count = np.where(later, 0, np.minimum(n, longest))
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            owner = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(data)) - (np.cumsum(n) - n)[owner]
            inside = pos < count[owner]
            if skip_invalid:
                inside &= (np.bincount(owner[inside & (data < SCORE_ZERO)], minlength=len(n)) == 0)[owner]
            pos, data = pos[inside], data[inside]
            sums, counts, bad = np.bincount(pos, table[data]).astype(np.float64), np.bincount(pos), np.bincount(pos, data < SCORE_ZERO).astype(np.int64)
            none = pa.nulls(len(sums), pa.int64())
            rows = [pa.array(np.arange(len(sums))), pa.array(sums), pa.array(counts), pa.array(bad), none, none, none]
            yield pa.RecordBatch.from_arrays(rows, names=_SUMS.names)
            if summary and len(n):
                told = [-1, None, len(n), None, int(longest.min()), int(longest.max()), int((n > longest).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64() if f.name == "error_sum" else pa.int64()) for x, f in zip(told, _SUMS)], names=_SUMS.names)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("error_sum", "n", "bad")], F.min("low").alias("low"), F.max("high").alias("high"), F.sum("longer").alias("longer"))


def running_longest(reads: DataFrame) -> DataFrame:
    """Each record with ``longest``, the longest sequence so far in order of record_no."""
    return _with_longest(reads, F.length("sequence"))


def _with_longest(reads: DataFrame, length: Column) -> DataFrame:
    """Two levels: maxima of chunks of CHUNK records are carried over a row a chunk; the
    order inside is a window per chunk, so no task has to sort the file.
    """
    rows = reads.withColumn("_chunk", F.floor(F.col("record_no") / CHUNK)).withColumn("_length", length.cast("long"))
    chunks = rows.groupBy("_chunk").agg(F.max("_length").alias("_m"))
    before = chunks.withColumn("_before", F.max("_m").over(Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select("_chunk", "_before")
    within = Window.partitionBy("_chunk").orderBy("record_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_so_far", F.max("_length").over(within)).join(before, "_chunk")
        .withColumn("longest", F.greatest("_so_far", F.coalesce("_before", F.lit(0)))).drop("_chunk", "_length", "_so_far", "_before")
    )


def undecodable(reads: DataFrame) -> DataFrame:
    """Rows ``(record_no,)``: records at which mean_quality() fails, having a byte below the lowest score within the longest sequence so far."""
    ordered = running_longest(reads.select("record_no", "sequence", "quality"))
    return ordered.where(F.substr("quality", F.lit(1), F.col("longest").cast("int")).rlike("[\\x00-\\x20]")).select("record_no")


def _passes(reads: DataFrame, strict: bool | None, skip_invalid: bool) -> DataFrame:
    """Sums per position, and what lies at position -1; see mean_quality().

    One scan has the lengths and all scores of records whose quality isn't longer than
    their sequence.  Only if there are others does a second pass carry these alone, with
    the lengths of all, through the order of the file.
    """
    own = strict is False
    scan = reads.select("quality", F.length("sequence").cast("long").alias("longest"))
    first = keep(_added(scan.mapInArrow(lambda b: _position_sums(b, True, own, skip_invalid), _SUMS)), "positions")
    if own or first.where("pos = -1 AND longer > 0").isEmpty():
        return first
    longer = F.when(F.length("quality") > F.length("sequence"), F.col("quality")).alias("quality")
    carried = _with_longest(reads.select("record_no", F.length("sequence").alias("_bases"), longer), F.col("_bases"))
    rest = carried.where(F.col("quality").isNotNull()).select("quality", "longest").mapInArrow(lambda b: _position_sums(b, False, True, skip_invalid), _SUMS)
    return keep(_added(first.unionByName(rest)), "positions")


def _mean_quality(sums: DataFrame) -> DataFrame:
    positions = sums.where("pos = -1 AND high > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("pos"))
    checked = F.when(F.col("bad") > 0, F.raise_error(F.lit("invalid quality score"))).otherwise(F.col("error_sum"))
    return positions.join(sums.where("pos >= 0").select("pos", "error_sum", "n", "bad"), "pos", "left").select(
        F.col("pos").alias("position"), F.when(F.col("n").isNull(), F.lit(float("nan"))).otherwise(phred_score(checked / F.col("n"))).alias("mean_quality")
    )


def mean_quality(reads: DataFrame, strict: bool | None = None, skip_invalid: bool = False) -> DataFrame:
    """Rows ``(position, mean_quality)``: error probabilities averaged per position, then as a score.

    Positions run to the longest sequence; one that no quality reaches is NaN.  A
    quality counts as far as the longest sequence so far.  Only a quality longer than
    its own sequence is affected, so the ordered pass is made only if there is one, and
    carries no other (``strict`` False cuts all at their own sequences instead).  A byte
    below the lowest score is an error; with ``skip_invalid`` the scores of its record
    are left out instead, while its sequence still counts.  No records give no rows.
    """
    return _mean_quality(_passes(reads, strict, skip_invalid))


def describe(reads: DataFrame, skip_invalid: bool = False, more: list[Metric] | None = None) -> DataFrame:
    """One row: the lengths and the array ``avg_quality_score_per_position`` (see mean_quality()), from one scan.

    Metrics of one's own (``more``) are columns of the same row, from a scan of theirs.
    """
    sums = _passes(reads, None, skip_invalid)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("position", "mean_quality"))), lambda x: x["mean_quality"])
    parts = [
        sums.where("pos = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.min("low").alias("min_sequence_length"), F.coalesce(F.max("high"), F.lit(0)).alias("max_sequence_length")),
        _mean_quality(sums).agg(scores.alias("avg_quality_score_per_position")),
    ]
    if more:
        parts.append(reads.agg(*[m.column.alias(m.name) for m in more]))
    names = [c for p in parts for c in p.columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)  # a row a part, each with the others' columns null
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
