"""Has this key been seen before?  Sealed partitions of fingerprints behind minimal perfect hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import keep, new_folder, shuffle_partitions, tend
from .perfect_hash import SealedPartition
from .prefilter import may_match

#: Keys of an open batch, which an exact set holds before it is sealed.
SEAL_KEYS = 4096

#: Sealed partitions that a hash range is meant to come to: what a key is compared with at most.
RANGE_PARTITIONS = 8

#: Pieces, as days, that one call takes one after the other.
MOST_PIECES = 10_000

#: How a repeated row was recognised: in one piece of the input, in the open batch, by a sealed partition's fingerprint.
LOCAL, BATCH, SEALED = 0, 1, 2
#: Kinds of rows that aren't answers: a key's first row so far; a stored sealed partition.
FIRST, STORED = -1, -2

#: A stored sealed partition and the range it belongs to, of how many.  A row without a partition only tells their number.
INDEX = T.StructType([
    T.StructField("range_no", T.IntegerType()),
    T.StructField("ranges", T.IntegerType()),
    T.StructField("blob", T.BinaryType()),
])
_ROWS = T.StructType([
    T.StructField("range_no", T.IntegerType()),
    T.StructField("ranges", T.IntegerType()),
    T.StructField("blob", T.BinaryType()),
    T.StructField("ord", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("h1", T.LongType()),
    T.StructField("h2", T.LongType()),
    T.StructField("how", T.IntegerType()),
])
_NAMES = [f.name for f in _ROWS]
_ARROW = pa.schema([
    ("range_no", pa.int32()), ("ranges", pa.int32()), ("blob", pa.binary()), ("ord", pa.int64()), ("key", pa.string()),
    ("h1", pa.int64()), ("h2", pa.int64()), ("how", pa.int32()),
])


def ranges_for(keys: int, seal_keys: int = SEAL_KEYS) -> int:
    """Hash ranges for so many keys: each comes to about RANGE_PARTITIONS sealed partitions, so the work grows with the keys alone."""
    return max(1, math.ceil(keys / (seal_keys * RANGE_PARTITIONS)))


def _codes(keys: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal keys; exact."""
    return keys.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int, by_range: bool) -> Iterator[tuple[pa.Table, bool]]:
    """The rows in order, ``rows`` at a time and of one range if asked, and whether a new range begins."""
    held: list[pa.RecordBatch] = []
    n, current, new = 0, None, True

    for whole in batches:
        if not whole.num_rows:
            continue
        cuts = [0, whole.num_rows]
        if by_range:
            at = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), whole.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            batch = whole.slice(first, last - first)
            if by_range and (number := int(at[first])) != current:
                if n:
                    yield pa.Table.from_batches(held), new
                held, n, current, new = [], 0, number, True
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield pa.Table.from_batches(held), new
                    held, n, new = [], 0, False
    if n:
        yield pa.Table.from_batches(held), new


def _locally(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Within a piece of the input only a key's earliest row has to travel on; the others are known to be repeats."""
    for chunk, _ in _chunks(batches, rows, False):
        order = chunk.column("ord").to_numpy()
        codes = _codes(chunk.column("key"))
        by = np.lexsort((order, codes))
        repeat = np.zeros(len(by), dtype=bool)
        repeat[by[1:]] = codes[by[1:]] == codes[by[:-1]]
        # Answers lie anywhere: they go by their order, so that a hot key's don't meet in one range.
        number = np.where(repeat, order % chunk.column("ranges").to_numpy(), chunk.column("range_no").to_numpy()).astype(np.int32)
        keys = chunk.column("key").take(pa.array(np.arange(len(by)), mask=repeat))
        how = pa.array(np.where(repeat, LOCAL, FIRST).astype(np.int32))
        yield from pa.table(
            [pa.array(number), chunk.column("ranges"), chunk.column("blob"), chunk.column("ord"), keys, chunk.column("h1"), chunk.column("h2"), how], schema=_ARROW
        ).combine_chunks().to_batches()


def _in_order(batches: Iterator[pa.RecordBatch], seal_keys: int, emit_sealed: bool) -> Iterator[pa.RecordBatch]:
    """Answers for rows that come by range and order, keeping sealed partitions instead of their keys."""
    sealed: list[SealedPartition] = []
    open_: tuple[np.ndarray, np.ndarray] | None = None  # the last batch's keys, sealed once another follows

    def seal(keys: np.ndarray, prints: np.ndarray) -> SealedPartition:
        keys, at = np.unique(keys, return_index=True)
        return SealedPartition.seal(keys, prints[at])

    for chunk, new in _chunks(batches, seal_keys, True):
        if new:
            sealed, open_ = [], None
        elif open_ is not None:
            sealed.append(seal(*open_))
            open_ = None
        how = chunk.column("how").to_numpy()
        stored = chunk.filter(pa.array(how == STORED))
        if stored.num_rows:
            if (stored.column("ranges").to_numpy() != chunk.column("ranges")[0].as_py()).any():
                raise ValueError("the index is scattered over another number of ranges")
            sealed += [SealedPartition.from_bytes(blob) for blob in stored.column("blob").to_pylist()]
        local = how == LOCAL
        if local.any():
            yield from chunk.filter(pa.array(local)).combine_chunks().to_batches()
        rows = chunk.filter(pa.array(how == FIRST))
        if not rows.num_rows:
            continue
        codes = _codes(rows.column("key"))
        _, first = np.unique(codes, return_index=True)
        how = np.full(rows.num_rows, BATCH, dtype=np.int32)
        how[first] = FIRST
        keys = rows.column("h1").to_numpy()[first].astype(np.uint64)
        prints = (rows.column("h2").to_numpy()[first].astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
        known = np.zeros(len(first), dtype=bool)
        for partition in sealed:
            known |= partition.holds(keys, prints)
        how[first[known]] = SEALED
        if not known.all():
            if emit_sealed:
                made = seal(keys[~known], prints[~known])
                sealed.append(made)
                yield pa.RecordBatch.from_pylist(
                    [{"range_no": rows.column("range_no")[0].as_py(), "ranges": rows.column("ranges")[0].as_py(), "blob": made.to_bytes(), "how": STORED}], schema=_ARROW
                )
            else:
                open_ = keys[~known], prints[~known]
        answers = np.flatnonzero(how != FIRST)
        if len(answers):
            found = rows.take(pa.array(answers))
            found = found.set_column(7, "how", pa.array(how[answers]))
            # A key is named only where an exact check has to follow.
            names = rows.column("key").take(pa.array(answers, mask=how[answers] != SEALED))
            yield from found.set_column(4, "key", names).combine_chunks().to_batches()


def _key(key_col: str) -> F.Column:
    return F.col(key_col).cast("string")


def _asked(df: DataFrame, key_col: str, order_cols: list[str]) -> DataFrame:
    """Rows that ask: of a key that is neither null nor empty, and with an order."""
    met = _key(key_col).isNotNull() & (_key(key_col) != "")
    for c in order_cols:
        met = met & F.col(c).isNotNull()
    return df.where(met)


def seen_candidates(df: DataFrame, key_col: str, order_col: str, ranges: int, index: DataFrame | None = None,
                    seal_keys: int = SEAL_KEYS, emit_sealed: bool = False) -> DataFrame:
    """Rows ``(range_no, ranges, blob, ord, key, h1, h2, how)`` whose key seems to have come before, by order.

    ``how`` is LOCAL or BATCH where exact sets decided, SEALED where a fingerprint did
    (then ``key`` is given).  ``index`` holds sealed partitions of earlier runs (see
    new_index()), scattered over as many ranges as ``ranges``; another number in its
    rows is an error.  With ``emit_sealed`` the partitions of this run come out too, as
    rows of how STORED (see sealed_rows()).  An empty table gives none.

    Keys are scattered by hash over ``ranges``, which lie together in tasks and are
    read one after the other, each by order; at its end a range's partitions are dropped.
    So a task holds an open batch and a range's sealed keys, about 5 bytes each.
    Repeats within a piece of ``seal_keys`` rows of the input are told before the
    shuffle, so a hot key sends a row a piece to its range.
    """
    tasks = shuffle_partitions(df.sparkSession)
    number = F.pmod(F.xxhash64(F.lit("range"), _key(key_col)), F.lit(ranges)).cast("int")
    keyed = _asked(df, key_col, [order_col]).select(
        number.alias("range_no"), F.lit(ranges).alias("ranges"), F.lit(None).cast("binary").alias("blob"), F.col(order_col).cast("long").alias("ord"),
        _key(key_col).alias("key"), F.xxhash64(_key(key_col)).alias("h1"), F.xxhash64(F.lit("print"), _key(key_col)).alias("h2"), F.lit(FIRST).alias("how"),
    )
    rows = keyed.mapInArrow(lambda b: _locally(b, seal_keys), _ROWS)
    if index is not None:
        stored = index.where(F.col("blob").isNotNull()).select("range_no", "ranges", "blob").withColumn("how", F.lit(STORED))
        # An index of another number of ranges has to be found out in each range that is read.
        wrong = F.col("ranges") != F.lit(ranges)
        stored = stored.withColumn("ranges", F.when(wrong, F.raise_error(F.lit("the index is scattered over another number of ranges"))).otherwise(F.col("ranges")))
        rows = rows.unionByName(stored, allowMissingColumns=True).select(*_NAMES)
    placed = rows.repartitionById(tasks, F.pmod(F.col("range_no"), F.lit(tasks))).sortWithinPartitions(F.col("range_no"), F.col("ord").asc_nulls_first())
    return placed.mapInArrow(lambda b: _in_order(b, seal_keys, emit_sealed), _ROWS)


def new_index(spark: SparkSession, ranges: int) -> DataFrame:
    """An index without keys; its one row tells the number of ranges, as do all rows added to it."""
    return spark.createDataFrame([(None, ranges, None)], INDEX)


def index_ranges(index: DataFrame) -> int:
    """Over how many ranges an index is scattered, from its rows."""
    found = [r.ranges for r in index.select("ranges").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("an index must tell one number of ranges" if found else "an index has a row at least; start from new_index()")
    return found[0]


def sealed_rows(candidates: DataFrame) -> DataFrame:
    """The sealed partitions of a run with ``emit_sealed``, to be added to its index."""
    return candidates.where(F.col("how") == STORED).select(*INDEX.names)


def exact_repeats(asked: DataFrame, df: DataFrame, key_col: str, order_cols: list[str]) -> DataFrame:
    """The fingerprints' answers ``asked`` (``_key`` and ``order_cols``) with ``wrong``: whether the row is after all its key's first.

    The exact check after the method: only rows of ``df`` whose key is in question are
    grouped.  A map of their hashes holds back nearly all others before any shuffle.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    keys = asked.select("_key").distinct()
    rows = _asked(df, key_col, order_cols).select(_key(key_col).alias("_key"), order.alias("_order"))
    marked = asked.select(F.xxhash64("_key").alias("_hash"))
    in_question = may_match(rows, F.xxhash64("_key"), marked, "_hash").join(keys, "_key")  # a semi join would be pushed below the map
    firsts = in_question.groupBy("_key").agg(F.min("_order").alias("_first"))
    return asked.join(firsts, "_key", "left").select(*order_cols, (order <= F.col("_first")).alias("wrong"))


def _sealed(candidates: DataFrame, order_col: str) -> DataFrame:
    return candidates.where(F.col("how") == SEALED).select(F.col("key").alias("_key"), F.col("ord").alias(order_col))


def _ranges(df: DataFrame, seal_keys: int) -> int:
    """Ranges for all rows: as many keys there are at most, and counting them reads no key."""
    return ranges_for(df.count(), seal_keys)


def seen_before(df: DataFrame, key_col: str, order_col: str, seal_keys: int = SEAL_KEYS) -> DataFrame:
    """One row ``(order_col,)`` for each row of ``df`` whose key an earlier row has.

    Null and empty keys and rows without order are asked nothing and answer nothing.
    ``order_col`` should be unique; of rows tied in key and order all but one repeat.
    """
    ranges = _ranges(df, seal_keys)
    df = df.withColumn(order_col, F.col(order_col).cast("long"))
    candidates = keep(seen_candidates(df, key_col, order_col, ranges, seal_keys=seal_keys).select("ord", "key", "how"), "seen")
    sure = candidates.where(F.col("how") != SEALED).select(F.col("ord").alias(order_col))
    checked = exact_repeats(_sealed(candidates, order_col), df, key_col, [order_col]).where(~F.col("wrong"))
    return sure.unionByName(checked.select(order_col))


def seen_by_piece(df: DataFrame, key_col: str, order_col: str, piece_col: str, ranges: int, seal_keys: int = SEAL_KEYS) -> DataFrame:
    """Rows ``(piece_col, order_col)`` whose key a row of an earlier piece, or an earlier row of the same one, has.

    Pieces, as days, come one after the other, each once; of all pieces before, only the
    stored index is read: sealed partitions, written as each piece ends.  A null piece
    comes first, as a piece without a name.  The exact check reads the keys at rest.
    """
    spark = df.sparkSession
    df = df.withColumn(order_col, F.col(order_col).cast("long"))
    pieces = sorted((r[0] for r in _asked(df, key_col, [order_col]).select(piece_col).distinct().limit(MOST_PIECES + 1).collect()), key=lambda x: (x is not None, x))
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    kind, store = df.schema[piece_col].dataType, new_folder(spark, "seen")
    schema = T.StructType([*INDEX.fields, T.StructField("ord", T.LongType()), T.StructField("key", T.StringType()), T.StructField("how", T.IntegerType()), T.StructField("piece", kind), T.StructField("stored", T.BooleanType())])
    # One folder, to which each piece adds its answers and its sealed partitions: the plan of a piece is the same for all.
    told = new_index(spark, ranges).withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema[3:-1]} | {"stored": F.lit(True)})
    told.write.partitionBy("stored").parquet(store)
    read = lambda stored: spark.read.schema(schema).parquet(store).where(F.col("stored") == stored)
    for piece in pieces:
        of_piece = F.col(piece_col).isNull() if piece is None else F.col(piece_col) == F.lit(piece)
        rows = seen_candidates(df.where(of_piece), key_col, order_col, ranges, read(True), seal_keys, emit_sealed=True).drop("h1", "h2")
        rows.withColumns({"piece": F.lit(piece).cast(kind), "stored": F.col("how") == STORED}).write.mode("append").partitionBy("stored").parquet(store)
    found = tend(spark.read.schema(schema).parquet(store), store).where(~F.col("stored")).select(F.col("piece").alias("_piece"), F.col("ord").alias("_ord"), F.col("key").alias("_key"), "how")
    sure = found.where(F.col("how") != SEALED).select(F.col("_piece").alias(piece_col), F.col("_ord").alias(order_col))
    # A null piece has a place in the order too: the first.
    place = lambda p: F.struct(p.isNotNull().alias("named"), p.alias("piece"))
    asked = found.where(F.col("how") == SEALED).select("_key", place(F.col("_piece")).alias("_piece"), "_ord")
    rows = df.withColumns({"_piece": place(F.col(piece_col)), "_ord": F.col(order_col)})
    checked = exact_repeats(asked, rows, key_col, ["_piece", "_ord"]).where(~F.col("wrong"))
    return sure.unionByName(checked.select(F.col("_piece.piece").alias(piece_col), F.col("_ord").alias(order_col)))


def error_report(df: DataFrame, key_col: str, order_col: str, seal_keys: int = SEAL_KEYS) -> DataFrame:
    """One row: lookups, answers by kind, wrong answers as measured, their rate and the rate to expect.

    The kinds depend on how the input lies in pieces; their sum less the wrong answers doesn't.
    """
    ranges = _ranges(df, seal_keys)
    df = df.withColumn(order_col, F.col(order_col).cast("long"))
    candidates = keep(seen_candidates(df, key_col, order_col, ranges, seal_keys=seal_keys).select("ord", "key", "how"), "seen")
    lookups = _asked(df, key_col, [order_col]).agg(F.count(F.lit(1)).alias("lookups"))
    kinds = candidates.agg(*[
        F.count(F.when(F.col("how") == k, 1)).alias(n) for k, n in ((LOCAL, "exact_in_piece"), (BATCH, "exact_in_batch"), (SEALED, "by_fingerprint"))
    ])
    wrong = exact_repeats(_sealed(candidates, order_col), df, key_col, [order_col]).agg(F.count(F.when(F.col("wrong"), 1)).alias("wrong_answers"))
    parts = lookups.unionByName(kinds, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True)
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).select(
        "*",
        F.when(F.col("lookups") > 0, F.col("wrong_answers") / F.col("lookups")).otherwise(F.lit(0.0)).alias("measured_rate"),
        F.lit(2.0**-32).alias("expected_rate_per_partition"),
    )
