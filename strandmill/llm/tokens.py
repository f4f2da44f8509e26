"""Encoding of a text column with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe

#: Rows encoded at once, to bound a worker's memory.
ROWS = 2000


def _vocabulary(df: DataFrame, path: str | None):
    """The rank file, sent to each executor once: under a megabyte, whatever the data."""
    data, key = bpe.read_vocabulary(path)
    return df.sparkSession.sparkContext.broadcast(data), key


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row ``(id_col, ids)`` per row of ``df``: the text's token ids without special tokens.

    An empty and a null text give an empty list.  Strings that look like special
    tokens are ordinary text.  Null and repeated ids are kept as they lie; other
    columns aren't read.  A narrow map, each text in one pass, in the input's partitions.
    """
    shared, key = _vocabulary(df, vocabulary)
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.encoder(shared.value, key)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values, offsets = model.encode_texts([x or "" for x in part.column(1).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).alias("ids")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None,
                 count_col: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the token count of each row's text (0 for a null or empty one)."""
    shared, key = _vocabulary(df, vocabulary)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(count_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.encoder(shared.value, key)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = model.count_texts([x or "" for x in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, count_col])

    return df.select(*keep, F.col(text_col).alias(count_col)).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Rows ``(id_col, bytes)``: what each row's ``ids`` stand for; an empty or null list stands for no bytes."""
    shared, key = _vocabulary(encoded, vocabulary)
    schema = T.StructType([encoded.schema[id_col], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.encoder(shared.value, key)
        for batch in batches:
            texts = [model.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=schema.names)

    return encoded.select(F.col(id_col), F.col("ids").alias("bytes")).mapInArrow(run, schema)
