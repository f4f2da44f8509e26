"""Name lists, lint logs, and raw copies of files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestrings import from_bytes
from ..operators.parsing import assemble
from . import files
from .fastq import CHUNK_BYTES


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a plain text file as ``name``, in byte form; an empty line is an empty name.

    Only LF ends a line, and one CR before it is dropped.  The list is never taken for
    compressed, whatever its extension, and must be UTF-8.
    """
    if path.lower().endswith((".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")):
        raw = _stored_lines(spark, path)  # Spark's reader would decompress by extension
    else:
        raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    valid = F.is_valid_utf8(F.col("value").cast("string"))
    checked = F.when(valid, from_bytes(F.col("value"))).otherwise(F.raise_error(F.lit("invalid name list: not UTF-8")))
    return raw.select(F.regexp_replace(checked, r"\r\z", "").alias("name")).distinct()


def _stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(value,)``: the lines of a file's stored bytes, read as a stream by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored in batch.column(0).to_pylist():
                held = b""
                with files.open_stored(stored) as f:
                    while data := f.read(CHUNK_BYTES):
                        lines = (held + data).split(b"\n")
                        held = lines.pop()
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["value"])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, "value binary")


def read_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows ``(path, line_no, line_text)``: the records of lint logs, for parse_lines().

    Quote-aware (see assemble()): a line feed inside an open quote stays in its record, so
    a file is one task, read as a stream.  Only LF ends a line; ``line_no`` is the record's, from 0.
    A log must be UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with io.TextIOWrapper(files.open_text(path), encoding="utf-8", newline="\n") as f:
                    held, n = [], 0
                    for record in assemble(line.removesuffix("\n") for line in f):
                        held.append(record)
                        if len(held) == _RECORDS:
                            yield _log_rows(path, n, held)
                            held, n = [], n + len(held)
                    if held:
                        yield _log_rows(path, n, held)

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, len(paths)), "path").mapInArrow(run, "path string, line_no long, line_text string")


_RECORDS = 5000


def _log_rows(path: str, first: int, texts: list[str]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(texts)], names=["path", "line_no", "line_text"])


def copy_bytes(source: str, target: str) -> None:
    """Copies stored bytes as they are, without decoding, even if the extensions differ."""
    with files.open_stored(source) as f, files.open_new(target) as g:
        while data := f.read(CHUNK_BYTES):
            g.write(data)
