"""FASTQ files as a Spark data source: record framing, splits and one ordered output file.

A record is the next four lines, whatever they hold, so a file can't be entered at
any place without knowing the line's number.  Plain files are cut into byte ranges;
their line feeds are counted in parallel, and prefix sums give each range its first
line.  ``record_no`` falls out of the scan; nothing is shuffled.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..plans.runtime import ship
from ..schema import LINES, READS
from . import files

#: Bytes of a split, read at once, and records of a batch.
SPLIT_BYTES, CHUNK_BYTES, BATCH_RECORDS = 64 << 20, 4 << 20, 8192

#: Ranges whose line feeds the driver counts at a time, and tasks that put parts together.
THREADS, MOST_TASKS = 8, 1024

TRUNCATED = "unexpected end of file: a record is cut off"

_RECORDS = pa.schema([("record_no", pa.int64()), ("segment", pa.int32()), *[(name, pa.string()) for name in LINES]])


def count_feeds(path: str, start: int, stop: int) -> int:
    """Line feeds in a range of stored bytes."""
    feeds = 0
    with files.open_stored(path) as f:
        f.seek(start)
        while start < stop:
            data = f.read(min(CHUNK_BYTES, stop - start))
            if not data:
                break
            feeds += data.count(b"\n")
            start += len(data)
    return feeds


def count_lines(path: str) -> int:
    """Line feeds of the decompressed file."""
    feeds = 0
    with files.open_text(path) as f:
        while data := f.read(CHUNK_BYTES):
            feeds += data.count(b"\n")
    return feeds


def ranges_of(path: str, split_bytes: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Byte ranges of a file; a compressed one is read whole, as gzip can't be entered midway."""
    size = files.size(path)
    if files.is_gzip(path) or size <= split_bytes:
        return [(0, size)]
    return [(at, min(size, at + split_bytes)) for at in range(0, size, split_bytes)]


@dataclass
class FastqSplit(InputPartition):
    """A range of a file: the line that holds its first byte, and whether that line began before."""

    path: str
    start: int
    stop: int
    line: int
    last: bool


def plan_splits(path: str, ranges: list[tuple[int, int]], feeds: list[int]) -> list[FastqSplit]:
    """Splits with their first lines from the line feeds of each range."""
    out, line = [], 0
    for i, ((start, stop), n) in enumerate(zip(ranges, feeds)):
        out.append(FastqSplit(path, start, stop, line, i == len(ranges) - 1))
        line += n
    return out


def _lines(stream: BinaryIO) -> Iterator[bytes]:
    """Lines without their line feed; a last one that lacks it is an error."""
    held = b""
    while data := stream.read(CHUNK_BYTES):
        lines = (held + data).split(b"\n")
        held = lines.pop()
        yield from lines
    if held:
        raise EOFError(TRUNCATED)


def read_split(split: FastqSplit, strict: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """The records that begin in a split.  A cut-off record at the file's end is an error unless ``strict`` is off."""
    whole = split.start == 0 and split.last
    line, at = split.line, split.start
    with files.open_text(split.path) if whole else files.open_stored(split.path) as f:
        if at:
            f.seek(at - 1)
            if f.read(1) != b"\n":  # the range begins inside a line, which belongs to the range before
                at += _skip(f)
                line += 1
        record: list[bytes] = []
        try:
            for text in _lines(f):
                if not record and not whole and at >= split.stop:
                    return
                at += len(text) + 1
                if record or line % 4 == 0:
                    record.append(text.removesuffix(b"\r"))
                line += 1
                if len(record) == 4:
                    yield line // 4 - 1, record
                    record = []
            if record:
                raise EOFError(TRUNCATED)
        except EOFError:
            if strict:
                raise


def _skip(f: BinaryIO) -> int:
    """Moves behind the next line feed; bytes passed."""
    passed = 0
    while data := f.read(1 << 16):
        found = data.find(b"\n")
        if found >= 0:
            f.seek(f.tell() - len(data) + found + 1)
            return passed + found + 1
        passed += len(data)
    return passed


def _batches(records: Iterable[tuple[int, list[bytes]]], segment: int) -> Iterator[pa.RecordBatch]:
    numbers: list[int] = []
    columns: list[list[str]] = [[] for _ in LINES]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([segment] * len(numbers), pa.int32()), *[pa.array(c, pa.string()) for c in columns]], schema=_RECORDS
        )

    for number, lines in records:
        numbers.append(number)
        for column, line in zip(columns, lines):
            column.append(line.decode("latin-1"))
        if len(numbers) >= BATCH_RECORDS:
            yield batch()
            numbers, columns = [], [[] for _ in LINES]
    if numbers:
        yield batch()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.segment = int(options.get("segment", 0))
        self.strict = options.get("strict", "true").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.feeds = json.loads(options["linefeeds"]) if "linefeeds" in options else None

    def partitions(self) -> list[FastqSplit]:
        ranges = ranges_of(self.path, self.split_bytes)
        feeds = self.feeds
        if feeds is None:  # read_fastq() has them counted by tasks; loaded by the format's name alone, the driver counts
            with ThreadPoolExecutor(THREADS) as pool:
                feeds = list(pool.map(lambda r: count_feeds(self.path, *r), ranges)) if len(ranges) > 1 else [0]
        return plan_splits(self.path, ranges, feeds)

    def read(self, split: FastqSplit) -> Iterator[pa.RecordBatch]:
        return _batches(read_split(split, self.strict), self.segment)


@dataclass
class WrittenPart(WriterCommitMessage):
    part: int
    path: str | None
    size: int = 0


class FastqWriter(DataSourceArrowWriter):
    """Each task writes a part beside the target; the commit joins them in order.

    Parts of a compressed file are gzip members, which follow each other validly.  With
    the option ``parts`` the target is a folder: its parts stay, and the commit writes
    their order and sizes to MANIFEST, without which the folder isn't complete.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.parts = options.get("parts", "false").lower() == "true"
        self.gzip = files.is_gzip(options.get("as", self.path))
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenPart:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        name = f"{self.run}.{part}.{context.taskAttemptId()}"
        path = f"{self.path}/{name}" if self.parts else f"{self.path}.{name}"
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                if self.parts:
                    files.make_folder(self.path)
                stored = files.open_new(path)
                out = gzip.GzipFile(fileobj=stored, mode="wb", mtime=0) if self.gzip else stored
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in LINES))
            out.write("".join(f"{a}\n{b}\n{c}\n{d}\n" for a, b, c, d in rows).encode("latin-1"))
        if out is None:
            return WrittenPart(part, None)
        out.close()
        if out is not stored:
            stored.close()
        return WrittenPart(part, path, files.size(path))

    def commit(self, messages: list[WrittenPart | None]) -> None:
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.part)
        if self.parts:
            files.make_folder(self.path)
            with files.open_new(f"{self.path}/{MANIFEST}") as f:
                f.write(json.dumps([[m.path, m.size] for m in parts]).encode())
            return
        join_parts([m.path for m in parts], self.path, self.gzip)
        for m in parts:
            files.remove(m.path)

    def abort(self, messages: list[WrittenPart | None]) -> None:
        for message in messages:
            if message and message.path:
                files.remove(message.path)


#: Names the parts of a folder in order, each with its size.
MANIFEST = "_parts.json"


def join_parts(parts: list[str], target: str, compressed: bool) -> None:
    """Puts the parts together beside the target, which is replaced in one step; on a failure it stays as it was, and the parts stay."""
    beside = f"{target}.{uuid.uuid4().hex}.new"
    try:
        with files.open_new(beside) as out:
            for part in parts:
                with files.open_stored(part) as source:
                    while data := source.read(CHUNK_BYTES):
                        out.write(data)
            if not parts and compressed:
                out.write(gzip.compress(b"", mtime=0))
        files.replace(beside, target)
    finally:
        files.remove(beside)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)`` and ``df.write.format("fastq").mode("append").save(path)``.

    Options: segment, splitBytes, strict (false: a cut-off record at the end is left
    out), lineFeeds (of each split, where they're known already); for writing, parts (true:
    a folder of ordered parts) and as (a name whose extension tells whether to compress).
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        return READS

    def reader(self, schema) -> FastqReader:
        return FastqReader(self._plain())

    def writer(self, schema, overwrite: bool) -> FastqWriter:
        return FastqWriter(self._plain(), overwrite)

    def _plain(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(FastqSource)


def line_counts(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows ``(path, lines)``: line feeds of each decompressed file, counted by tasks, ranges of plain files by themselves."""
    rows = [(p, *r, files.is_gzip(p)) for p in paths for r in ranges_of(p, split_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, whole in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pydict({"path": [path], "lines": [count_lines(path) if whole else count_feeds(path, start, stop)]})

    ranges = spark.createDataFrame(rows, "path string, start long, stop long, whole boolean").repartition(max(1, min(len(rows), MOST_TASKS)))
    return ranges.mapInArrow(run, "path string, lines long").groupBy("path").agg(F.sum("lines").alias("lines"))


def _counted(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> list[int]:
    """Line feeds of each range, counted by tasks: a row a range reaches the driver."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i long, start long, stop long").repartition(len(ranges), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pydict({"i": [i], "n": [count_feeds(path, start, stop)]})

    return [r.n for r in sorted(rows.mapInArrow(run, "i long, n long").collect(), key=lambda r: r.i)]


def read_fastq(spark: SparkSession, path: str, segment: int = 0, split_bytes: int = SPLIT_BYTES, strict: bool = True) -> DataFrame:
    """One file as reads; line feeds of large files are counted by a Spark job first."""
    register(spark)
    ranges = ranges_of(path, split_bytes)
    reader = spark.read.format("fastq").option("segment", segment).option("splitBytes", split_bytes).option("strict", str(strict).lower())
    if len(ranges) > 1:
        reader = reader.option("lineFeeds", json.dumps(_counted(spark, path, ranges)))
    return reader.load(path)


def read_segments(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files read side by side: segments 0, 1 and so on of the same records."""
    if not paths:
        raise ValueError("at least one source is required")
    return reduce(DataFrame.unionByName, [read_fastq(spark, p, i, **options) for i, p in enumerate(paths)])


def write_parts(reads: DataFrame, folder: str, compressed: bool = False) -> list[tuple[str, int]]:
    """Writes a folder of parts in order of record_no, each a FASTQ file of its own; gives their paths and sizes in order.

    For outputs too large for one file: nothing is copied.  A range partitioning gives
    each task a stretch of records, so no task holds the file.
    """
    register(reads.sparkSession)
    ordered = reads.select("record_no", "segment", *LINES).repartitionByRange("record_no").sortWithinPartitions("record_no")
    ordered.write.format("fastq").mode("append").option("parts", "true").option("as", "x.gz" if compressed else "x").save(folder)
    with files.open_stored(f"{folder}/{MANIFEST}") as f:
        return [tuple(x) for x in json.loads(f.read())]


def write_fastq(reads: DataFrame, path: str) -> None:
    """Writes one file in order of record_no: definition, sequence, plus line and quality, each with a line feed.

    Tasks write parts, and tasks put them together beside the target: on a local or
    mounted file system all at once, each part at its place, elsewhere by one task that
    reads them in turn.  Then the target is replaced in one step.  Whatever fails before
    leaves it as it was.
    """
    spark, run = reads.sparkSession, uuid.uuid4().hex
    folder, beside, compressed = f"{path}.{run}.parts", f"{path}.{run}.new", files.is_gzip(path)
    try:
        parts = write_parts(reads, folder, compressed)
        if not parts:
            with files.open_new(beside) as f:
                f.write(gzip.compress(b"", mtime=0) if compressed else b"")
        elif files.is_local(path):
            files.reserve(beside, sum(size for _, size in parts))
            places = [sum(size for _, size in parts[:i]) for i in range(len(parts))]
            _in_tasks(spark, [(p, at) for (p, _), at in zip(parts, places)], "part string, at long", lambda row: _copy_to(row[0], beside, row[1]))
        else:
            paths = [p for p, _ in parts]
            _in_tasks(spark, [(beside,)], "target string", lambda row: join_parts(paths, row[0], compressed))
        files.replace(beside, path)
    finally:
        files.remove(beside)
        files.remove_folder(folder)


def _copy_to(part: str, target: str, at: int) -> None:
    with files.open_stored(part) as source, files.open_at(target, at) as out:
        while data := source.read(CHUNK_BYTES):
            out.write(data)


def _in_tasks(spark: SparkSession, rows: list[tuple], schema: str, work: Callable[[tuple], None]) -> None:
    """Has each row worked on by a task, and waits; a task that is tried again does the same once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                work(row)
                yield pa.RecordBatch.from_pydict({"done": [1]})

    spark.createDataFrame(rows, schema).repartition(min(len(rows), MOST_TASKS)).mapInArrow(run, "done long").count()


def write_segments(reads: DataFrame, paths: list[str]) -> None:
    """Writes each segment to its path."""
    for segment, path in enumerate(paths):
        write_fastq(reads.where(F.col("segment") == segment), path)
