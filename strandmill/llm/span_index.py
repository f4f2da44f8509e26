"""A log-structured index of window hashes: sorted immutable runs in the shared folder, merge-joined and compacted."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import remove
from ..sources import files
from .windows import levels_in_common

#: Entries of a run joined at once, and entries of one window from which it is refined instead of paired.
BATCH_ROWS, CROWD = 1 << 18, 64

#: An entry: the hash range, a chosen window, the text it is of, and digests of what lies around it.
PRINTS = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("hash", T.LongType()),
    T.StructField("doc", T.LongType()),
    T.StructField("context", T.LongType()),
])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("crowd", T.BooleanType())])

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def part_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each hash.  Chosen hashes are small ones, so they are scattered first."""
    return (((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int32)


class _Run:
    """A sorted run that is read once, from the least hash on."""

    def __init__(self, batches: Iterable[Entries]):
        self.batches, self.held = iter(batches), None

    def upto(self, last: int) -> Iterator[Entries]:
        """The entries not read yet with hashes up to ``last``, piece by piece."""
        while self.held is not None or (held := next(self.batches, None)) is not None:
            if self.held is None:
                self.held = held
            n = int(np.searchsorted(self.held[0], last, "right"))
            if n:
                yield tuple(x[:n] for x in self.held)
            self.held = tuple(x[n:] for x in self.held) if n < len(self.held[0]) else None
            if self.held is not None:
                return


def _link(a: np.ndarray, b: np.ndarray, crowd: bool) -> pa.RecordBatch:
    if not crowd:
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), dtype=bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        once &= a != b
        a, b = a[once], b[once]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), crowd))], names=LINKS.names)


def _once(h: np.ndarray, d: np.ndarray, c: np.ndarray) -> Entries:
    """Sorted entries, each once."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    return h[new], d[new], c[new]


def merge_joined(new: Iterable[Entries], old: list[Iterable[Entries]], crowd: int, needed: int) -> Iterator[pa.RecordBatch]:
    """Links of a new run's entries with each other and with those of older runs, all sorted by hash, doc and context.

    Two texts are linked where a window and ``needed`` levels around it agree.  A window
    with more than ``crowd`` entries gives crowd rows instead, one an entry of it.  All
    runs are streams; what is held are BATCH_ROWS entries and the least of their like.
    """
    runs = [_Run(x) for x in old]
    held: Entries = (np.empty(0, dtype=np.int64),) * 3
    crowded: int | None = None
    for entries in new:
        h, d, c = entries
        if crowded is not None:
            by = int(np.searchsorted(h, crowded, "right"))
            if by:
                yield _link(d[:by], h[:by], True)
            h, d, c = h[by:], d[by:], c[by:]
        h, d, c = _once(*(np.concatenate(x) for x in zip(held, (h, d, c))))
        if not len(h):
            continue
        # The last window may go on in the next batch, unless it is a crowd already.
        cut = int(np.searchsorted(h, h[-1], "left"))
        if len(h) - cut > crowd:
            crowded, cut = int(h[-1]), len(h)
        held = (h[cut:], d[cut:], c[cut:])
        if cut:
            yield from _joined(h[:cut], d[:cut], c[:cut], runs, crowd, needed)
    if len(held[0]):
        yield from _joined(*held, runs, crowd, needed)


def _joined(h: np.ndarray, d: np.ndarray, c: np.ndarray, runs: list[_Run], crowd: int, needed: int) -> Iterator[pa.RecordBatch]:
    distinct, total = np.unique(h, return_counts=True)
    like: list[Entries] = [(h, d, c)]
    for run in runs:
        for oh, od, oc in run.upto(int(h[-1])):
            at = np.minimum(np.searchsorted(distinct, oh), len(distinct) - 1)
            met = distinct[at] == oh
            if not met.any():
                continue
            oh, od, oc, at = oh[met], od[met], oc[met], at[met]
            rank = np.arange(len(oh)) - np.searchsorted(oh, oh, "left")
            beyond = total[at] + rank >= crowd  # a crowd for certain, so it needn't be held
            if beyond.any():
                yield _link(od[beyond], oh[beyond], True)
            total += np.bincount(at, minlength=len(total))
            like.append((oh[~beyond], od[~beyond], oc[~beyond]))
    is_old = np.repeat([False, True], [len(h), sum(len(x[0]) for x in like[1:])])
    h, d, c = (np.concatenate(x) for x in zip(*like))
    size = total[np.searchsorted(distinct, h)]
    many = size > crowd
    if many.any():
        yield _link(d[many], h[many], True)
    few = (size > 1) & ~many
    h, d, c, is_old = h[few], d[few], c[few].view(np.uint64), is_old[few]
    order = np.argsort(h, kind="stable")
    h, d, c, is_old = h[order], d[order], c[order], is_old[order]
    mine, theirs = [], []
    at, apart = np.arange(len(h)), 0
    while len(at):  # all pairs of each window, by how far apart they lie: less than ``crowd``
        apart += 1
        at = at[at + apart < len(h)]
        at = at[h[at] == h[at + apart]]
        other = at + apart
        fits = ~(is_old[at] & is_old[other]) & (d[at] != d[other])
        fits[fits] = levels_in_common(c[at[fits]], c[other[fits]]) >= needed
        mine.append(d[at[fits]])
        theirs.append(d[other[fits]])
    if any(map(len, mine)):
        yield _link(np.concatenate(mine), np.concatenate(theirs), False)


def read_part(path: str, part: int, rows: int) -> Iterator[Entries]:
    """A hash range of a run, in its order; each range is one sorted file."""
    system, inner = files.resolve(f"{path}/part={part}")
    if system.get_file_info(inner).type == pa.fs.FileType.NotFound:
        return
    found = [x.path for x in system.get_file_info(pa.fs.FileSelector(inner)) if x.base_name.endswith(".parquet")]
    if len(found) != 1:
        raise ValueError(f"{path}: range {part} is in {len(found)} files, not one")
    with system.open_input_file(found[0]) as f:
        for batch in pa.parquet.ParquetFile(f).iter_batches(rows, columns=["hash", "doc", "context"]):
            yield tuple(batch.column(i).to_numpy() for i in range(3))


class SpanIndex:
    """Runs of entries in a folder that all executors share, and a manifest that names them.

    A run is never changed: each of its hash ranges is one sorted file.  add() writes a
    batch as a run, links() joins it with the runs before, file by file and without a
    shuffle, and commit() makes it one of them.  A run as large as the one before it is
    merged with it, so there are about as many runs as the logarithm of their entries.
    """

    def __init__(self, spark: SparkSession, folder: str, ranges: int, span: int, gram: int, runs: list[tuple[str, int]]):
        self.spark, self.folder, self.ranges, self.span, self.gram, self.runs = spark, folder, ranges, span, gram, runs

    @classmethod
    def create(cls, spark: SparkSession, folder: str, ranges: int, span: int, gram: int) -> SpanIndex:
        """An empty index; ``ranges`` is how many tasks can work on it at once."""
        made = cls(spark, folder, ranges, span, gram, [])
        made._save()
        return made

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SpanIndex:
        """The index of a folder, as it was last committed."""
        with files.open_stored(f"{folder}/manifest.json") as f:
            told = json.loads(f.read())
        return cls(spark, folder, told["ranges"], told["span"], told["gram"], [tuple(r) for r in told["runs"]])

    def _save(self) -> None:
        system, inner = files.resolve(self.folder)
        system.create_dir(inner, recursive=True)
        told = {"ranges": self.ranges, "span": self.span, "gram": self.gram, "runs": self.runs}
        beside = f"{inner}/manifest.{uuid.uuid4().hex}"
        with system.open_output_stream(beside, compression=None) as f:
            f.write(json.dumps(told).encode())
        system.move(beside, f"{inner}/manifest.json")  # seen as a whole or not at all

    def add(self, prints: DataFrame) -> str:
        """Writes entries as a sorted run and returns its name."""
        name = f"run-{uuid.uuid4().hex}"
        placed = prints.repartitionById(self.ranges, F.col("part")).sortWithinPartitions(*PRINTS.names)
        placed.write.partitionBy("part").parquet(f"{self.folder}/{name}")
        return name

    def links(self, name: str, crowd: int, needed: int) -> DataFrame:
        """Rows ``(a, b, crowd)`` of a run added, against itself and all runs committed; of a crowd row ``b`` is the window's hash."""
        folder, older = self.folder, [r for r, _ in self.runs if r != name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    yield from merge_joined(
                        read_part(f"{folder}/{name}", part, BATCH_ROWS), [read_part(f"{folder}/{r}", part, BATCH_ROWS) for r in older], crowd, needed
                    )

        return self.spark.range(0, self.ranges, 1, self.ranges).mapInArrow(run, LINKS)

    def commit(self, name: str) -> None:
        """Makes an added run part of the index, and merges runs of like size."""
        merged: list[str] = []
        self.runs.append((name, self._rows(name)))
        while len(self.runs) > 1 and self.runs[-1][1] >= self.runs[-2][1]:
            both = [r for r, _ in self.runs[-2:]]
            made = self.add(self._read(*both).dropDuplicates(PRINTS.names))
            self.runs[-2:] = [(made, self._rows(made))]
            merged += both
        self._save()
        for old in merged:
            remove(self.spark, f"{self.folder}/{old}")

    def _read(self, *names: str) -> DataFrame:
        frames = [self.spark.read.schema(PRINTS).parquet(f"{self.folder}/{n}") for n in names]
        both = frames[0]
        for frame in frames[1:]:
            both = both.unionByName(frame)
        return both.select(*PRINTS.names)

    def _rows(self, name: str) -> int:
        return self._read(name).count()

    def drop(self) -> None:
        """Removes the index with all its runs."""
        remove(self.spark, self.folder)
