"""Validation of single files and of pairs as one DataFrame of violations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytestrings import display
from ..functions.names import first_part
from ..plans.runtime import keep
from ..schema import line_no
from . import validators as V
from .bloom import NAME_CAPACITY, NAME_RATE, ScalableBloomFilter
from .pairs import names_of, pair_names

#: The order in which violations are reported.
ORDER = ["pass", "record_no", "validator_rank", "segment"]


def _shown(df: DataFrame, keys: list[str], sources: dict[int, str] | None) -> DataFrame:
    src = F.lit(None).cast("string")
    for segment, path in (sources or {}).items():
        src = F.when(F.col("segment") == segment, F.lit(path)).otherwise(src)
    return df.select(*keys, src.alias("src"), "segment", "record_no", line_no(F.col("record_no"), F.col("line")).alias("line_no"), "col_no", "validator_code", "validator_name", "message", "pass", "validator_rank")


def _with_failures(reads: DataFrame, specs: list[V.ValidatorSpec], keys: list[str], separator: str | None) -> DataFrame:
    """Names of reads, with an array of what fails in each: all rules of a row at once."""
    named = reads.select(*keys, "segment", "record_no", first_part(F.col("definition"), separator).alias("name"), "sequence", "plus_line", "quality")
    found = F.filter(F.array(*[s.failure(rank) for rank, s in enumerate(specs)]), lambda x: x.isNotNull())
    return named.select(*keys, "segment", "record_no", "name", found.alias("found"))


def _failures(found: DataFrame, keys: list[str], sources: dict[int, str] | None) -> DataFrame:
    rows = found.select(*keys, "segment", "record_no", F.explode("found").alias("f")).select(*keys, "segment", "record_no", "f.*", F.lit(1).alias("pass"))
    return _shown(rows, keys, sources)


def single_violations(reads: DataFrame, specs: list[V.ValidatorSpec], keys: list[str] | None = None, separator: str | None = None,
                      sources: dict[int, str] | None = None) -> DataFrame:
    """Failures of record rules: one narrow pass, no shuffle."""
    keys = keys or []
    if not specs:
        reads, specs = reads.where(F.lit(False)), V.SINGLE[:1]
    return _failures(_with_failures(reads, specs, keys, separator), keys, sources)


def possible_duplicates(names: DataFrame, rate: float = NAME_RATE, capacity: int = NAME_CAPACITY) -> DataFrame:
    """Rows ``(number,)``: of the 64-bit numbers of names, one a row, those that seem to come more than once; none that does is lost.

    Numbers are scattered, and each task holds a growing Bloom filter of its own, with a
    first layer for ``capacity`` of them.  Repeats within a batch of the input are told
    before the shuffle, so a hot name sends a row a batch.  Null numbers are left out.
    """

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, n = np.unique(batch.column(0).drop_null().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n > 1)], names=["number", "again"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ScalableBloomFilter(rate, capacity)
        for batch in batches:
            number = batch.column(0).to_numpy()
            again = seen.insert(number.view(np.uint64)) | batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(number[again]))], names=["number"])

    told = names.mapInArrow(locally, "number long, again boolean")
    return told.repartition("number").mapInArrow(met, "number long").distinct()


def duplicate_names(reads: DataFrame, keys: list[str] | None = None, separator: str | None = None, segment: int = 0,
                    sources: dict[int, str] | None = None, prefilter: bool = False) -> DataFrame:
    """The second and later occurrences of a name in a file's first segment.

    A name's first record is found by an aggregate that combines on the map side; the
    names that come again are then joined with their records.  Of a hot name all records
    meet there, narrow rows that adaptive execution splits over tasks.  With ``prefilter``
    one more scan passes numbers of names through Bloom filters first, and only names
    that may come again are aggregated: for files that hardly repeat any.
    """
    return _repeated(names_of(reads, keys, separator), keys or [], segment, sources, prefilter)


def _repeated(names: DataFrame, keys: list[str], segment: int = 0, sources: dict[int, str] | None = None, prefilter: bool = False) -> DataFrame:
    named = names.where(F.col("segment") == segment).select(*keys, "record_no", "name")
    if prefilter:
        number = F.xxhash64(*keys, "name")
        again = possible_duplicates(named.select(number.alias("number"))).withColumnRenamed("number", "_number")
        named = named.withColumn("_number", number).join(again, "_number", "left_semi").drop("_number")
    firsts = named.groupBy(*keys, "name").agg(F.min("record_no").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = named.alias("r").join(firsts.alias("f"), [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*keys, "name"]])
    code, rule, _ = V.DUPLICATE
    rows = joined.where(F.col("r.record_no") > F.col("f.first")).select(
        *[F.col(f"r.{k}").alias(k) for k in keys], F.lit(segment).alias("segment"), F.col("r.record_no").alias("record_no"), F.lit(V.NAME).alias("line"),
        F.lit(1).cast("long").alias("col_no"), F.lit(code).alias("validator_code"), F.lit(rule).alias("validator_name"),
        F.concat(F.lit("duplicate name: '"), display(F.col("r.name")), F.lit("'")).alias("message"), F.lit(2).alias("pass"), F.lit(0).alias("validator_rank"),
    )
    return _shown(rows, keys, sources)


def pair_violations(reads: DataFrame, specs: list[V.ValidatorSpec], rank: int, keys: list[str] | None = None, separator: str | None = None,
                    sources: dict[int, str] | None = None) -> DataFrame:
    """Failures of pair rules, reported at the first mate."""
    return _mismatched(names_of(reads, keys, separator), specs, rank, keys or [], sources)


def _mismatched(names: DataFrame, specs: list[V.ValidatorSpec], rank: int, keys: list[str], sources: dict[int, str] | None) -> DataFrame:
    if not specs:
        names, specs = names.where(F.lit(False)), V.PAIRED
    pairs = pair_names(names, keys).where(F.col("name_1").isNotNull() & F.col("name_2").isNotNull())
    found = F.filter(F.array(*[s.failure(rank + i) for i, s in enumerate(specs)]), lambda x: x.isNotNull())
    return _failures(pairs.select(*keys, F.lit(0).alias("segment"), "record_no", found.alias("found")), keys, sources)


def lint(reads: DataFrame, paired: bool = False, single_level: str = "high", paired_level: str = "high", disabled: Iterable[str] = (),
         separator: str | None = None, keys: list[str] | None = None, sources: dict[int, str] | None = None, duplicates: bool | None = None,
         single: list[V.ValidatorSpec] | None = None, mates: list[V.ValidatorSpec] | None = None,
         staged: bool = False) -> DataFrame:
    """All violations of a file or pair, or of each file of a table with the columns ``keys``.

    Unpaired: record rules up to ``single_level`` on segment 0.  Paired: record rules on
    both segments, pair rules up to ``paired_level``, and repeated names of the first
    segment unless disabled by code (``duplicates`` asks for or skips them).  ``single``
    and ``mates`` are other record and pair rules than the built-in ones.  Rows come in
    no order; ORDER is the order of report.  Lines must not be null (see as_reads()).

    Each rule of several records reads the names again, three times for all of them.
    With ``staged`` names and failures are written once to the shared folder, and
    ``reads`` is scanned once: for inputs that are slow to scan, as FASTQ files are.
    """
    disabled = list(disabled)
    specs = V.select(V.SINGLE if single is None else single, single_level, disabled)
    mates = V.select(V.PAIRED if mates is None else mates, paired_level, disabled)
    keys, again = keys or [], (paired if duplicates is None else duplicates) and V.DUPLICATE[0] not in disabled
    own = reads if paired else reads.where(F.col("segment") == 0)
    if staged and (again or (paired and mates)):
        names = keep(_with_failures(own, specs or V.SINGLE[:1], keys, separator), "names")
        out = _failures(names if specs else names.where(F.lit(False)), keys, sources)
    else:
        names = names_of(reads, keys, separator)
        out = single_violations(own, specs, keys, separator, sources)
    if paired and mates:
        out = out.unionByName(_mismatched(names, mates, len(specs), keys, sources))
    if again:
        out = out.unionByName(_repeated(names, keys, sources=sources))
    return out


def totals(reads: DataFrame, violations: DataFrame, paired: bool = False, duplicates: bool | None = None) -> DataFrame:
    """Rows ``(pass, record_count, failure_count)``: what each pass of lint() read and found.

    The first pass counts records of the first segment, as does the second, which looks
    for repeated names.  A pass without records or failures has 0.
    """
    passes = [1, 2] if (paired if duplicates is None else duplicates) else [1]
    read = reads.where(F.col("segment") == 0).agg(F.count(F.lit(1)).alias("record_count"))
    read = read.select(F.explode(F.array(*map(F.lit, passes))).alias("pass"), "record_count")
    found = violations.groupBy("pass").agg(F.count(F.lit(1)).alias("failure_count"))
    return read.join(found, "pass", "left").select("pass", "record_count", F.coalesce("failure_count", F.lit(0)).alias("failure_count"))


def first_violation(violations: DataFrame) -> DataFrame:
    """The one violation at which a run that stops at the first would stop."""
    return violations.orderBy(*ORDER).limit(1)
