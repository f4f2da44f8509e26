"""The four commands from files to files: describe, filter, lint and subsample."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, lint as L, metrics, pairs, sampling
from ..sources import fastq, text

log = logging.getLogger("strandmill")

# Fixed value: what an empty file shows as its shortest sequence.
NO_LENGTH = 2**64 - 1


class CommandError(Exception):
    """Inputs that can't be processed; the message is for the user."""


def describe(spark: SparkSession, src: str) -> Row:
    """The metrics of a file."""
    return metrics.describe(fastq.read_fastq(spark, src)).first()


def describe_lines(row: Row) -> list[str]:
    """The metrics as shown: a name, a tab and a value."""
    shortest = NO_LENGTH if row.min_sequence_length is None else row.min_sequence_length
    scores = ", ".join(_shown(x) for x in row.avg_quality_score_per_position)
    return [f"record_count\t{row.record_count}", f"min_sequence_length\t{shortest}", f"max_sequence_length\t{row.max_sequence_length}", f"avg_quality_score_per_position\t[{scores}]"]


def _shown(x: float) -> str:
    return "NaN" if x != x else "inf" if x == float("inf") else repr(x)


def filter_files(spark: SparkSession, srcs: list[str], dsts: list[str], names: str | None = None, sequence_pattern: str | None = None) -> None:
    """Records whose first source meets the predicate, from all sources; without one, raw copies.

    Later sources may be longer than the first, not shorter.  All outputs are written
    after the check, or none.
    """
    if names is not None and sequence_pattern is not None:
        raise ValueError("names and sequence pattern can't be used together")
    if not srcs or len(srcs) != len(dsts):
        raise ValueError("sources and destinations must be as many, and at least one")
    if names is None and sequence_pattern is None:
        for source, target in zip(srcs, dsts):
            text.copy_bytes(source, target)
        return
    if sequence_pattern is not None:
        filters.java_pattern(sequence_pattern)
    reads = fastq.read_segments(spark, srcs)
    if names is not None:
        wanted = text.read_names(spark, names)
        log.info("loaded %d names", wanted.count())
        kept = filters.filter_names(reads, wanted)
    else:
        kept = filters.filter_pattern(reads, sequence_pattern)
    if len(srcs) > 1:
        first = reads.where("segment = 0").agg(F.max("record_no")).first()[0]
        if first is not None:
            last = {r.segment: r.m for r in reads.groupBy("segment").agg(F.max("record_no").alias("m")).collect()}  # a row a source
            if any(last.get(s, -1) < first for s in range(1, len(srcs))):
                raise CommandError(fastq.TRUNCATED)
    fastq.write_segments(kept, dsts)


def lint_files(spark: SparkSession, r1: str, r2: str | None = None, single_level: str = "high", paired_level: str = "high", disabled: Iterable[str] = (),
               separator: str | None = None) -> tuple[DataFrame, str | None]:
    """The violations of a file or pair, and what ended the run early, if anything did.

    When one mate's file ends first, violations before that record are reported and
    repeated names aren't looked for.
    """
    paths = [r1] if r2 is None else [r1, r2]
    reads = fastq.read_segments(spark, paths)
    sources = dict(enumerate(paths))
    disabled = list(disabled)
    short = pairs.parity(reads).first() if r2 is not None else None
    if short is None:
        found, paired = L.lint(reads, r2 is not None, single_level, paired_level, disabled, separator, sources=sources, staged=True), r2 is not None
        if log.isEnabledFor(logging.INFO):
            for row in L.totals(reads, found, paired, paired and L.V.DUPLICATE[0] not in disabled).orderBy("pass").collect():
                log.info("validate_%s pass %d: record_count=%d failure_count=%d", "pair" if paired else "single", *row)
        return found, None
    found = L.lint(reads.where(F.col("record_no") < short.first_unmatched), True, single_level, paired_level, disabled, separator, sources=sources, duplicates=False, staged=True)
    return found, f"r{short.ended + 1}-src unexpectedly ended"


def lint_report(violations: DataFrame, panic: bool) -> Iterator[Row]:
    """Violations in order of report: the first alone, or all, a partition at a time."""
    if panic:
        yield from L.first_violation(violations).collect()
    else:
        yield from violations.orderBy(*L.ORDER).toLocalIterator()


def subsample_files(spark: SparkSession, r1_src: str, r1_dst: str, r2_src: str | None = None, r2_dst: str | None = None, probability: float | None = None,
                    record_count: int | None = None, seed: int | None = None) -> tuple[int, int]:
    """Writes a sample of a file or pair in the input's order; returns records kept and seen."""
    sampling.check_quantity(probability, record_count)
    if r2_src is not None and r2_dst is None:
        raise ValueError("missing pair destination: r2-dst")
    if r2_dst is not None and r2_src is None:
        raise ValueError("missing pair source: r2-src")
    reads = fastq.read_segments(spark, [r1_src] if r2_src is None else [r1_src, r2_src])
    if r2_src is not None and (short := pairs.parity(reads).first()) is not None:
        raise CommandError(f"r{short.ended + 1}-src unexpectedly ended")
    seed = sampling.new_seed(seed)
    total = reads.where("segment = 0").count()
    if record_count is None:
        kept = sampling.sample_fraction(reads, probability, seed)
    else:
        if record_count > total:
            log.warning("record count %d is above the source's %d", record_count, total)
        kept = sampling.sample_exact(reads, record_count, seed)
    fastq.write_segments(kept, [r1_dst] if r2_dst is None else [r1_dst, r2_dst])
    n = kept.where("segment = 0").count()
    log.info("sampled %d/%d (%.1f%%) records", n, total, 100 * n / total if total else float("nan"))
    return n, total
