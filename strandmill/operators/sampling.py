"""Samples of records by probability or by exact count; mates stay together."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a record's digest, and of them those that name its cell in the histogram of an exact sample.
DIGITS, CELL = 13, 4


def check_probability(p: float) -> float:
    """A probability strictly between 0 and 1."""
    if not 0.0 < p < 1.0:
        # Fixed value: the message.
        raise ValueError(f"invalid probability: expected (0.0, 1.0), got {p}")
    return p


def new_seed(seed: int | None = None) -> int:
    """The seed, or a random one."""
    return random.SystemRandom().randrange(2**63) if seed is None else seed


def _digest(seed: int, keys: list[str]) -> Column:
    """52 bits of a digest of the seed and the record's place, as hexadecimal digits, which sort as numbers do.

    The same however rows are partitioned.
    """
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in [*keys, "record_no"]]]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)


def sample_fraction(reads: DataFrame, probability: float, seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Each record whose uniform number is at most the probability, all its segments together: a narrow filter, no shuffle."""
    most = int(check_probability(probability) * 16**DIGITS)
    return reads.where(_digest(new_seed(seed), keys or []) <= f"{most:0{DIGITS}x}")


def exact_cut(reads: DataFrame, n: int, seed: int) -> tuple[Column, DataFrame | None, int]:
    """How to take the ``n`` records of segment 0 with the least digests.

    Returns a condition for those surely in, the records of the cell that crosses n
    that fill it up (or None), and how many records there are.  A histogram of at most
    65,536 rows finds the crossing cell, so only about that part of the records is sorted.
    """
    digits = _digest(seed, [])
    cell = F.substring(digits, 1, CELL)
    first = reads.where(F.col("segment") == 0)
    counts = sorted((r.cell, r["count"]) for r in first.groupBy(cell.alias("cell")).count().collect())  # 16 ** CELL rows at most
    total = sum(c for _, c in counts)
    taken = 0
    for at, count in counts:
        if taken + count > n:
            rest = None
            if n > taken:
                rest = first.where(cell == at).select("record_no", digits.alias("d")).orderBy("d", "record_no").limit(n - taken).select("record_no")
            return cell < at, rest, total
        taken += count
    return F.lit(True), None, total


def sample_exact(reads: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` records of a file, or all if it has fewer, all their segments together.

    Segment 0 decides; the others must have the same records (see pairs.parity()).  Fails
    for a file without records, even if none are asked for.
    """
    if n < 0:
        raise ValueError(f"invalid record count: {n}")
    sure, rest, total = exact_cut(reads, n, new_seed(seed))
    if not total:
        # Fixed value: the message.
        raise ValueError("invalid uniform range")
    chosen = reads.where(sure)
    return chosen if rest is None else chosen.unionByName(reads.join(rest, "record_no", "left_semi").select(*reads.columns))


def check_quantity(probability: float | None, record_count: int | None) -> None:
    """Exactly one of the two must be given."""
    if (probability is None) == (record_count is None):
        raise ValueError("exactly one of probability and record count is required")
    if probability is not None and not math.isnan(probability):
        check_probability(probability)
    elif probability is not None:
        check_probability(float("nan"))
