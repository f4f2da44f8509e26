"""Phred scores and error probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the byte of score 0.
SCORE_ZERO = 33


def error_probability(score: Column) -> Column:
    """The chance that a base with this score is wrong."""
    return F.pow(F.lit(10.0), -score / F.lit(10.0))


def phred_score(probability: Column) -> Column:
    """The score of an error probability: infinite for 0, NaN for NaN."""
    return F.when(probability == 0, F.lit(float("inf"))).otherwise(F.lit(-10.0) * F.log10(probability))
