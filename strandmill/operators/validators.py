"""Validation rules as Columns, and the registry that picks them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytestrings import byte_length, display

# Levels in rising order, and the order of a record's lines.
LEVELS = ["low", "medium", "high"]
NAME, SEQUENCE, PLUS_LINE, QUALITY = range(4)

# The bytes a sequence may hold.
ALPHABET = "ACGTNacgtn"


Field = Callable[[str], Column]
Failed = Callable[[int, Column | int, Column | str], Column]


@dataclass(frozen=True)
class ValidatorSpec:
    """A rule: ``check(field, failed)`` gives ``failed(line, col_no, message)`` where a record fails, else null.

    ``field`` turns a field's name into its Column.
    """

    code: str
    name: str
    level: str
    check: Callable[[Field, Failed], Column]

    def failure(self, rank: int, field: Field = F.col) -> Column:
        """The failure as a struct with the rule's identity, or null."""
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)

        def failed(line: int, col_no: Column | int, message: Column | str) -> Column:
            return F.struct(
                F.lit(line).alias("line"), as_column(col_no).cast("long").alias("col_no"), F.lit(self.code).alias("validator_code"),
                F.lit(self.name).alias("validator_name"), as_column(message).alias("message"), F.lit(rank).alias("validator_rank"),
            )

        return self.check(field, failed)


def plus_line(field: Field, failed: Failed) -> Column:
    return F.when(~field("plus_line").startswith("+"), failed(PLUS_LINE, 1, "missing + prefix"))


def alphabet(allowed: str = ALPHABET) -> Callable[[Field, Failed], Column]:
    """A check that sequences hold only these bytes."""
    if not allowed:
        raise ValueError("an alphabet needs a character")
    outside = "[^" + "".join(re.escape(c) if not c.isalnum() else c for c in allowed) + "]"

    def check(field: Field, failed: Failed) -> Column:
        at = F.regexp_instr(field("sequence"), F.lit(outside))
        return F.when(at > 0, failed(SEQUENCE, at, _bad_character("invalid sequence character", field("sequence"), at)))

    return check


def name(field: Field, failed: Failed) -> Column:
    return F.when(~field("name").startswith("@"), failed(NAME, 1, "missing @ prefix"))


def complete(field: Field, failed: Failed) -> Column:
    return F.coalesce(*[
        F.when(field(column) == "", failed(line, 1, f"empty {shown}"))
        for line, column, shown in ((NAME, "name", "name"), (SEQUENCE, "sequence", "sequence"), (PLUS_LINE, "plus_line", "plus line"), (QUALITY, "quality", "quality"))
    ])


def consistent_lengths(field: Field, failed: Failed) -> Column:
    bases, scores = byte_length(field("sequence")), byte_length(field("quality"))
    message = F.format_string("sequence-quality scores lengths mismatch: expected %d, got %d", bases, scores)
    return F.when(bases != scores, failed(SEQUENCE, 1, message))


def quality_string(field: Field, failed: Failed) -> Column:
    at = F.regexp_instr(field("quality"), F.lit("[^!-~]"))
    return F.when(at > 0, failed(QUALITY, at, _bad_character("invalid quality score character", field("quality"), at)))


def same_names(field: Field, failed: Failed) -> Column:
    """Of a pair: the labels follow the order in which the names were always shown."""
    message = F.concat(F.lit("names mismatch: expected '"), display(field("name_2")), F.lit("', got '"), display(field("name_1")), F.lit("'"))
    return F.when(field("name_1") != field("name_2"), failed(NAME, 1, message))


def _bad_character(text: str, line: Column, at: Column) -> Column:
    return F.concat(F.lit(f"{text}: '"), line.substr(at, F.lit(1)), F.lit("'"))


# Codes, names and levels, in the order in which rules are tried.
SINGLE = [
    ValidatorSpec("S003", "NameValidator", "high", name),
    ValidatorSpec("S004", "CompleteValidator", "low", complete),
    ValidatorSpec("S002", "AlphabetValidator", "medium", alphabet()),
    ValidatorSpec("S001", "PlusLineValidator", "low", plus_line),
    ValidatorSpec("S005", "ConsistentSeqQualValidator", "high", consistent_lengths),
    ValidatorSpec("S006", "QualityStringValidator", "medium", quality_string),
]
PAIRED = [ValidatorSpec("P001", "NamesValidator", "medium", same_names)]
#: The rule over all names of a file; it has no level to be picked by.
DUPLICATE = ("S007", "DuplicateNameValidator", "high")


def select(specs: Iterable[ValidatorSpec], level: str, disabled: Iterable[str] = ()) -> list[ValidatorSpec]:
    """The rules up to a level, less those disabled by code; unknown codes are ignored."""
    if level not in LEVELS:
        raise ValueError(f"invalid level: {level}; expected one of {', '.join(LEVELS)}")
    off = set(disabled)
    return [s for s in specs if LEVELS.index(s.level) <= LEVELS.index(level) and s.code not in off]
