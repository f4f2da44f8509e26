"""The two rules that take a read's name from its definition line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a name.
SEPARATORS = "/ "


def first_part(definition: Column, separator: str | None = None) -> Column:
    """The definition up to its first slash or space, or up to ``separator`` alone; the prefix sign stays."""
    if separator is None:
        for end in SEPARATORS:
            definition = F.substring_index(definition, end, 1)
        return definition
    return F.substring_index(definition, separator, 1)


def name_id(definition: Column) -> Column:
    """The definition without its first byte, up to its last slash or space."""
    return F.regexp_replace(F.substring(definition, 2, 2**31 - 1), r"(?s)[/ ][^/ ]*$", "")


def check_allowlist_name(definition: Column) -> Column:
    """name_id(), failing for definitions that are empty or whose last separator comes first."""
    bad = definition.rlike(r"(?s)\A([/ ][^/ ]*)?\z")
    return F.when(bad, F.raise_error(F.lit("invalid definition: no name before the separator"))).otherwise(name_id(definition))


def parse_separator(text: str) -> str:
    """A separator argument: the first character, which must be one byte."""
    if not text:
        raise ValueError("invalid separator: empty")
    if ord(text[0]) > 0xFF:
        raise ValueError(f"invalid separator: {text[0]!r} isn't one byte")
    return text[0]
