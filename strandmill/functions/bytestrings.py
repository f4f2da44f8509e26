"""Byte strings held as text, one ISO-8859-1 character per byte.

Reads may hold any bytes, and lengths and columns count bytes.  In this form
``length``, ``substr`` and regular expressions are exact by byte, on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_bytes(column: Column) -> Column:
    """The byte form of a binary or UTF-8 column; null stays null."""
    return F.decode(column.cast("binary"), "ISO-8859-1")


def to_bytes(column: Column) -> Column:
    """The bytes of a column in byte form."""
    return F.encode(column, "ISO-8859-1")


def byte_length(column: Column) -> Column:
    """Bytes of a column in byte form."""
    return F.length(column).cast("long")


def display(column: Column) -> Column:
    """Bytes as readable text: malformed UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(to_bytes(column).cast("string"))
