"""Lint-log lines into typed rows, and the lines that fail with the reason."""

from __future__ import annotations

import csv
import re
import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a line, the codes and the line types.
FIELDS = ["source", "record_no", "definition_end", "sequence_end", "plus_line_end", "code", "line_type", "col_no", "message"]
CODES = {"S001", "S002", "S003", "S004", "S005", "S006", "S007", "P001"}
LINE_TYPES = {"Name", "Sequence", "PlusLine", "Quality"}

PARSED = T.StructType([
    T.StructField("source", T.StringType()),
    *[T.StructField(name, T.LongType()) for name in FIELDS[1:5]],
    T.StructField("code", T.StringType()),
    T.StructField("line_type", T.StringType()),
    T.StructField("col_no", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("reason", T.StringType()),
])

_DIGITS = re.compile(r"[0-9]+")
_MOST = 2**63 - 1
_ROWS = 5000

#: Physical lines that one record may go on over.
MOST_LINES = 10_000

_FIELD, _QUOTED, _ENDED, _BROKEN = range(4)


class Rejected(ValueError):
    """A line that fails; its text is the reason: 'quoting', 'columns' or 'value'."""


def assemble(lines: Iterator[str], most: int = MOST_LINES) -> Iterator[str]:
    """Physical lines joined to records: a line feed inside an open quote continues the record.

    A line whose quoting breaks, or whose quote isn't closed by the end of the input or
    within ``most`` lines, is a broken record by itself, and reading goes on with the
    line after it; so a stray quote costs its own line, not those that follow.
    """
    again: deque[str] = deque()

    def following() -> str | None:
        return again.popleft() if again else next(lines, None)

    while (line := following()) is not None:
        held, state = [line], _after(line, _FIELD)
        while state == _QUOTED and len(held) < most and (line := following()) is not None:
            held.append(line)
            state = _after(line, state)
        if state == _ENDED:
            yield "\n".join(held)
        else:
            yield held[0]
            again.extendleft(reversed(held[1:]))


def _after(line: str, state: int) -> int:
    """What a physical line leaves behind, entered at a field's start or inside a quoted one."""
    at, n = 0, len(line)
    while True:
        if state == _QUOTED:
            at = line.find('"', at)
            if at < 0:
                return _QUOTED
            at += 1
            if line.startswith('"', at):
                at += 1
                continue
            if at == n or line[at:] == "\r":
                return _ENDED
            if line[at] != ",":
                return _BROKEN
        elif line.startswith('"', at):
            state, at = _QUOTED, at + 1
            continue
        else:
            stop = line.find(",", at)
            if '"' in line[at : n if stop < 0 else stop]:
                return _BROKEN
            if stop < 0:
                return _ENDED
            at = stop
        state, at = _FIELD, at + 1


def _bare_quote(record: str) -> bool:
    """Whether a field that doesn't begin with a quote has one."""
    at, n = 0, len(record)
    while at <= n:
        if record.startswith('"', at):
            at = record.find('"', at + 1)
            while at >= 0 and record.startswith('""', at):
                at = record.find('"', at + 2)
            if at < 0:
                return False  # never closed: the strict reader says so
            at += 1
            if at < n and record[at] != ",":
                return False  # text after the closing quote: likewise
            at += 1
        else:
            stop = record.find(",", at)
            stop = n if stop < 0 else stop
            if '"' in record[at:stop]:
                return True
            at = stop + 1
    return False


def split_fields(record: str) -> list[str]:
    """The fields by Python's strict csv reader; raises Rejected('quoting')."""
    if '"' in record and _bare_quote(record):
        raise Rejected("quoting")
    # Line ends outside quotes are data here, but not to the reader: they stand as characters the record lacks.
    swapped = [(end, _absent(record, i)) for i, end in enumerate("\r\n") if end in record]
    for end, other in swapped:
        record = record.replace(end, other)
    try:
        rows = list(csv.reader([record], strict=True))
    except csv.Error as wrong:
        raise Rejected("quoting") from wrong
    fields = rows[0] if rows and rows[0] else [""]
    for end, other in swapped:
        fields = [f.replace(other, end) for f in fields]
    return fields


def _absent(text: str, start: int) -> str:
    """A character that the text lacks."""
    code = 0xE000 + start
    while chr(code) in text:
        code += 2
    return chr(code)


def _integer(text: str) -> int:
    if not _DIGITS.fullmatch(text):
        raise Rejected("value")
    digits = text.lstrip("0") or "0"
    if len(digits) > 19 or int(digits) > _MOST:
        raise Rejected("value")
    return int(digits)


def typed(fields: list[str]) -> tuple:
    """The fields' values; raises Rejected('columns') or Rejected('value')."""
    if len(fields) != len(FIELDS):
        raise Rejected("columns")
    source, numbers, (code, line_type, col_no, message) = fields[0], [_integer(f) for f in fields[1:5]], fields[5:]
    col = _integer(col_no) if col_no else None
    known = (code in CODES and line_type in LINE_TYPES) or code == line_type == ""
    if not source or not 0 < numbers[1] < numbers[2] < numbers[3] or col == 0 or not known:
        raise Rejected("value")
    return (source, *numbers, code or None, line_type or None, col, message)


def parse_line(text: str) -> tuple:
    """The values and a null reason, or nulls and the first reason that applies."""
    if text.endswith("\r"):
        text = text[:-1]
    try:
        return (*typed(split_fields(text)), None)
    except Rejected as wrong:
        return (*[None] * len(FIELDS), str(wrong))


def parse_lines(lines: DataFrame, text_col: str = "line_text", keep: list[str] | None = None) -> DataFrame:
    """Each row's parsed fields and ``reason``, null for a good line; ``keep`` names columns to carry.

    A null line is rejected by 'columns', as an empty one is.  One narrow pass: good
    and bad rows come out together, so both can be written from one scan.
    """
    keep = list(keep or [])
    clash = [c for c in keep if c in PARSED.names]
    if clash:
        raise ValueError(f"columns named like parsed fields: {', '.join(clash)}")
    schema = T.StructType([*[lines.schema[c] for c in keep], *PARSED.fields])
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in PARSED.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                rows = [parse_line(t or "") for t in batch.column(len(keep)).to_pylist()]
                columns = zip(*rows) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return lines.select(*keep, F.col(text_col).alias("_text") if "_text" not in keep else F.col(text_col).alias("_line_text")).mapInArrow(run, schema)


def split_loaded(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the reason, and rejected ones with it."""
    good = parsed.where(F.col("reason").isNull()).drop("reason")
    carried = [c for c in parsed.columns if c not in PARSED.names]
    return good, parsed.where(F.col("reason").isNotNull()).select(*carried, "reason")
