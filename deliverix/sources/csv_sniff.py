"""What a CSV file looks like, from a bounded sample of its first lines.

Delimiter, quote character, header and a type per column are found in the
sample and compared with the fixed schema of the table before the full parse
starts, so that a renamed, missing, reordered or retyped column is reported by
its name instead of as a table of bad rows.

Types form a lattice (empty below integer below double below text, empty below
timestamp below text); a column's type is the join of its values' types.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, FractionalType, IntegralType, StringType, StructField, StructType, TimestampNTZType, TimestampType

SAMPLE_LINES = 500
LINE_CHARS = 20_000
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")

EMPTY, INTEGER, DOUBLE, TIMESTAMP, TEXT = "empty", "integer", "double", "timestamp", "text"
#: The types above each type, itself included.
ABOVE = {EMPTY: {EMPTY, INTEGER, DOUBLE, TIMESTAMP, TEXT}, INTEGER: {INTEGER, DOUBLE, TEXT}, DOUBLE: {DOUBLE, TEXT},
         TIMESTAMP: {TIMESTAMP, TEXT}, TEXT: {TEXT}}
_FORMS = ((INTEGER, re.compile(r"[+-]?[0-9]{1,18}")), (DOUBLE, re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(inf|nan)", re.I)),
          (TIMESTAMP, re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?")))


def value_type(value: str) -> str:
    if not value:
        return EMPTY
    return next((name for name, form in _FORMS if form.fullmatch(value)), TEXT)


def join(a: str, b: str) -> str:
    """The smallest type above both."""
    both = ABOVE[a] & ABOVE[b]
    return max(both, key=lambda t: len(ABOVE[t] & both))


def lattice_type(kind: DataType) -> str:
    if isinstance(kind, IntegralType):
        return INTEGER
    if isinstance(kind, FractionalType):
        return DOUBLE
    if isinstance(kind, (TimestampNTZType, TimestampType, DateType)):
        return TIMESTAMP
    return TEXT


@dataclass(frozen=True)
class Sample:
    """The dialect of a file, its header and the sampled values of each column."""
    delimiter: str
    quote: str
    columns: tuple[str, ...]
    values: dict[str, tuple[str, ...]]

    def type_of(self, column: str) -> str:
        return reduce(join, map(value_type, self.values[column]), EMPTY)


@dataclass(frozen=True)
class Difference:
    kind: str  # renamed, missing, extra, reordered, retyped
    column: str
    detail: str

    def __str__(self) -> str:
        return f"{self.kind} column {self.column}: {self.detail}"


class SchemaDifference(ValueError):
    """A file's header or values do not fit the table's schema."""

    def __init__(self, path: str, differences: list[Difference]):
        super().__init__(f"{path}: " + "; ".join(map(str, differences)))
        self.differences = differences


def _records(text: str, delimiter: str, quote: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, doublequote=True) if r]


def sample_of(text: str, complete: bool = True) -> Sample | None:
    """The sample in ``text``; the last record is left out unless the text is ``complete``.  None without a header."""
    best: tuple | None = None
    for quote in QUOTES:
        for delimiter in DELIMITERS:
            rows = _records(text, delimiter, quote)
            rows = rows if complete or len(rows) < 3 else rows[:-1]
            if not rows:
                return None
            width = len(rows[0])
            even = sum(len(r) == width for r in rows) / len(rows)
            quoted = sum(v.startswith(quote) and v.endswith(quote) for v in rows[0])  # quotes of the other kind were left in
            score = (even if width > 1 else 0.0, width, -quoted, quote == '"', delimiter == ",")
            if best is None or score > best[0]:
                best = score, delimiter, quote, rows
    _, delimiter, quote, rows = best
    columns = tuple(c.strip().lstrip("﻿") for c in rows[0])
    full = [r for r in rows[1:] if len(r) == len(columns)]
    return Sample(delimiter, quote, columns, {c: tuple(r[i] for r in full) for i, c in enumerate(columns)})


def sniff(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> Sample | None:
    """Sample of the first lines of one of the files at ``path`` (at most ``lines`` of ``LINE_CHARS`` characters)."""
    rows = (spark.read.option("lineSep", "\n").text(path).where("_metadata.file_block_start = 0")
            .select(F.col("_metadata.file_path").alias("file"), F.substring("value", 1, LINE_CHARS).alias("value"), F.length("value").alias("n"))
            .limit(lines).collect())
    rows = [r for r in rows if r.file == rows[0].file]
    whole = next((k for k, r in enumerate(rows) if r.n > LINE_CHARS), len(rows))
    return sample_of("\n".join(r.value for r in rows[:whole]), complete=len(rows) < lines and whole == len(rows)) if whole else None


def compare(sample: Sample, schema: StructType, fitting: float = 0.5) -> list[Difference]:
    """How the file differs from ``schema``, column by column.

    A column counts as retyped when less than ``fitting`` of its sampled values
    that are not empty have its type or one below; single bad values are
    rows for the quarantine, not another type.
    """
    expected = [f.name for f in schema.fields]
    unknown = [c for c in sample.columns if c not in expected]
    out = []
    for i, name in enumerate(expected):
        if name in sample.columns:
            continue
        found = sample.columns[i] if i < len(sample.columns) else None
        if found in unknown and len(sample.columns) == len(expected):
            unknown.remove(found)
            out.append(Difference("renamed", name, f"the header has {found} in its place"))
        else:
            out.append(Difference("missing", name, "not in the header"))
    out += [Difference("extra", c, "not in the schema") for c in unknown]
    common = [c for c in expected if c in sample.columns]
    order = [c for c in sample.columns if c in common]
    out += [Difference("reordered", c, f"place {order.index(c) + 1} instead of {common.index(c) + 1}") for c in common if order.index(c) != common.index(c)]
    for field in schema.fields:
        kind = lattice_type(field.dataType)
        types = [t for t in map(value_type, sample.values.get(field.name, ())) if t != EMPTY]
        if types and sum(kind in ABOVE[t] for t in types) < fitting * len(types):
            out.append(Difference("retyped", field.name, f"{sample.type_of(field.name)} instead of {kind}"))
    return out


def file_schema(sample: Sample, schema: StructType) -> StructType:
    """``schema`` in the order of the header; columns that it does not know are text."""
    known = {f.name: f for f in schema.fields}
    return StructType([known.get(c, StructField(c, StringType(), True)) for c in sample.columns])
