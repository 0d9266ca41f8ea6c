"""Rows that fail to parse: delimited text by an error-recovering recursive-descent grammar, cells by their types.

    text   := record (break record)*
    record := field (comma field)*
    field  := quoted | bare
    quoted := '"' ( any but '"' | '""' )* '"'
    bare   := ( any but comma, '"' and break )*

A violation of the grammar (a quote inside a bare field, text after a closing quote, a quoted field without an end)
is reported with its offset. The parser then looks for the next line start at which a whole record of the expected
width parses whose first field has the form of a key, and goes on from there; the text between is not read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.coerce import day_of, float_of, integer_of
from auditloom.functions.text import column, is_null_cell, strip, stripped_is_null_cell

_BARE = re.compile(r'[^,"\r\n]*')
_QUOTED_RUN = re.compile(r'[^"]*')
_BREAK = re.compile(r"\r\n|\n|\r")
#: A record with no quote in it needs no descent.
_SIMPLE = re.compile(r'[^"\r\n]*\Z')


_UNENDED = "a closing quote for the field that starts"


class Violation(Exception):
    """The grammar is broken at an offset."""

    def __init__(self, offset: int, expected: str):
        super().__init__(f"{expected} at {offset}")
        self.offset, self.expected = offset, expected


@dataclass
class Parsed:
    """One record or one syntax error; start and end are offsets into the text."""

    start: int
    end: int
    fields: list[str] | None
    error_offset: int | None = None
    expected: str | None = None


class RecordGrammar:
    """Recursive descent over one text; key_pattern and width validate the anchors at which it resumes."""

    def __init__(self, width: int, key_pattern: str = r"\s*[0-9]+\s*"):
        self.width = width
        self.key = re.compile(key_pattern)
        #: Where quoted fields without an end begin in the text at hand, so that none is read to the end twice.
        self.endless: set[int] = set()

    def _quoted(self, text: str, at: int) -> tuple[str, int]:
        parts, start = [], at
        if start in self.endless:
            raise Violation(start, _UNENDED)
        at += 1
        while True:
            run = _QUOTED_RUN.match(text, at)
            parts.append(run.group())
            at = run.end()
            if at >= len(text):
                self.endless.add(start)
                raise Violation(start, _UNENDED)
            if text.startswith('""', at):
                parts.append('"')
                at += 2
                continue
            return "".join(parts), at + 1

    def _field(self, text: str, at: int) -> tuple[str, int]:
        if text.startswith('"', at):
            value, at = self._quoted(text, at)
            if at < len(text) and text[at] not in ",\r\n":
                raise Violation(at, "a comma or line break after the closing quote")
            return value, at
        run = _BARE.match(text, at)
        if text.startswith('"', run.end()):
            raise Violation(run.end(), "no quote inside an unquoted field")
        return run.group(), run.end()

    def _record(self, text: str, at: int) -> tuple[list[str], int]:
        if at == 0 and _SIMPLE.match(text):
            return text.split(","), len(text)
        fields = []
        while True:
            value, at = self._field(text, at)
            fields.append(value)
            if at < len(text) and text[at] == ",":
                at += 1
                continue
            return fields, at

    def _anchor(self, text: str, after: int) -> int | None:
        """The next line start from which a whole valid record can be read."""
        for stop in _BREAK.finditer(text, after):
            try:
                fields, _ = self._record(text, stop.end())
            except Violation:
                continue
            if len(fields) == self.width and self.key.fullmatch(fields[0]):
                return stop.end()
        return None

    def parse(self, text: str | None) -> list[Parsed]:
        """Records and errors in order. Null reads as one empty record; one trailing line break ends the last record."""
        text = text or ""
        self.endless.clear()
        found, at = [], 0
        while True:
            try:
                fields, end = self._record(text, at)
            except Violation as broken:
                resume = self._anchor(text, broken.offset)
                found.append(Parsed(at, len(text) if resume is None else resume, None, broken.offset, broken.expected))
                if resume is None:
                    return found
                at = resume
                continue
            found.append(Parsed(at, end, fields))
            stop = _BREAK.match(text, end)
            if stop is None or stop.end() >= len(text):
                return found
            at = stop.end()


_RECORD_COLUMNS = ("record_no", "start_offset", "end_offset", "reason", "error_offset", "expected", "fields")


def parse_records(df: DataFrame, text: str, keep: list[str], width: int, key_pattern: str = r"\s*[0-9]+\s*") -> DataFrame:
    """Parse each row's text into records, one output row each; Arrow batches, no shuffle.

    Columns: those of ``keep``, then record_no (from 1), start_offset, end_offset, reason (null, ``quoting`` or
    ``columns``), error_offset, expected, fields (array of text; null where the quoting is broken).
    Null and empty texts are one record of one empty field, hence ``columns`` unless width is 1. Other columns of
    the input are not read; a kept one that is named like a column above comes out with ``kept_`` before its name. An empty table gives an empty table.
    """
    source = df.select(*[column(k).alias(f"kept_{k}" if k in _RECORD_COLUMNS else k) for k in keep], column(text).alias("__text"))
    schema = source.schema
    fields = [f"{f.name if f.name.isidentifier() else '`' + f.name.replace('`', '``') + '`'} {f.dataType.simpleString()}" for f in schema.fields[:-1]]
    out = ", ".join([*fields, "record_no int, start_offset int, end_offset int, reason string, error_offset int, expected string, fields array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = RecordGrammar(width, key_pattern)
        tail = pa.schema([
            ("record_no", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("reason", pa.string()),
            ("error_offset", pa.int32()), ("expected", pa.string()), ("fields", pa.list_(pa.string())),
        ])
        for batch in batches:
            origin, rows = [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for no, p in enumerate(grammar.parse(value), 1):
                    reason = "quoting" if p.fields is None else None if len(p.fields) == width else "columns"
                    origin.append(i)
                    rows.append((no, p.start, p.end, reason, p.error_offset, p.expected, p.fields))
            kept = batch.take(pa.array(origin, pa.int64()))
            columns = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(tail)]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *columns], names=[*batch.schema.names[:-1], *tail.names])

    return source.mapInArrow(run, out)


#: How each type used by the failure report reads a trimmed cell.
_READERS = {"integer": integer_of, "float": float_of, "day": day_of}
_REASONS = "__reasons"


def with_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Adds ``__reasons``: the names of the cells that hold something their type cannot take; null cells never fail.

    The trimmed cells are a projection of their own, so that each is trimmed once.
    """
    cells = {f"__cell{i}": (name, kind) for i, (name, kind) in enumerate(types.items())}
    trimmed = df.withColumns({c: strip(column(name)) for c, (name, _) in cells.items()})
    marks = [F.when(~stripped_is_null_cell(F.col(c)) & _READERS[kind](F.col(c)).isNull(), F.lit(name)) for c, (name, kind) in cells.items()]
    return trimmed.withColumn(_REASONS, F.array_compact(F.array(*marks))).drop(*cells)


def split_rows(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that load, with the typed cells in place; rows that do not, with ``__reasons``), one narrow pass each.

    A row loads if none of its cells fails. Null cells load as null. ``types`` maps columns to integer, float or day.
    """
    judged = with_failures(df, types)
    typed = {n: F.when(~is_null_cell(column(n)), _READERS[k](strip(column(n)))) for n, k in types.items()}
    good = judged.filter(F.size(_REASONS) == 0).select(*[typed[c].alias(c) if c in types else column(c) for c in df.columns])
    return good, judged.filter(F.size(_REASONS) > 0)


def load_records(df: DataFrame, text: str, keep: list[str], names: list[str], types: dict[str, str], key_pattern: str = r"\s*[0-9]+\s*") -> tuple[DataFrame, DataFrame]:
    """Load texts of delimited records: (records that load, records that do not).

    The first has the ``keep`` columns and ``names``, with the cells of ``types`` (integer, float or day) typed and null
    cells as null. The second has ``keep``, ``reasons`` (``quoting``, ``columns`` or the names of the failing cells),
    start_offset, end_offset, error_offset and expected. Every record is in one of the two. A kept column that is named
    like one of these comes out as parse_records has it. Null and empty texts are one record of one field.
    """
    parsed = parse_records(df, text, keep, len(names), key_pattern)
    kept = [f"kept_{k}" if k in _RECORD_COLUMNS else k for k in keep]
    cells = {f"__field{i}": n for i, n in enumerate(names)}
    wide = parsed.withColumns({c: F.get("fields", F.lit(i)) for i, c in enumerate(cells)})
    judged = with_failures(wide, {c: types[n] for c, n in cells.items() if n in types})
    failing = F.transform(F.col(_REASONS), lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in cells.items() for x in pair]), c))
    good = judged.filter(F.col("reason").isNull() & (F.size(_REASONS) == 0))
    typed = [F.when(~is_null_cell(F.col(c)), _READERS[types[n]](strip(F.col(c)))).alias(n) if n in types else F.col(c).alias(n) for c, n in cells.items()]
    bad = judged.filter(F.col("reason").isNotNull() | (F.size(_REASONS) > 0))
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(failing)
    return good.select(*[column(k) for k in kept], *typed), bad.select(*[column(k) for k in kept], reasons.alias("reasons"), "start_offset", "end_offset", "error_offset", "expected")
