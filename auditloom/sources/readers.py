"""Sources: delimited text, JSON, XML and workbooks as all-text tables, with placeholders counted and types guessed."""

from __future__ import annotations

import csv
import json
import xml.parsers.expat
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from auditloom.functions.text import column
from auditloom.operators.frequency import ROW, with_row_ids
from auditloom.operators.guess import Guess, blank_placeholders, guess_types
from auditloom.sources.workbook import read_sheet, sheet_names

EXTENSIONS = ("csv", "xlsx", "xls", "xlsm", "json", "xml")
DELIMITERS, HEAD_CHARACTERS = ",;\t|", 8192


class SourceError(ValueError):
    """A file that cannot be read as a table."""


@dataclass
class RawTable:
    df: DataFrame
    guesses: dict[str, Guess]
    placeholders: dict[str, int]
    warnings: list[str] = field(default_factory=list)


def extension(path: str) -> str:
    """The lower-case extension of a readable file; raises for others."""
    found = PurePosixPath(path).suffix.lower().lstrip(".")
    if found not in EXTENSIONS:
        raise SourceError(f"cannot read {found or 'files without extension'!r}; known are {', '.join(EXTENSIONS)}")
    return found


def _bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file, or its first ``most`` bytes, through the session's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise SourceError(f"no file at {path}")
    wanted = system.getFileStatus(at).getLen()
    stream = system.open(at)
    try:
        return bytes(stream.readNBytes(int(wanted if most is None else min(most, wanted))))
    finally:
        stream.close()


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8, else ISO-8859-1, decided by one aggregate over the lines of the file."""
    lines = spark.read.text(path).select(F.is_valid_utf8("value").alias("valid"))
    return "UTF-8" if lines.agg(F.bool_and("valid")).first()[0] is not False else "ISO-8859-1"


def delimiter_of(head: str) -> str:
    """The delimiter of the head of a file; a comma where it cannot be told."""
    try:
        return csv.Sniffer().sniff(head[:HEAD_CHARACTERS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _distinct_names(names: list[str]) -> list[str]:
    """Trimmed names; repeated ones get .1, .2 and so on, empty ones Unnamed: position."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = name.strip() or f"Unnamed: {i}"
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(f"{base}.{n}" if n else base)
    return out


@dataclass
class CsvShape:
    """What the head of a delimited file says of it."""

    names: list[str]
    sep: str
    encoding: str


def _csv_shape(spark: SparkSession, path: str) -> CsvShape:
    encoding = encoding_of(spark, path)
    text = _bytes(spark, path, 4 * HEAD_CHARACTERS).decode("utf-8-sig" if encoding == "UTF-8" else "latin-1", "ignore")
    if not text.strip():
        raise SourceError("the file is empty")
    sep = delimiter_of(text)
    return CsvShape(_distinct_names(next(csv.reader(text.splitlines(), delimiter=sep))), sep, encoding)


def _quotes_span_lines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a quoted field may hold a line break: some line has an odd number of quotes."""
    lines = spark.read.option("encoding", encoding).text(path)
    return bool(lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count())


def _csv_cells(spark: SparkSession, path: str, shape: CsvShape) -> DataFrame:
    """The fields c0, c1 and so on of every record, the first field beyond the header as ``more``, and ``record``, the text
    of a record that does not end there. Absent and empty fields are null.

    A file without line breaks inside quotes is read in parts, by any number of tasks.
    """
    width = len(shape.names)
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)] + [StructField("more", StringType()), StructField("record", StringType())])
    spans = _quotes_span_lines(spark, path, shape.encoding)
    options = {"header": True, "enforceSchema": True, "multiLine": spans, "escape": '"', "sep": shape.sep, "encoding": shape.encoding, "columnNameOfCorruptRecord": "record", "mode": "PERMISSIVE", "columnPruning": False}
    return spark.read.options(**options).schema(schema).csv(path)


def _fields(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def load_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the records that fit the header, the others as (reason, record)): ``columns`` for records of too many fields.

    All cells are text; empty and missing ones are null. One empty field at the end, beyond the header, is no field.
    """
    shape = _csv_shape(spark, path)
    cells = _csv_cells(spark, path, shape)
    known = F.concat_ws(shape.sep, *[F.coalesce(f"c{i}", F.lit("")) for i in range(len(shape.names))], F.col("more"))
    commas = F.regexp_count(F.regexp_replace("record", r'"([^"]|"")*"', ""), F.lit(f"[{shape.sep}]"))
    wide = F.col("more").isNotNull() | F.coalesce(commas >= len(shape.names), F.lit(False))
    rejects = cells.filter(wide).select(F.lit("columns").alias("reason"), F.coalesce("record", known).alias("record"))
    return _fields(cells.filter(~wide), shape.names), rejects


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file of which all fit the header. One with more fields is an error, as nobody knows which of them
    belong to which column; ``load_csv`` separates such records."""
    good, rejects = load_csv(spark, path)
    if rejects.limit(1).count():
        raise SourceError(f"{rejects.count()} records have more fields than the header; load_csv separates them")
    return good


def _json_text(value: Column, kind) -> Column:
    """JSON text of a nested cell with sorted keys and a blank after commas and colons; null stays null."""
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: F.coalesce(_json_text(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    if isinstance(kind, StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            text = _json_text(value.getField(f.name), f.dataType)
            parts.append(F.when(value.getField(f.name).isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), text)))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    if isinstance(kind, MapType):
        return F.to_json(value)
    if isinstance(kind, StringType):
        # The text as the only member of an array, without the brackets: quoted and escaped.
        quoted = F.to_json(F.array(value))
        return F.when(value.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return value.cast("string")


def flatten(df: DataFrame) -> DataFrame:
    """Structs as columns with dotted names, arrays and maps as JSON text with sorted keys, everything else as text."""
    cells = []

    def walk(value, kind, name: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(value.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(kind, (ArrayType, MapType)):
            cells.append(_json_text(value, kind).alias(name))
        else:
            cells.append(value.cast("string").alias(name))

    for f in df.schema.fields:
        walk(column(f.name), f.dataType, f.name)
    return df.select(*cells)


_DAMAGED = "__damaged"


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records of a file of one record a line, the lines that are none as (reason, record)); blank lines are neither."""
    options = {"primitivesAsString": "true", "columnNameOfCorruptRecord": _DAMAGED, "mode": "PERMISSIVE"}
    kinds = [f for f in spark.read.options(**options).json(path).schema.fields if f.name != _DAMAGED]
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("record")).filter(F.trim("record") != "")
    parsed = lines.select("record", F.from_json("record", StructType([*kinds, StructField(_DAMAGED, StringType())]), options).alias("x"))
    bad = F.col("x").isNull() | F.col("x").getField(_DAMAGED).isNotNull()
    good = parsed.filter(~bad).select(*[F.col("x").getField(f.name).alias(f.name) for f in kinds])
    return flatten(good), parsed.filter(bad).select(F.lit("syntax").alias("reason"), "record")


def _first_list(text: str) -> str | None:
    """The name of the first member of an object that is a list with an object in it, in the order of the file."""
    found = json.loads(text)
    return next((k for k, v in found.items() if isinstance(v, list) and any(isinstance(x, dict) for x in v)), None)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, one record a line, or an object that holds a list of records; else one single record.

    In a file of one record a line, a line that is no record is an error; ``json_lines`` gives both kinds of lines.
    """
    head = _bytes(spark, path, 4096).decode("utf-8-sig", "replace").lstrip()
    if head[:1] not in ("[", "{"):
        raise SourceError("the file holds no records")
    reader = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", _DAMAGED)
    if head[0] == "{" and _one_a_line(spark, path, head):
        good, bad = json_lines(spark, path)
        if damaged := bad.count():
            raise SourceError(f"{damaged} lines are no valid JSON; json_lines separates them")
        return good
    whole = reader.option("multiLine", True).json(path)
    if _DAMAGED in whole.columns:
        raise SourceError("the file is no valid JSON")
    if head[0] == "{":
        name = _first_list(_bytes(spark, path).decode("utf-8-sig"))
        if name is not None:
            return flatten(whole.select(F.explode(column(name)).alias("record")).select("record.*"))
    if not whole.columns:
        raise SourceError("the file holds no records")
    return flatten(whole)


#: A larger file is no single JSON document, as one task could not hold it.
LARGEST_DOCUMENT = 256 << 20


def _one_a_line(spark: SparkSession, path: str, head: str) -> bool:
    """Whether a file that begins with an object has more than one line of records, or is no document as a whole."""
    if _is_json(head.splitlines()[0]):
        return spark.read.text(path).filter(F.trim("value") != "").limit(2).count() > 1
    text = _bytes(spark, path, LARGEST_DOCUMENT + 1)
    return len(text) > LARGEST_DOCUMENT or not _is_json(text.decode("utf-8-sig", "replace"))


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def xml_row_tag(content: bytes) -> str:
    """The tag of the root's first child. Entity declarations and external references are refused before any parsing
    of content; text that is no XML is left for the reader to report."""
    depth, tag = 0, ""

    def refuse(*_):
        raise SourceError("the file declares entities, which are not allowed")

    def start(name, _):
        nonlocal depth, tag
        depth += 1
        if depth == 2 and not tag:
            tag = name

    def end(_):
        nonlocal depth
        depth -= 1

    parser = xml.parsers.expat.ParserCreate()
    parser.EntityDeclHandler = refuse
    parser.ExternalEntityRefHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(content, True)
    except xml.parsers.expat.ExpatError as e:
        raise SourceError(f"the file is no valid XML: {e}") from e
    if not tag:
        raise SourceError("the file holds no records")
    return tag


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Children of the root are rows; their attributes and child elements are columns."""
    tag = xml_row_tag(_bytes(spark, path))
    return flatten(spark.read.format("xml").options(rowTag=tag, attributePrefix="", inferSchema=False).load(path))


def read_raw(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A file as an all-text table, by its extension."""
    kind = extension(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return read_json(spark, path)
    if kind == "xml":
        return read_xml(spark, path)
    if kind == "xls":
        raise SourceError("the old binary workbook format needs a library that is not installed; save it as xlsx")
    names, rows = read_sheet(_bytes(spark, path), sheet)
    schema = StructType([StructField(n, StringType()) for n in _distinct_names(names)])
    return spark.createDataFrame(rows, schema)


def first_rows(df: DataFrame, most: int = 10) -> DataFrame:
    """The first rows in the order of the scan: a preview, or the rows up to a cap that the caller asked for."""
    return with_row_ids(df).orderBy(ROW).limit(most).drop(ROW)


def read_table(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int | None = None) -> RawTable:
    """Read, cap if asked to, blank the placeholders and guess the types. A table without rows is an error."""
    df = read_raw(spark, path, sheet)
    df = df.toDF(*_distinct_names(df.columns))
    warnings = []
    if max_rows is not None:
        capped = df.limit(max_rows + 1)
        if capped.count() > max_rows:
            warnings.append(f"only the first {max_rows:,} rows were read")
        df = first_rows(df, max_rows)
    if not df.head(1):
        raise SourceError("the file has no rows")
    cleaned, placeholders = blank_placeholders(df)
    return RawTable(cleaned, guess_types(cleaned), placeholders, warnings)


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    return sheet_names(_bytes(spark, path))
