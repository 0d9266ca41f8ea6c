"""Column-level data quality profile: footers first, dictionaries next, and a scan only where these do not suffice.

Row groups of Parquet files carry row counts, null counts and extrema; dictionary pages list the distinct values of a
chunk. ``chunk_statistics`` reads both in tasks, one file each, without touching a data page. ``cells_by_load`` turns the
chunks whose value counts follow from that alone (one load only, and all null or one dictionary entry) into value counts;
``load_ranges`` takes distinct values and extrema of all chunks of one load from their dictionaries. Both choose chunk by
chunk and read the data pages of the others only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions.coerce import to_float, to_integer
from auditloom.functions.session import durable
from auditloom.functions.text import column, fold, is_null_cell
from auditloom.operators.quantiles import bracketed, quantiles_between, sketch

CHUNKS = (
    "path string, row_group int, rows bigint, load_low bigint, load_high bigint, column_name string, nulls bigint, "
    "low string, high string, entries array<string>"
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _compact_struct(data: bytes, at: int) -> tuple[dict[int, object], int]:
    """The integer and struct fields of one struct in Thrift's compact protocol; enough for a page header."""
    fields: dict[int, object] = {}
    number = 0
    while data[at] != 0:
        head = data[at]
        at += 1
        kind, step = head & 0x0F, head >> 4
        if step:
            number += step
        else:
            raw, at = _varint(data, at)
            number = (raw >> 1) ^ -(raw & 1)
        if kind in (1, 2):
            fields[number] = kind == 1
        elif kind in (3, 4, 5, 6):
            raw, at = _varint(data, at) if kind != 3 else (data[at], at + 1)
            fields[number] = (raw >> 1) ^ -(raw & 1)
        elif kind == 12:
            fields[number], at = _compact_struct(data, at)
        elif kind == 8:
            size, at = _varint(data, at)
            at += size
        else:
            raise ValueError(f"page header holds field type {kind}")
    return fields, at + 1


#: Encodings of data pages that refer to the dictionary, and the most bytes of a page header.
_BY_DICTIONARY, _HEADER_BYTES = (2, 8), 1 << 16


def _all_pages_refer(source, chunk) -> bool:
    """Whether every data page of a chunk holds indexes into its dictionary, by the page headers alone."""
    at, end = chunk.data_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size
    while at < end:
        source.seek(at)
        try:
            header, body = _compact_struct(source.read(min(_HEADER_BYTES, end - at)), 0)
        except (IndexError, ValueError):
            return False
        page = header.get(5) or header.get(8)
        if not isinstance(page, dict) or page.get(2 if 5 in header else 4) not in _BY_DICTIONARY:
            return False
        at += body + int(header[3])
    return True


def _dictionary(source, chunk, largest: int) -> list[str] | None:
    """Entries of a text chunk's dictionary page, or None if not every data page refers to it or it is too large.

    A writer puts only values into a dictionary that occur, so the entries are the distinct values of the chunk.
    """
    if not chunk.has_dictionary_page or chunk.physical_type != "BYTE_ARRAY":
        return None
    start = chunk.dictionary_page_offset
    size = chunk.data_page_offset - start
    if start is None or size <= 0 or size > largest:
        return None
    source.seek(start)
    raw = source.read(size)
    header, body = _compact_struct(raw, 0)
    if header.get(1) != 2:
        return None
    if not _all_pages_refer(source, chunk):
        return None
    data = raw[body : body + int(header[3])]
    if chunk.compression != "UNCOMPRESSED":
        data = pa.Codec(chunk.compression.lower()).decompress(data, int(header[2])).to_pybytes()
    entries, at = [], 0
    for _ in range(int(header[7][1])):
        length = int.from_bytes(data[at : at + 4], "little")
        entries.append(data[at + 4 : at + 4 + length].decode("utf-8", "replace"))
        at += 4 + length
    return entries


def chunk_statistics(spark: SparkSession, paths: list[str], load: str, columns: list[str], largest_dictionary: int = 1 << 20) -> DataFrame:
    """One row per column chunk of the files: rows, exact nulls, extrema, the range of ``load`` and dictionary entries.

    Nulls and extrema are null where the footer does not hold them; entries are null where the chunk has no text
    dictionary of at most ``largest_dictionary`` bytes. One task reads a share of the files' footers.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["path", "row_group", "rows", "load_low", "load_high", "column_name", "nulls", "low", "high", "entries"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(inner) as source:
                    meta = pq.ParquetFile(source).metadata
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        chunks = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                        s = chunks[load].statistics if load in chunks else None
                        low, high = (s.min, s.max) if s is not None and s.has_min_max and s.null_count == 0 else (None, None)
                        for name in columns:
                            if name not in chunks:
                                continue
                            c = chunks[name]
                            st = c.statistics
                            nulls = st.null_count if st is not None and st.has_null_count else None
                            ext = (str(st.min), str(st.max)) if st is not None and st.has_min_max else (None, None)
                            rows.append((path, g, group.num_rows, low, high, name, nulls, *ext, _dictionary(source, c, largest_dictionary)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return files.mapInArrow(run, CHUNKS)


def _one_load() -> Column:
    """Whether all rows of a chunk are of one load."""
    return F.col("load_low").isNotNull() & (F.col("load_low") == F.col("load_high"))


def _scanned(spark: SparkSession, groups: DataFrame, load: str) -> DataFrame:
    """(load, column_name, value) of the row groups (path, row_group, columns), read chunk by chunk in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, inner = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(inner) as source:
                    for part in pq.ParquetFile(source).iter_batches(65_536, row_groups=[row["row_group"]], columns=[load, *row["columns"]]):
                        at = part.schema.get_field_index(load)
                        for name in row["columns"]:
                            cells = part.column(part.schema.get_field_index(name)).cast(pa.string())
                            names = pa.repeat(pa.scalar(name, pa.string()), len(cells))
                            yield pa.RecordBatch.from_arrays([part.column(at).cast(pa.int64()), names, cells], names=["load", "column_name", "value"])

    tasks = groups.repartition(max(1, min(groups.count(), 10_000)), "path", "row_group")
    return tasks.mapInArrow(run, "load bigint, column_name string, value string")


def _by_chunk(spark: SparkSession, table: DataFrame, load: str, columns: list[str], known: Column) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(chunks that are ``known``, the cells of the other chunks of their files, the files without a known chunk).

    A part is None where it is empty. The driver gets one path for each file with a known chunk; entries stay in tasks.
    """
    paths = table.inputFiles()
    if not paths:
        return None, None, table
    chunks = chunk_statistics(spark, paths, load, columns).withColumn("known", F.coalesce(known, F.lit(False)))
    kept = durable(chunks.select("path", "row_group", "column_name", "known"))
    some = [r["path"] for r in kept.filter("known").select("path").distinct().collect()]
    if not some:
        return None, None, table
    chosen = spark.createDataFrame([(p,) for p in some], "path string")
    mixed = kept.join(chosen, "path", "left_semi").filter("not known").groupBy("path", "row_group").agg(F.sort_array(F.collect_set("column_name")).alias("columns"))
    rest = sorted(set(paths) - set(some))
    return chunks.filter("known"), _scanned(spark, mixed, load), spark.read.schema(table.schema).parquet(*rest) if rest else None


def _cells(table: DataFrame, load: str, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), column(c).alias("value")) for c in columns]))
    return table.select(column(load).alias("load"), cells.alias("x")).select("load", "x.column_name", "x.value")


def cells_by_load(spark: SparkSession, table: DataFrame, load: str, columns: list[str], numeric: list[str]) -> DataFrame:
    """(load, column_name, value, cnt): the text cells of a Parquet table, cnt of them alike; nulls are a value.

    Cells of chunks that footer and dictionary answer come from there, one row for each (load, column, value); those of
    all other chunks are scanned and give one row a cell. A constant of a ``numeric`` column is scanned all the same, so
    that every number is one row and no weight meets a sketch. No shuffle but that of the footers' few rows.
    """
    constant = F.col("nulls").isNotNull() & (F.size("entries") == 1) & ~F.col("column_name").isin(*numeric)
    answered, others, rest = _by_chunk(spark, table, load, columns, _one_load() & ((F.col("nulls") == F.col("rows")) | constant))
    one = F.lit(1).cast("bigint").alias("cnt")
    parts = [] if rest is None else [_cells(rest, load, columns).select("*", one)]
    if answered is not None:
        entry = F.when(F.col("nulls") < F.col("rows"), F.struct(F.element_at("entries", 1).alias("value"), (F.col("rows") - F.col("nulls")).alias("cnt")))
        gap = F.when(F.col("nulls") > 0, F.struct(F.lit(None).cast("string").alias("value"), F.col("nulls").alias("cnt")))
        counts = answered.select(F.col("load_low").alias("load"), "column_name", F.explode(F.array_compact(F.array(entry, gap))).alias("x"))
        parts += [counts.groupBy("load", "column_name", "x.value").agg(F.sum("x.cnt").alias("cnt")), others.select("*", one)]
    return reduce(DataFrame.unionByName, parts)


def load_ranges(spark: SparkSession, table: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load, column_name, distinct_values, low, high) of the text cells as written, nulls aside; all exact.

    Chunks of one load whose pages all refer to a dictionary give its entries, each once; chunks that hold nulls only, by
    their footer, give nothing; all other chunks are scanned. A load without a value in a column is absent, as are null
    loads and empty tables.
    """
    known = _one_load() & (F.col("entries").isNotNull() | (F.col("nulls") == F.col("rows")))
    answered, others, rest = _by_chunk(spark, table, load, columns, known)
    parts = [] if rest is None else [_cells(rest, load, columns)]
    if answered is not None:
        parts += [answered.select(F.col("load_low").alias("load"), "column_name", F.explode("entries").alias("value")), others]
    values = reduce(DataFrame.unionByName, parts).filter("load is not null and value is not null").distinct()
    return values.groupBy("load", "column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"))


def load_profile(spark: SparkSession, table: DataFrame, load: str, columns: list[str], numeric: dict[str, str], patterns: dict[str, str]) -> DataFrame:
    """The profile of every load and column: (load, column_name, rows, null_rate, distinct_values, low, high, lowest,
    highest, misshapen, top_value, top_share).

    ``numeric``: column to integer or float; ``lowest`` and ``highest`` are the range of its cells that coerce. ``patterns``:
    column to the pattern its cells must match as written; ``misshapen`` is the share of those that do not. Distinct
    values (exact), ``low``, ``high`` and the most frequent value (the first of several) are of the cells as written;
    these and the shares are of cells that are no null cells, and null where a load has none. Null loads are left out.
    """
    value, cnt, name = F.col("value"), F.col("cnt"), F.col("column_name")
    counts = cells_by_load(spark, table, load, columns, []).filter(F.col("load").isNotNull()).groupBy("load", "column_name", "value").agg(F.sum("cnt").alias("cnt"))
    number = F.lit(None).cast("double")
    for c, kind in numeric.items():
        number = F.when(name == c, (to_integer if kind == "integer" else to_float)(value).cast("double")).otherwise(number)
    off = F.lit(None).cast("boolean")
    for c, pattern in patterns.items():
        off = F.when(name == c, ~value.rlike(pattern)).otherwise(off)
    given = ~is_null_cell(value)
    marked = counts.select("load", "column_name", "cnt", F.when(given, value).alias("value"), F.when(given, cnt).alias("here"), F.when(given, number).alias("v"), F.when(given, off).alias("off"))
    each = marked.groupBy("load", "column_name").agg(
        F.sum("cnt").alias("rows"),
        F.coalesce(F.sum("here"), F.lit(0)).alias("here"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        F.sum(F.when(F.col("off"), cnt).when(~F.col("off"), 0)).alias("off"),
        F.min(F.when(value.isNotNull(), F.struct((-cnt).alias("less"), value.alias("value")))).alias("top"),
    )
    return each.select(
        "load", "column_name", "rows", ((F.col("rows") - F.col("here")) / F.col("rows")).alias("null_rate"), "distinct_values", "low", "high", "lowest", "highest",
        F.when(F.col("here") > 0, F.col("off") / F.col("here")).alias("misshapen"), F.col("top.value").alias("top_value"), F.when(F.col("here") > 0, -F.col("top.less") / F.col("here")).alias("top_share"),
    )


def load_changes(
    spark: SparkSession,
    table: DataFrame,
    load: str,
    numeric: dict[str, tuple[str, float]],
    patterns: dict[str, str],
    shares: dict[str, str],
    null_rate: float = 0.08,
    spread: float = 1.6,
    misshapen: float = 0.08,
    share: float = 0.12,
    accuracy: int = 20_000,
) -> DataFrame:
    """Loads whose profile departs from that of the load before: (load, column_name, changed), no row twice.

    ``numeric``: column to (integer or float, largest step of the median). ``patterns``: column to the pattern its cells
    must match as written. ``shares``: column to ``written`` or ``folded``, the form in which values are compared.
    Null loads are left out. A measure without a value in one of two loads (no cell coerces, no cell is given) is not
    compared; null rates always are. Ties, repeated rows and extra columns have no influence; an empty table gives none.
    """
    columns = list(dict.fromkeys([*numeric, *patterns, *shares]))
    cells = cells_by_load(spark, table, load, columns, list(numeric)).filter(F.col("load").isNotNull())
    name, value, cnt = F.col("column_name"), F.col("value"), F.col("cnt")
    v = F.lit(None).cast("double")
    for c, (kind, _) in numeric.items():
        v = F.when(name == c, (to_integer if kind == "integer" else to_float)(value).cast("double")).otherwise(v)
    off = F.lit(False)
    for c, pattern in patterns.items():
        off = F.when(name == c, ~value.rlike(pattern)).otherwise(off)
    missing = is_null_cell(value)
    given = cells.select("load", "column_name", "cnt", missing.alias("missing"), F.when(~missing, v).alias("v"), (~missing & off).alias("off"))
    probabilities = [0.05, 0.5, 0.95]
    profile = given.groupBy("load", "column_name").agg(
        F.sum("cnt").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("cnt"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("off"), F.col("cnt"))), F.lit(0)).alias("off"),
        *sketch(F.col("v"), probabilities, accuracy),
    )
    # One row for each load and column; written, since all that follows reads it.
    profile = durable(bracketed(profile, probabilities, accuracy))
    numbers = given.filter(name.isin(*numeric) & F.col("v").isNotNull()).select("load", "column_name", "v")
    quantiles = quantiles_between(numbers, ["load", "column_name"], profile.filter(F.col("n") > 0), probabilities)
    loads = profile.select("load").distinct()
    # The profile is small: one row for each load and column. The order of loads is taken over it, column by column.
    before = Window.partitionBy("column_name").orderBy("load")
    full = profile.join(quantiles, ["load", "column_name"], "left").withColumns({
        "null_rate": F.col("missing") / F.col("rows"),
        "off_rate": F.when(F.col("rows") > F.col("missing"), F.col("off") / (F.col("rows") - F.col("missing"))),
        "median": F.element_at("q", 2),
        "spread": F.element_at("q", 3) - F.element_at("q", 1),
    })
    lagged = full.withColumns({f"p_{m}": F.lag(m).over(before) for m in ("null_rate", "off_rate", "median", "spread")}).withColumn("first", F.row_number().over(before) == 1)
    step = F.lit(None).cast("double")
    for c, (_, largest) in numeric.items():
        step = F.when(name == c, F.lit(largest)).otherwise(step)
    wider = (F.col("spread") > spread * F.col("p_spread")) | (F.col("p_spread") > spread * F.col("spread"))
    marks = [
        F.when(F.abs(F.col("null_rate") - F.col("p_null_rate")) > null_rate, F.lit("null_rate")),
        F.when(F.abs(F.col("median") - F.col("p_median")) > step, F.lit("median")),
        F.when(name.isin(*numeric) & wider, F.lit("spread")),
        F.when(name.isin(*patterns) & (F.abs(F.col("off_rate") - F.col("p_off_rate")) > misshapen), F.lit("pattern")),
    ]
    measured = lagged.filter(~F.col("first")).select("load", "column_name", F.explode(F.array_compact(F.array(*marks))).alias("changed"))
    if not shares:
        return measured
    return measured.unionByName(_share_changes(cells, profile, loads, shares, share))


def _share_changes(cells: DataFrame, profile: DataFrame, loads: DataFrame, shares: dict[str, str], share: float) -> DataFrame:
    """A share can only move by more than the limit if it exceeds the limit in one of the two loads, so at most 1/limit
    values of a load are looked at; everything else stays in the map-side combined counts."""
    name, value = F.col("column_name"), F.col("value")
    form = F.lit(None).cast("string")
    for c, kind in shares.items():
        form = F.when(name == c, fold(value) if kind == "folded" else value).otherwise(form)
    counts = (
        cells.filter(name.isin(*shares) & ~is_null_cell(value))
        .select("load", "column_name", form.alias("form"), "cnt")
        .groupBy("load", "column_name", "form")
        .agg(F.sum("cnt").alias("cnt"))
    )
    totals = profile.filter(name.isin(*shares) & (F.col("rows") > F.col("missing"))).select("load", "column_name", (F.col("rows") - F.col("missing")).alias("given"))
    rated = counts.join(totals, ["load", "column_name"]).select("load", "column_name", "form", (F.col("cnt") / F.col("given")).alias("rate"))
    heavy = rated.filter(F.col("rate") > share).select("column_name", "form").distinct()
    order = Window.partitionBy("column_name").orderBy("load")
    pairs = (
        loads.crossJoin(F.broadcast(loads.sparkSession.createDataFrame([(c,) for c in shares], "column_name string")))
        .withColumn("previous", F.lag("load").over(order))
        .filter(F.col("previous").isNotNull())
        .join(totals.select("load", "column_name"), ["load", "column_name"])
        .join(totals.select(F.col("load").alias("previous"), "column_name"), ["previous", "column_name"])
    )
    of = rated.join(heavy, ["column_name", "form"], "left_semi")
    now = pairs.join(of, ["load", "column_name"]).select("load", "previous", "column_name", "form", F.col("rate").alias("now"), F.lit(0.0).alias("then"))
    then = pairs.join(of.withColumnRenamed("load", "previous"), ["previous", "column_name"]).select("load", "previous", "column_name", "form", F.lit(0.0).alias("now"), F.col("rate").alias("then"))
    moved = now.unionByName(then).groupBy("load", "column_name", "form").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    return moved.filter(F.abs(F.col("now") - F.col("then")) > share).select("load", "column_name", F.lit("share").alias("changed")).distinct()
