"""The queries of the general training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import NULL_SPELLINGS, is_null_cell, strip
from auditloom.operators.load_profile import load_changes, load_profile, load_ranges
from auditloom.operators.orphans import life_spans, orphan_counts, orphans
from auditloom.operators.parse_failures import load_records, parse_records, with_failures

RECORD = ("id", "name", "age", "borough", "signup_date", "close_date", "status", "score", "borough_code", "zip_code")
TYPES = {"age": "integer", "score": "float", "signup_date": "day"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, row_key, reason) of every cell of messy_sample and every line of messy_lines that does not parse."""
    sample = with_failures(table(spark, folder, "messy_sample").select("row_id", *TYPES), TYPES)
    cells = sample.select(F.lit("messy_sample").alias("table_name"), F.col("row_id").alias("row_key"), F.explode("__reasons").alias("reason"))
    records = parse_records(table(spark, folder, "messy_lines"), "raw_line", ["line_id"], len(RECORD))
    typed = with_failures(records.select("line_id", "reason", *[F.get("fields", F.lit(RECORD.index(n))).alias(n) for n in TYPES]), TYPES)
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.col("__reasons"))
    each = typed.select("line_id", F.explode(reasons).alias("reason"))
    # A line is one record; were it several, a broken one speaks for the line, and a reason is given once.
    marked = each.groupBy("line_id").agg(F.collect_set("reason").alias("all"))
    worst = F.when(F.array_contains("all", "quoting"), F.array(F.lit("quoting"))).when(F.array_contains("all", "columns"), F.array(F.lit("columns"))).otherwise(F.col("all"))
    lines = marked.select(F.lit("messy_lines").alias("table_name"), F.col("line_id").alias("row_key"), F.explode(worst).alias("reason"))
    return cells.unionByName(lines)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(load_id, column_name, changed) of the loads whose profile departs from the load before."""
    found = load_changes(
        spark,
        table(spark, folder, "messy_sample"),
        "load_id",
        numeric={"age": ("integer", 8.0), "score": ("float", 6.0)},
        patterns={"zip_code": r"\A[0-9]{5}\z"},
        shares={"zip_code": "written", "status": "folded"},
    )
    return found.withColumnRenamed("load", "load_id")


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """(load_id, column_name, rows, null_rate, distinct_values, ranges, misshapen, top_value, top_share) of every load."""
    sample = table(spark, folder, "messy_sample")
    found = load_profile(spark, sample, "load_id", ["age", "score", "zip_code", "status"], numeric={"age": "integer", "score": "float"}, patterns={"zip_code": r"\A[0-9]{5}\z"})
    return found.withColumnRenamed("load", "load_id")


def p2_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(load_id, column_name, distinct_values, low, high) of every load, from dictionaries where these suffice."""
    return load_ranges(spark, table(spark, folder, "messy_sample"), "load_id", ["age", "score", "zip_code", "status"]).withColumnRenamed("load", "load_id")


def _references(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """References (key, at, row_key) and the life spans of their keys, by table."""
    sample = table(spark, folder, "messy_sample")
    codes = table(spark, folder, "borough_reference").select(F.col("code").alias("key"), F.col("created_at").alias("start"), F.col("deleted_at").alias("end"))
    by_code = sample.filter(~is_null_cell(F.col("borough_code"))).select(
        F.upper(strip(F.col("borough_code"))).alias("key"), F.col("loaded_at").alias("at"), F.col("row_id").alias("row_key")
    )
    first_seen = sample.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(F.min("loaded_at").alias("start"))
    people = first_seen.select("key", F.array(F.struct("start", F.lit(None).cast("timestamp_ntz").alias("end"))).alias("spans"), F.col("start").alias("first"))
    by_id = table(spark, folder, "emails").select(F.col("id").alias("key"), F.col("loaded_at").alias("at"), F.col("email_id").alias("row_key"))
    return {"messy_sample": (by_code, life_spans(codes)), "emails": (by_id, people)}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, load_month, row_key, orphan_kind) of every reference to a record that does not exist at its time."""
    a, b = [orphans(refs, spans).withColumn("table_name", F.lit(name)) for name, (refs, spans) in _references(spark, folder).items()]
    return a.unionByName(b).select("table_name", "load_month", "row_key", "orphan_kind")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month and kind, from counts per key and month."""
    a, b = [orphan_counts(refs, spans).withColumn("table_name", F.lit(name)) for name, (refs, spans) in _references(spark, folder).items()]
    return a.unionByName(b).select("table_name", "load_month", "orphan_kind", "orphans")


def load_valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, id, age, score, signup_date) of the lines of messy_lines that load, with the typed cells."""
    good, _ = load_records(table(spark, folder, "messy_lines"), "raw_line", ["line_id"], list(RECORD), TYPES)
    return good.select("line_id", "id", F.col("age").cast("string").alias("age"), "score", F.col("signup_date").cast("string").alias("signup_date"))


def load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, reason, error_offset) of every record of messy_lines that does not load; the offset of a syntax error."""
    _, bad = load_records(table(spark, folder, "messy_lines"), "raw_line", ["line_id"], list(RECORD), TYPES)
    return bad.select("line_id", F.explode("reasons").alias("reason"), "error_offset")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_profile": p2_profile, "p2_ranges": p2_ranges, "p4_found": p4_found, "p4_counts": p4_counts, "load_valid_lines": load_valid_lines, "load_rejects": load_rejects}

# The same in SQL, for a check by another engine.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_SPELLED = ", ".join(f"'{x}'" for x in NULL_SPELLINGS)


def _trim(c: str) -> str:
    return f"trim({c}, {_WS})"


def _null_cell(c: str) -> str:
    return f"({c} IS NULL OR lower({_trim(c)}) IN ({_SPELLED}))"


def _number(c: str) -> str:
    """A finite decimal number, or null."""
    text, pattern = _trim(c), "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match({text}, '{pattern}') AND NOT isinf(TRY_CAST({text} AS DOUBLE)) THEN TRY_CAST({text} AS DOUBLE) END"


def _integer(c: str) -> str:
    v = f"({_number(c)})"
    return f"CASE WHEN abs{v} < 9223372036854775807 AND {v} = floor{v} THEN {v} END"


def _day(c: str) -> str:
    """The day that a cell writes in one of the known forms, with or without midnight, or null."""
    x = f"regexp_replace({_trim(c)}, '[ T]00:00(:00)?$', '')"
    forms = [("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", ["%Y-%m-%d"]), ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", ["%m/%d/%Y", "%d/%m/%Y"]), ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", ["%Y/%m/%d"])]
    forms += [("[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", ["%b %d %Y"]), ("[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}", ["%d %B %Y", "%d %b %Y"]), ("[0-9]{8}", ["%Y%m%d"]), ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", ["%m/%d/%y", "%d/%m/%y"])]
    whens = " ".join(f"WHEN regexp_full_match({x}, '{p}') THEN coalesce({', '.join(f"try_strptime({x}, '{f}')" for f in fs)})" for p, fs in forms)
    return f"CASE {whens} END"


_BAD = {"age": f"{_integer('age')} IS NULL", "score": f"{_number('score')} IS NULL AND NOT regexp_full_match(lower({_trim('score')}), '[+-]?inf(inity)?')", "signup_date": f"{_day('signup_date')} IS NULL"}
_FIELD = '("([^"]|"")*"|[^",]*)'
_LINE_FIELDS = f"regexp_extract_all(',' || raw_line, ',{_FIELD}', 1)"
_LINES = f"""(SELECT line_id, whole, CASE WHEN whole THEN {_LINE_FIELDS} END AS cells FROM (SELECT line_id, coalesce(raw_line, '') AS raw_line, regexp_full_match(coalesce(raw_line, ''), '{_FIELD}(,{_FIELD})*') AS whole FROM messy_lines))"""
_CELLS = f"(SELECT line_id, {', '.join(f"CASE WHEN cells[{RECORD.index(n) + 1}] LIKE '\"%' THEN replace(cells[{RECORD.index(n) + 1}][2:-2], '\"\"', '\"') ELSE cells[{RECORD.index(n) + 1}] END AS {n}" for n in TYPES)} FROM {_LINES} WHERE whole AND len(cells) = 10)"

SQL = {
    "p1_found": " UNION ALL ".join(
        [f"SELECT 'messy_sample' AS table_name, row_id AS row_key, '{n}' AS reason FROM messy_sample WHERE NOT {_null_cell(n)} AND {bad}" for n, bad in _BAD.items()]
        + [f"SELECT 'messy_lines', line_id, '{n}' FROM {_CELLS} WHERE NOT {_null_cell(n)} AND {bad}" for n, bad in _BAD.items()]
        + [f"SELECT 'messy_lines', line_id, CASE WHEN whole THEN 'columns' ELSE 'quoting' END FROM {_LINES} WHERE NOT whole OR len(cells) <> 10"]
    ),
    "p2_found": f"""
        WITH cells AS (
            SELECT load_id, 'age' AS column_name, {_null_cell('age')} AS missing, {_integer('age')} AS v, false AS off, NULL AS form FROM messy_sample
            UNION ALL SELECT load_id, 'score', {_null_cell('score')}, {_number('score')}, false, NULL FROM messy_sample
            UNION ALL SELECT load_id, 'zip_code', {_null_cell('zip_code')}, NULL, NOT regexp_full_match(zip_code, '[0-9]{{5}}'), zip_code FROM messy_sample
            UNION ALL SELECT load_id, 'status', {_null_cell('status')}, NULL, false, regexp_replace(lower(status), '[^\\p{{L}}\\p{{N}}]', '', 'g') FROM messy_sample),
        measured AS (
            SELECT load_id, column_name, avg(missing::INT) AS nulls, avg(off::INT) FILTER (WHERE NOT missing) AS misshapen,
                quantile_cont(v, 0.5) FILTER (WHERE NOT missing) AS mid,
                quantile_cont(v, 0.95) FILTER (WHERE NOT missing) - quantile_cont(v, 0.05) FILTER (WHERE NOT missing) AS width
            FROM cells GROUP BY load_id, column_name),
        profile AS (SELECT *, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS before FROM measured),
        pairs AS (SELECT a.load_id, a.before, a.column_name, a.nulls, b.nulls AS nulls0, a.misshapen, b.misshapen AS misshapen0, a.mid, b.mid AS mid0, a.width, b.width AS width0
            FROM profile a JOIN profile b ON a.before = b.load_id AND a.column_name = b.column_name),
        counted AS (SELECT load_id, column_name, form, count(*) AS n FROM cells WHERE form IS NOT NULL AND NOT missing GROUP BY load_id, column_name, form),
        rates AS (SELECT load_id, column_name, form, n::DOUBLE / sum(n) OVER (PARTITION BY load_id, column_name) AS rate FROM counted),
        forms AS (SELECT DISTINCT column_name, form FROM rates WHERE rate > 0.12),
        shares AS (SELECT p.load_id, p.column_name, coalesce(a.rate, 0) AS now, coalesce(b.rate, 0) AS then_
            FROM pairs p JOIN forms f USING (column_name) LEFT JOIN rates a ON a.load_id = p.load_id AND a.column_name = p.column_name AND a.form = f.form
            LEFT JOIN rates b ON b.load_id = p.before AND b.column_name = p.column_name AND b.form = f.form)
        SELECT load_id, column_name, 'null_rate' AS changed FROM pairs WHERE abs(nulls - nulls0) > 0.08
        UNION ALL SELECT load_id, column_name, 'median' FROM pairs WHERE abs(mid - mid0) > CASE column_name WHEN 'age' THEN 8 ELSE 6 END
        UNION ALL SELECT load_id, column_name, 'spread' FROM pairs WHERE width > 1.6 * width0 OR width0 > 1.6 * width
        UNION ALL SELECT load_id, column_name, 'pattern' FROM pairs WHERE column_name = 'zip_code' AND abs(misshapen - misshapen0) > 0.08
        UNION ALL SELECT DISTINCT load_id, column_name, 'share' FROM shares WHERE abs(now - then_) > 0.12""",
}
_P4 = f"""
    SELECT 'messy_sample' AS table_name, strftime(loaded_at, '%Y-%m') AS load_month, row_id AS row_key,
        CASE WHEN first IS NULL THEN 'missing' WHEN loaded_at < first THEN 'late' ELSE 'deleted' END AS orphan_kind
    FROM messy_sample s LEFT JOIN (SELECT code, min(created_at) AS first FROM borough_reference GROUP BY code) c ON c.code = upper({_trim('s.borough_code')})
    WHERE NOT {_null_cell('s.borough_code')} AND NOT EXISTS (SELECT 1 FROM borough_reference r WHERE r.code = upper({_trim('s.borough_code')})
        AND r.created_at <= s.loaded_at AND (r.deleted_at IS NULL OR s.loaded_at < r.deleted_at))
    UNION ALL
    SELECT 'emails', strftime(e.loaded_at, '%Y-%m'), email_id, CASE WHEN first IS NULL THEN 'missing' ELSE 'late' END
    FROM emails e LEFT JOIN (SELECT id, min(loaded_at) AS first FROM messy_sample GROUP BY id) p ON p.id = e.id
    WHERE e.id IS NOT NULL AND (first IS NULL OR first > e.loaded_at)"""
SQL |= {"p4_found": _P4, "p4_counts": f"SELECT table_name, load_month, orphan_kind, count(*) AS orphans FROM ({_P4}) GROUP BY ALL"}
_SCORE = f"CASE WHEN regexp_full_match(lower({_trim('score')}), '[+-]?inf(inity)?') THEN TRY_CAST({_trim('score')} AS DOUBLE) ELSE {_number('score')} END"
SQL["p2_profile"] = f"""
    WITH cells AS (
        SELECT load_id, 'age' AS column_name, CASE WHEN NOT {_null_cell('age')} THEN age END AS value, {_integer('age')} AS v, NULL::BOOLEAN AS off FROM messy_sample
        UNION ALL SELECT load_id, 'score', CASE WHEN NOT {_null_cell('score')} THEN score END, {_SCORE}, NULL FROM messy_sample
        UNION ALL SELECT load_id, 'zip_code', CASE WHEN NOT {_null_cell('zip_code')} THEN zip_code END, NULL, NOT regexp_full_match(zip_code, '[0-9]{{5}}') FROM messy_sample
        UNION ALL SELECT load_id, 'status', CASE WHEN NOT {_null_cell('status')} THEN status END, NULL, NULL FROM messy_sample),
    counted AS (SELECT load_id, column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
    tops AS (SELECT load_id, column_name, value AS top_value, n::DOUBLE / sum(n) OVER (PARTITION BY load_id, column_name) AS top_share FROM counted
        QUALIFY row_number() OVER (PARTITION BY load_id, column_name ORDER BY n DESC, value) = 1)
    SELECT c.load_id, c.column_name, count(*) AS rows, avg((value IS NULL)::INT) AS null_rate, count(DISTINCT value) AS distinct_values, min(value) AS low, max(value) AS high,
        min(v) FILTER (WHERE value IS NOT NULL) AS lowest, max(v) FILTER (WHERE value IS NOT NULL) AS highest, avg(off::INT) FILTER (WHERE value IS NOT NULL) AS misshapen,
        any_value(top_value) AS top_value, any_value(top_share) AS top_share
    FROM cells c LEFT JOIN tops t ON t.load_id = c.load_id AND t.column_name = c.column_name WHERE c.load_id IS NOT NULL GROUP BY c.load_id, c.column_name"""

_TEXTS = f"(SELECT line_id, {', '.join(f"CASE WHEN cells[{RECORD.index(n) + 1}] LIKE '\"%' THEN replace(cells[{RECORD.index(n) + 1}][2:-2], '\"\"', '\"') ELSE cells[{RECORD.index(n) + 1}] END AS {n}" for n in ('id', *TYPES))} FROM {_LINES} WHERE whole AND len(cells) = 10)"
_FITS = " AND ".join(f"({_null_cell(n)} OR NOT ({bad}))" for n, bad in _BAD.items())
SQL["load_valid_lines"] = f"""
    SELECT line_id, id, CASE WHEN NOT {_null_cell('age')} THEN CAST(CAST({_integer('age')} AS BIGINT) AS VARCHAR) END AS age, CASE WHEN NOT {_null_cell('score')} THEN {_SCORE} END AS score,
        CASE WHEN NOT {_null_cell('signup_date')} THEN strftime({_day('signup_date')}, '%Y-%m-%d') END AS signup_date FROM {_TEXTS} WHERE {_FITS}"""
SQL["p2_ranges"] = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, min({c}) AS low, max({c}) AS high FROM messy_sample WHERE load_id IS NOT NULL AND {c} IS NOT NULL GROUP BY load_id"
    for c in ("age", "score", "zip_code", "status")
)
