"""Queries of the audit's own operators over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.coerce import to_boolean, to_datetime, to_day, to_float, to_integer
from auditloom.functions.schema_store import ConfirmedSchema, confirm
from auditloom.functions.text import NULL_SPELLINGS, is_null_cell
from auditloom.operators import checks as C
from auditloom.operators.frequency import value_frequencies
from auditloom.operators.guess import blank_placeholders, guess_types
from auditloom.operators.profile import TableProfile, distinct_counts, profile_table, top_values, wide_statistics
from auditloom.operators.rules import Rule, baseline_rules, run_rules
from auditloom.operators.typos import typo_claims
from auditloom.plans.audit import Reference, audit
from auditloom.plans.problems import _SCORE, _day, _integer, _null_cell, _number, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(parts: list[tuple], source: DataFrame, names: list[str]) -> DataFrame:
    """One row for each tuple of columns over a one-row table."""
    return source.select(F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, names, strict=True)]) for p in parts])).alias("x")).select("x.*")


def _holed_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 20 != 0, F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderstatus"))})


_HOLED = "(SELECT o_custkey, CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderstatus END AS o_orderstatus FROM orders)"
_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, (count(*) - count({c}))::DOUBLE / count(*) AS null_share FROM {_HOLED}" for c in ("o_custkey", "o_totalprice", "o_orderstatus"))


_HOLED_TYPES = {"o_custkey": "integer", "o_totalprice": "float", "o_orderstatus": "categorical"}


def _null_checks(spark: SparkSession, folder: str, expected: set[str]) -> DataFrame:
    """(column_name, nulls, null_share, flagged) by the null check over the profile."""
    profile = profile_table(_holed_orders(spark, folder).select(*_HOLED_TYPES), _HOLED_TYPES)
    rows = [(c.column, c.affected, profile.columns[c.column].null_share, not c.passed) for c in C.null_checks(profile, expected)]
    return spark.createDataFrame(rows, "column_name string, nulls bigint, null_share double, flagged boolean")


@query(_NULLS)
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _null_checks(spark, folder, set()).select("column_name", "nulls", "null_share")


@query(f"SELECT column_name, nulls, nulls > 0 AS flagged FROM ({_NULLS})")
def null_flags_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _null_checks(spark, folder, set()).select("column_name", "nulls", "flagged")


@query(f"SELECT column_name, nulls, null_share > 0.2 AS flagged FROM ({_NULLS})")
def null_flags_lenient(spark: SparkSession, folder: str) -> DataFrame:
    return _null_checks(spark, folder, set(_HOLED_TYPES)).select("column_name", "nulls", "flagged")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS given, count(DISTINCT {c}) AS distinct_values, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean FROM lineitem" for c in _NUMERIC))
def column_profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(*_NUMERIC)
    stats = wide_statistics(items, dict.fromkeys(_NUMERIC, "float"))
    wide = _rows([(F.lit(c), F.col(f"n_{i}"), F.col(f"lo_{i}"), F.col(f"hi_{i}"), F.round(F.col(f"mean_{i}"), 4)) for i, c in enumerate(_NUMERIC)], stats, ["column_name", "given", "low", "high", "mean"])
    distinct = distinct_counts(value_frequencies(items, list(_NUMERIC))).select(F.col("column").alias("column_name"), F.col("distinct").alias("distinct_values"))
    return wide.join(distinct, "column_name")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank FROM part GROUP BY {c}) WHERE rank <= 10" for c in ("p_brand", "p_type")))
def top_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return top_values(value_frequencies(table(spark, folder, "part"), ["p_brand", "p_type"])).select(F.col("column").alias("column_name"), "value", "cnt", "rank")


@query("SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders")
def datetime_range(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))


@query("SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1) GROUP BY copies")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups = C.duplicate_groups(table(spark, folder, "documents").select("text", "lang"), ["text", "lang"])
    return groups.groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return C.duplicate_groups(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS groups, sum(copies)::BIGINT AS affected FROM (SELECT count(*) AS copies FROM messy_sample GROUP BY id HAVING count(*) > 1)")
def key_duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.duplicate_groups(table(spark, folder, "messy_sample"), ["id"]).agg(F.count(F.lit(1)).alias("groups"), F.sum("copies").alias("affected"))


_FENCED = (("events", "value"), ("customer", "c_acctbal"), ("documents", "n_chars"))
_BOUNDS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t})" for t, c in _FENCED)


def _outlier_checks(spark: SparkSession, folder: str, name: str, c: str, keep: tuple[str, ...] = ()) -> tuple[TableProfile, list[C.CheckResult]]:
    df = table(spark, folder, name).select(*keep, c)
    profile = profile_table(df.select(c), {c: "float"})
    return profile, C.outlier_checks(df, profile)


@query(_BOUNDS)
def iqr_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(c, *profile_table(table(spark, folder, name).select(c), {c: "float"}).columns[c].fences()) for name, c in _FENCED]
    return spark.createDataFrame(rows, "column_name string, low double, high double")


@query(f"SELECT event_id, value FROM events, ({_BOUNDS}) AS b WHERE b.column_name = 'value' AND (value < low OR value > high)")
def outlier_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, (check,) = _outlier_checks(spark, folder, "events", "value", ("event_id",))
    return check.details


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < low OR {c} > high) AS outliers FROM {t}, ({_BOUNDS}) AS b WHERE b.column_name = '{c}'" for t, c in _FENCED))
def outlier_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(check.column, check.affected) for name, c in _FENCED for check in _outlier_checks(spark, folder, name, c)[1]]
    return spark.createDataFrame(rows, "column_name string, outliers bigint")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    k, v = F.col("c_custkey") % 7, F.col("c_mktsegment")
    return c.select("c_custkey", F.when(k == 0, F.lower(v)).when(k == 1, F.concat(v, F.lit(" "))).when(k == 2, F.concat(F.lit("\t"), v)).otherwise(v).alias("segment"))


_SEGMENTS = "(SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' ' WHEN 2 THEN chr(9) || c_mktsegment ELSE c_mktsegment END AS segment FROM customer)"
_KEYED = f"(SELECT lower(trim(segment, ' ' || chr(9))) AS key, segment, count(*) AS cnt FROM {_SEGMENTS} GROUP BY ALL)"


@query(f"SELECT 'segment' AS column_name, key, count(*) AS spellings, sum(cnt)::BIGINT AS affected FROM {_KEYED} GROUP BY key HAVING count(*) > 1")
def variant_groups(spark: SparkSession, folder: str) -> DataFrame:
    vf = value_frequencies(_segments(spark, folder), ["segment"])
    return C.variant_groups(vf, ["segment"]).select(F.col("column").alias("column_name"), "key", "spellings", F.col("rows").alias("affected"))


@query(f"SELECT key, segment AS canonical FROM (SELECT key, segment, row_number() OVER (PARTITION BY key ORDER BY cnt DESC) AS r, count(*) OVER (PARTITION BY key) AS n FROM {_KEYED}) WHERE r = 1 AND n > 1")
def canonical_forms(spark: SparkSession, folder: str) -> DataFrame:
    vf = value_frequencies(_segments(spark, folder), ["segment"])
    return C.variant_groups(vf, ["segment"]).select("key", "canonical")


_BRANDS = "(SELECT lower(p_brand) AS key, count(*) AS cnt FROM part GROUP BY 1)"
_BRAND_CLAIMS = f"(SELECT c.key AS canonical, r.key AS rare, r.cnt AS affected FROM (SELECT key, cnt FROM {_BRANDS} ORDER BY cnt DESC, key LIMIT 1) AS c, {_BRANDS} AS r WHERE r.cnt < c.cnt)"


def _brand_claims(spark: SparkSession, folder: str) -> DataFrame:
    vf = value_frequencies(table(spark, folder, "part"), ["p_brand"])
    claims, _ = typo_claims(vf, ["p_brand"])
    rows = sorted(claims["p_brand"].items())
    return spark.createDataFrame([(k, r) for r, k in rows], "canonical string, rare string")


@query(f"SELECT canonical, rare FROM {_BRAND_CLAIMS}")
def typo_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _brand_claims(spark, folder)


@query(f"SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) IN (SELECT rare FROM {_BRAND_CLAIMS})")
def typo_rows(spark: SparkSession, folder: str) -> DataFrame:
    rare = _brand_claims(spark, folder)
    return table(spark, folder, "part").join(rare, F.lower("p_brand") == F.col("rare"), "left_semi").select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return C.orphan_rows(table(spark, folder, "customer"), "c_custkey", table(spark, folder, "events"), "user_id").select("c_custkey", "c_name")


@query("SELECT count(*) AS orphans FROM emails WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM messy_sample WHERE id IS NOT NULL)")
def fk_orphan_count(spark: SparkSession, folder: str) -> DataFrame:
    return C.orphan_rows(table(spark, folder, "emails"), "id", table(spark, folder, "messy_sample"), "id").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def consistency_violations(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return C.consistency_check(joined.select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate"), "o_orderdate", "l_shipdate").details


def _outcomes(spark: SparkSession, df: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = [(o.rule.kind, o.rule.column, o.status, o.failures) for o in run_rules(df, rules)]
    return spark.createDataFrame(rows, "kind string, column_name string, status string, failures bigint")


def _rule_sql(kind: str, name: str | None, count: str, source: str) -> str:
    shown = f"'{name}'" if name else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{kind}' AS kind, {shown} AS column_name, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n::BIGINT AS failures FROM (SELECT {count} AS n FROM {source})"


@query(_rule_sql("not_null", "o_totalprice", "count(*) - count(o_totalprice)", _HOLED))
def rule_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, _holed_orders(spark, folder), [Rule("not_null", "o_totalprice")])


@query(_rule_sql("unique", "l_orderkey", "coalesce(sum(c), 0)", "(SELECT count(*) AS c FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count(*) > 1)"))
def rule_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, table(spark, folder, "lineitem"), [Rule("unique", "l_orderkey")])


@query(_rule_sql("between", "l_quantity", "count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 40)", "lineitem"))
def rule_between(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, table(spark, folder, "lineitem"), [Rule("between", "l_quantity", {"min_value": 5, "max_value": 40})])


@query(_rule_sql("in_set", "o_orderstatus", "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))", _HOLED))
def rule_in_set(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, _holed_orders(spark, folder), [Rule("in_set", "o_orderstatus", {"value_set": ["F", "O", 1]})])


@query(_rule_sql("regex", "email", "count(*) FILTER (WHERE NOT regexp_matches(email, '^[a-z._-]+[0-9]*@'))", "emails"))
def rule_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, table(spark, folder, "emails"), [Rule("regex", "email", {"regex": "^[a-z._-]+[0-9]*@"})])


@query("SELECT 'row_count_between' AS kind, CAST(NULL AS VARCHAR) AS column_name, CASE WHEN count(*) BETWEEN 10 AND 1000 THEN 'PASS' ELSE 'FAIL' END AS status, 0::BIGINT AS failures FROM orders")
def rule_row_count(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, table(spark, folder, "orders"), [Rule("row_count_between", None, {"min_value": 10, "max_value": 1000})])


_TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_SPELLED = ", ".join(f"'{s}'" for s in NULL_SPELLINGS)
_PLACED = f"({{c}} IS NULL OR lower({_TRIM}) IN ({_SPELLED}))"
_NUMBER = "regexp_full_match(" + _TRIM + ", '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
_DOUBLE = "TRY_CAST(" + _TRIM + " AS DOUBLE)"


def _sql(text: str, c: str) -> str:
    return text.replace("{c}", c)


_FLOAT = f"CASE WHEN NOT {_PLACED} AND {_NUMBER} AND abs({_DOUBLE}) < 'infinity'::DOUBLE THEN {_DOUBLE} END"


@query(_sql(f"SELECT row_id, CAST(x AS BIGINT) AS age FROM (SELECT row_id, {_FLOAT} AS x FROM messy_sample) WHERE x IS NOT NULL AND abs(x) < 9.2e18 AND x = floor(x)", "age"))
def coerce_integer(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "messy_sample")
    return s.select("row_id", F.when(~is_null_cell(F.col("age")), to_integer(F.col("age"))).alias("age")).filter("age is not null")


@query(_sql(f"SELECT row_id, x AS score FROM (SELECT row_id, {_FLOAT} AS x FROM messy_sample) WHERE x IS NOT NULL", "score"))
def coerce_float(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "messy_sample")
    return s.select("row_id", F.when(~is_null_cell(F.col("score")), to_float(F.col("score"))).alias("score")).filter("score is not null")


_BOOLEANS = (" True", "t", "YES", "y ", "1", "False", "F", " no", "N", "0", "maybe", "", "2", "on")


@query(
    "SELECT o_orderkey, CASE WHEN k < 5 THEN true WHEN k < 10 THEN false END AS answer FROM (SELECT o_orderkey, o_orderkey % 14 AS k FROM orders)"
)
def coerce_boolean(spark: SparkSession, folder: str) -> DataFrame:
    """All ten spellings, padded and in either case, and four texts that are none."""
    typed = F.element_at(F.array(*[F.lit(b) for b in _BOOLEANS]), (F.col("o_orderkey") % len(_BOOLEANS)).cast("int") + 1)
    return table(spark, folder, "orders").select("o_orderkey", to_boolean(typed).alias("answer"))


_CLOCKS = ("M/d/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/M/d HH:mm:ss", "d MMMM yyyy HH:mm:ss", "MMM d yyyy h:mm:ss a", "yyyyMMdd HH:mm:ss")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN o_orderdate END AS parsed FROM orders")
def coerce_datetime(spark: SparkSession, folder: str) -> DataFrame:
    """Every order's time in one of seven written forms, and an eighth that is none."""
    k = F.col("o_orderkey") % 8
    written = F.when(k == 7, F.lit("10:30")).when(k == 6, F.col("o_orderdate").cast("string"))
    for i, form in enumerate(_CLOCKS):
        written = written.when(k == i, F.date_format("o_orderdate", form))
    return table(spark, folder, "orders").select("o_orderkey", to_datetime(written).alias("parsed"))


@query(f"SELECT row_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT row_id, {_day('signup_date')} AS day FROM messy_sample WHERE NOT {_null_cell('signup_date')}) WHERE day IS NOT NULL")
def coerce_day(spark: SparkSession, folder: str) -> DataFrame:
    """The day of every cell that is no null cell, in whichever form it is written."""
    s = table(spark, folder, "messy_sample")
    return s.select("row_id", F.when(~is_null_cell(F.col("signup_date")), to_day(F.col("signup_date"))).cast("string").alias("day")).filter("day is not null")


_MESSY = ("name", "age", "borough", "signup_date", "close_date", "status", "score", "borough_code", "zip_code")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_sql(_PLACED, c)}) AS placeholders FROM messy_sample" for c in _MESSY))
def sentinel_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, counts = blank_placeholders(table(spark, folder, "messy_sample").select(*_MESSY))
    return spark.createDataFrame([(c, counts.get(c, 0)) for c in _MESSY], "column_name string, placeholders bigint")


def _guess_sql(c: str) -> str:
    """The type rules over the cells of a column that are no null cells; no column here is boolean."""
    return f"""SELECT '{c}' AS column_name, CASE WHEN n = 0 THEN 'string' WHEN numbers >= 0.95 * n THEN CASE WHEN parts > 0 THEN 'float' ELSE 'integer' END
        WHEN days >= 0.95 * n THEN 'datetime' WHEN kinds <= 200 AND kinds <= 0.5 * n THEN 'categorical' ELSE 'string' END AS semantic
        FROM (SELECT count(*) AS n, count({_number(c)}) AS numbers, count(*) FILTER (WHERE {_number(c)} IS NOT NULL AND {_integer(c)} IS NULL) AS parts,
            count({_day(c)}) AS days, count(DISTINCT {c}) AS kinds FROM messy_sample WHERE NOT {_null_cell(c)})"""


@query(" UNION ALL ".join(_guess_sql(c) for c in _MESSY))
def type_guess(spark: SparkSession, folder: str) -> DataFrame:
    cleaned, _ = blank_placeholders(table(spark, folder, "messy_sample").select(*_MESSY))
    return spark.createDataFrame(sorted((n, g.semantic) for n, g in guess_types(cleaned).items()), "column_name string, semantic string")


_SEMANTIC = {"bigint": "integer", "int": "integer", "double": "float", "string": "string", "timestamp_ntz": "datetime", "timestamp": "datetime"}


def _types(df: DataFrame) -> dict[str, str]:
    return {name: _SEMANTIC[kind] for name, kind in df.dtypes}


def _names_sql(name: str) -> str:
    kind = "CASE data_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' ELSE 'datetime' END"
    return f"(SELECT regexp_replace(column_name, '^[a-z]_', '') AS c, {kind} AS k FROM information_schema.columns WHERE table_name = '{name}')"


@query(
    f"""WITH now AS {_names_sql("supplier")}, was AS {_names_sql("orders")},
        parts AS (SELECT 1 AS o, 'added ' || string_agg(c, ', ' ORDER BY c) AS t FROM now WHERE c NOT IN (SELECT c FROM was)
            UNION ALL SELECT 2, 'removed ' || string_agg(c, ', ' ORDER BY c) FROM was WHERE c NOT IN (SELECT c FROM now)
            UNION ALL SELECT 3, 'changed ' || string_agg(c || ': ' || was.k || ' -> ' || now.k, ', ' ORDER BY c) FROM now JOIN was USING (c) WHERE now.k <> was.k)
        SELECT count(t) = 0 AS passed, coalesce(string_agg(t, '; ' ORDER BY o), 'same columns and types as before') AS summary FROM parts"""
)
def schema_drift(spark: SparkSession, folder: str) -> DataFrame:
    """From the schema of orders to that of supplier, by the names without their prefix."""
    now, was = ({c.split("_", 1)[1]: k for c, k in _types(table(spark, folder, name)).items()} for name in ("supplier", "orders"))
    check = C.schema_drift(now, was)
    return spark.createDataFrame([(check.passed, check.summary)], "passed boolean, summary string")


_CUSTOMER_TYPES = {"c_custkey": "integer", "c_name": "string", "c_acctbal": "float", "c_mktsegment": "categorical"}
_FENCES = "(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM customer)"


@query(
    " UNION ALL ".join(f"SELECT 'not_null' AS kind, '{c}' AS column_name, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::BIGINT AS allowed" for c in _CUSTOMER_TYPES)
    + "".join(f" UNION ALL SELECT 'between', '{c}', q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), NULL FROM {_FENCES.replace('{c}', c)}" for c in ("c_custkey", "c_acctbal"))
    + " UNION ALL SELECT 'unique', 'c_custkey', NULL, NULL, NULL"
    + " UNION ALL SELECT 'in_set', 'c_mktsegment', NULL, NULL, count(*) FILTER (WHERE n >= 0.01 * total) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM customer GROUP BY c_mktsegment) HAVING count(*) FILTER (WHERE n >= 0.01 * total) < count(*)"
)
def baseline_suite(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that the profile of customer suggests."""
    df = table(spark, folder, "customer").select(*_CUSTOMER_TYPES)
    frequencies = value_frequencies(df, list(_CUSTOMER_TYPES))
    rules = baseline_rules(df, profile_table(df, _CUSTOMER_TYPES, frequencies), frequencies, ["c_custkey"], set())
    rows = [(r.kind, r.column, r.params.get("min_value"), r.params.get("max_value"), len(r.params["value_set"]) if "value_set" in r.params else None) for r in rules]
    return spark.createDataFrame(rows, "kind string, column_name string, low double, high double, allowed bigint")


@query("SELECT s.c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 5 ELSE c_nationkey END AS k FROM customer) s WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def fk_coerced_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Keys written as decimals on one side: both take the confirmed type before they meet."""
    c = table(spark, folder, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 5).otherwise(F.col("c_nationkey"))
    main, _ = confirm(c.select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(key.cast("string"), F.lit(".0")).alias("k")), {"c_custkey": "integer", "k": "integer"})
    known, _ = confirm(table(spark, folder, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("k")), {"k": "integer"})
    return C.referential_check(main, "k", known, "k").details.select("c_custkey")


MESSY_TYPES = {
    "id": "integer", "name": "string", "age": "integer", "borough": "categorical", "signup_date": "datetime", "close_date": "datetime",
    "status": "categorical", "score": "float", "borough_code": "categorical", "zip_code": "string",
}


@query()
def findings_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The whole audit of the messy sample: its findings in their order."""
    raw = table(spark, folder, "messy_sample").select(*[F.col(c).cast("string").alias(c) for c in MESSY_TYPES])
    cleaned, placeholders = blank_placeholders(raw)
    done = audit(cleaned, ConfirmedSchema("messy sample", MESSY_TYPES, ["id"]), placeholders, pairs=[("signup_date", "close_date")])
    done.table.unpersist()
    rows = [(i, f.column, f.issue, f.affected, f.finding) for i, f in enumerate(done.findings, 1)]
    return spark.createDataFrame(rows, "place int, column_name string, issue string, affected bigint, finding string")


_TYPED = f"""typed AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS id, {', '.join(f"CASE WHEN NOT {_null_cell(c)} THEN {c} END AS {c}" for c in ('name', 'borough', 'status', 'borough_code', 'zip_code'))},
    CASE WHEN NOT {_null_cell('age')} THEN CAST({_integer('age')} AS BIGINT) END AS age, CASE WHEN NOT {_null_cell('score')} THEN {_SCORE} END AS score,
    {', '.join(f"CASE WHEN NOT {_null_cell(c)} THEN {_day(c)} END AS {c}" for c in ('signup_date', 'close_date'))} FROM messy_sample)"""
_COUNTED = [f"SELECT '{c}' AS column_name, 'Missing values' AS issue, count(*) - count({c}) AS affected FROM typed" for c in MESSY_TYPES]
_COUNTED += [f"SELECT '{c}', 'Placeholder values treated as null', count(*) FILTER (WHERE {_null_cell(f'CAST({c} AS VARCHAR)')}) FROM messy_sample" for c in MESSY_TYPES]
_COUNTED += [f"SELECT '{c}', 'Values not matching the confirmed type', (SELECT count(*) FILTER (WHERE NOT {_null_cell(c)}) FROM messy_sample) - (SELECT count({c}) FROM typed)" for c in ("age", "score", "signup_date", "close_date")]
_COUNTED += [
    f"SELECT '{c}', 'Outliers', count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) FROM (SELECT CAST({c} AS DOUBLE) AS v FROM typed), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM typed)"
    for c in ("id", "age", "score")
]
_COUNTED += [
    f"SELECT NULL, 'Duplicate rows', sum(n) FROM (SELECT count(*) AS n FROM typed GROUP BY {', '.join(MESSY_TYPES)} HAVING count(*) > 1)",
    "SELECT 'id', 'Duplicate keys', sum(n) FROM (SELECT count(*) AS n FROM typed GROUP BY id HAVING count(*) > 1)",
    "SELECT 'close_date, signup_date', 'Cross-column inconsistency', count(*) FROM typed WHERE close_date < signup_date",
    "SELECT 'borough_code', 'Referential integrity break', count(*) FROM typed WHERE borough_code IS NOT NULL AND borough_code NOT IN (SELECT code FROM borough_reference)",
    "SELECT NULL, 'Schema drift', 0",
    "SELECT 'age', 'Values outside the expected range', count(*) FILTER (WHERE age < 25 OR age > 60) FROM typed",
]


@query(f"WITH {_TYPED} SELECT column_name, issue, affected::BIGINT AS affected FROM ({' UNION ALL '.join(_COUNTED)}) WHERE affected > 0 OR issue = 'Schema drift'")
def findings_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of the messy sample against a reference table, an earlier schema and a rule of one's own: what is found,
    without categories, whose spellings and typos SQL does not express."""
    raw = table(spark, folder, "messy_sample").select(*[F.col(c).cast("string").alias(c) for c in MESSY_TYPES])
    cleaned, placeholders = blank_placeholders(raw)
    schema = ConfirmedSchema("messy sample", MESSY_TYPES, ["id"])
    prior = ConfirmedSchema("messy sample", MESSY_TYPES | {"age": "float"}, ["id"])
    references = [Reference("borough_code", table(spark, folder, "borough_reference"), "code")]
    done = audit(cleaned, schema, placeholders, prior, references, [("signup_date", "close_date")], [Rule("between", "age", {"min_value": 25, "max_value": 60})])
    done.table.unpersist()
    rows = [(f.column, f.issue, f.affected) for f in done.findings if f.issue not in ("Inconsistent casing/whitespace", "Possible typos", "Values outside the allowed set")]
    return spark.createDataFrame(rows, "column_name string, issue string, affected bigint")


def _line_findings(items: DataFrame) -> DataFrame:
    """The four basic checks of lineitem as one long table; only their counts reach the driver."""
    types = dict.fromkeys(_NUMERIC, "float")
    profile = profile_table(items.select(*_NUMERIC), types)
    rows = [("nulls", c.column, c.affected) for c in C.null_checks(profile, set())]
    found = {c.column: c.affected for c in C.outlier_checks(items.select(*_NUMERIC), profile)}
    rows += [("outliers", n, found.get(n, 0)) for n in _NUMERIC]
    keys = C.key_duplicates(items, ["l_orderkey", "l_linenumber"])
    return items.sparkSession.createDataFrame([*rows, ("duplicate_keys", keys.column, keys.affected)], "check string, target string, affected bigint")


@query(
    " UNION ALL ".join(f"SELECT 'nulls' AS \"check\", '{c}' AS target, count(*) - count({c}) AS affected FROM lineitem" for c in _NUMERIC)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'outliers', '{c}', count(*) FILTER (WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)" for c in _NUMERIC)
    + " UNION ALL SELECT 'duplicate_keys', 'l_orderkey, l_linenumber', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"
)
def lineitem_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: nulls, outliers and repeated keys of lineitem."""
    return _line_findings(table(spark, folder, "lineitem"))


