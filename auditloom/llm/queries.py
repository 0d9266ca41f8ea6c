"""The queries of the language-model training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.coerce import day_of
from auditloom.functions.text import strip
from auditloom.llm.byte_bpe import ByteBpe, load_ranks
from auditloom.llm.canonical_map import canonical_codes
from auditloom.llm.eval_leaks import leaks
from auditloom.llm.layout_duplicates import copies, copy_groups
from auditloom.llm.name_variants import linked_rows
from auditloom.llm.residue import residue

EXACT = ["id", "age", "signup_date", "close_date", "score", "borough_code", "zip_code"]
LOOSE = ["name", "borough", "status"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(first_row_id, row_id) of every record of messy_sample that repeats another but for layout and field order."""
    return copies(table(spark, folder, "messy_sample"), "row_id", EXACT, LOOSE)


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    """(first_row_id, copies) of every distinct record."""
    return copy_groups(table(spark, folder, "messy_sample"), "row_id", EXACT, LOOSE).select("first_row_id", "copies")


def reference_entries(spark: SparkSession, folder: str, field: str) -> list[tuple[str, str]]:
    """(code, name) of a field's reference table, which does not grow with the data."""
    rows = table(spark, folder, f"{field}_reference").select("code", "name").distinct().orderBy("code", "name")
    return [(r["code"], r["name"]) for r in rows.collect()]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id_a, row_id_b) of all rows of messy_sample that belong to one registrant under different spellings."""
    forms = [(r["full_form"], r["short_form"]) for r in table(spark, folder, "name_forms").collect()]
    day = F.coalesce(day_of(F.col("__day")).cast("string"), F.col("signup_date"))
    others = [reference_entries(spark, folder, field) for field in ("borough", "status")]
    sample = table(spark, folder, "messy_sample").withColumn("__day", strip(F.col("signup_date")))
    return linked_rows(sample, "row_id", "name", [F.col("zip_code"), day], forms, others)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, field, code) of every borough and status of messy_sample that is not written as in its reference table."""
    entries = {field: reference_entries(spark, folder, field) for field in ("borough", "status")}
    return canonical_codes(table(spark, folder, "messy_sample"), "row_id", entries)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of every decision under the byte-level vocabulary of 50,256 pieces, without special tokens."""
    return ByteBpe(load_ranks()).encode(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of every decision that repeats a passage of a test item."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of every decision with placeholders, filler, error messages or notices instead of content."""
    return residue(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p3_found": p3_found, "p3_copies": p3_copies, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}

_FOLDED = ", ".join(f"coalesce(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')" for c in LOOSE)
_GROUPED = f"(SELECT row_id, min(row_id) OVER (PARTITION BY {', '.join(EXACT)}, list_sort([{_FOLDED}])) AS first_row_id FROM messy_sample)"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _runs(name: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(words[k:k+11], ' ') AS run FROM (SELECT {key}, words, unnest(range(1, len(words) - 10)) AS k FROM (SELECT {key}, {_WORDS} AS words FROM {name} WHERE text IS NOT NULL)))"


# The same in SQL, where SQL can express it.
SQL = {
    "p3_found": f"SELECT first_row_id, row_id FROM {_GROUPED} WHERE row_id <> first_row_id",
    "p3_copies": f"SELECT first_row_id, count(*) AS copies FROM {_GROUPED} GROUP BY first_row_id",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id')} JOIN {_runs('eval_items', 'item_id')} USING (run)",
}
