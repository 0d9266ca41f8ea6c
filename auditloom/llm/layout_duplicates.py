"""Duplicates hidden by formatting differences: canonical form, 128-bit hash, map-side combined counts.

Records are copies when their exact columns are equal as written (nulls equal) and the loose columns, folded to letters
and digits in lower case, are the same values in any order. The canonical text of a record is hashed to 128 bits; an
independent 64-bit hash of the same text travels along as part of the group's key, so that two texts that collide in the
first are kept apart, and ``collisions`` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column, fold


def canonical(exact: list[str], loose: list[str]) -> Column:
    """Canonical text of a record. Every part carries its length, so no two records share a text by concatenation."""
    parts = [F.coalesce(F.concat(F.length(column(c).cast("string")).cast("string"), F.lit(":"), column(c).cast("string")), F.lit("-")) for c in exact]
    folded = F.array_sort(F.array(*[fold(column(c)) for c in loose]))
    return F.concat(*parts, F.lit("|"), F.array_join(folded, "|"))


def hashed(df: DataFrame, row: str, exact: list[str], loose: list[str]) -> DataFrame:
    """(row_id, hash, check): hash is 16 bytes, check 8."""
    text = df.select(column(row).alias("row_id"), canonical(exact, loose).alias("text"))
    return text.select("row_id", F.unhex(F.md5("text")).alias("hash"), F.xxhash64("text").alias("check"))


def copy_groups(df: DataFrame, row: str, exact: list[str], loose: list[str]) -> DataFrame:
    """(hash, check, first_row_id, copies), one row for each distinct record; a group of any size is one combined count."""
    return hashed(df, row, exact, loose).groupBy("hash", "check").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies"))


def collisions(df: DataFrame, row: str, exact: list[str], loose: list[str]) -> DataFrame:
    """128-bit hashes shared by different canonical texts, with the number of texts; empty unless md5 collides."""
    return copy_groups(df, row, exact, loose).groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")


def copies(df: DataFrame, row: str, exact: list[str], loose: list[str]) -> DataFrame:
    """(first_row_id, row_id): one row for each copy but the one with the smallest row id, which is first_row_id.

    Only the groups of more than one record are joined back, one row a group, so that the optimiser can broadcast them
    when they are few or split a hot group's rows over several tasks when they are not.
    Null and empty cells fold alike in the loose columns and differ in the exact ones. Rows without a row id are left
    out. Empty tables give no rows; other columns are not read.
    """
    rows = df.filter(column(row).isNotNull())
    groups = copy_groups(rows, row, exact, loose).filter("copies > 1").select("hash", "check", "first_row_id")
    members = hashed(rows, row, exact, loose).join(groups, ["hash", "check"])
    return members.filter(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")
