"""Validation rules over a stream: the same compiled rules, counted per window of event time behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column
from auditloom.operators.rules import Rule, against


def broken_rules(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with ``broken``, the names (kind:column) of the rules they are against. Stateless, so any output mode.

    Rules about the whole table (unique, row_count_between) are refused.
    """
    marks = [F.when(against(stream, r), F.lit(f"{r.kind}:{r.column}")) for r in rules]
    return stream.withColumn("broken", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))


def violations_by_window(stream: DataFrame, rules: list[Rule], time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, rule, violations) per window; rows later than the watermark are left out, as is all state behind it."""
    marked = broken_rules(stream.withWatermark(time, late), rules)
    each = marked.select(column(time).alias("__time"), F.explode("broken").alias("rule"))
    return each.groupBy(F.window("__time", window), "rule").agg(F.count(F.lit(1)).alias("violations")).select(F.col("window.start").alias("start"), "rule", "violations")
