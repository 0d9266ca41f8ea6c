"""References to records that do not exist: an anti-join in time, split by the weight of the keys.

Every key has spans of life in its table. A reference is an orphan when no span covers its time: ``missing`` if the key
has none at all, ``late`` if it comes before the first, else ``deleted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def life_spans(keys: DataFrame) -> DataFrame:
    """(key, spans, first) from rows (key, start, end): one row a key, aggregated on the map side.

    Null keys are left out; a null end is a life without end; a null start is a life from the beginning of time.
    Repeated spans are kept once.
    """
    start = F.coalesce(F.col("start"), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))
    rows = keys.filter(F.col("key").isNotNull()).select("key", start.alias("start"), "end")
    return rows.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.min("start").alias("first"))


def orphan_kind(at: Column, spans: Column, first: Column) -> Column:
    """null if a span covers the time, else missing, late or deleted. A null time is covered by any span."""
    covered = F.exists(spans, lambda s: at.isNull() | ((s["start"] <= at) & (s["end"].isNull() | (at < s["end"]))))
    return F.when(spans.isNull(), F.lit("missing")).when(covered, F.lit(None)).when(at < first, F.lit("late")).otherwise(F.lit("deleted"))


def by_period(references: DataFrame) -> DataFrame:
    """(key, load_month, refs, first_at, last_at) of references (key, at, row_key), combined on the map side."""
    month = F.date_format("at", "yyyy-MM").alias("load_month")
    return references.groupBy("key", month).agg(F.count(F.lit(1)).alias("refs"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def heavy_keys(periods: DataFrame, share: float) -> list:
    """Keys that take more than a share of all references: fewer than 1/share of them, whatever the table's size."""
    weights = periods.groupBy("key").agg(F.sum("refs").alias("refs"))
    total = weights.agg(F.sum("refs").alias("total"))
    found = weights.join(F.broadcast(total), F.col("refs") > share * F.col("total")).select("key").limit(int(1 / share) + 1)
    return [r["key"] for r in found.collect()]


def _split(df: DataFrame, hot: list) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the heavy keys or None, the others)."""
    if not hot:
        return None, df
    return df.filter(F.col("key").isin(*hot)), df.filter(~F.col("key").isin(*hot))


def orphans(references: DataFrame, spans: DataFrame, share: float = 0.002) -> DataFrame:
    """(row_key, load_month, orphan_kind) of the references (key, at, row_key) that no span of their key covers.

    Null keys are no references. Keys above ``share`` of all references, fewer than 1/share, are looked up in a
    broadcast of just their spans; all others are joined by a shuffle on the key, where no key can be hot any more.
    """
    live = references.filter(F.col("key").isNotNull())
    hot = heavy_keys(by_period(live), share)
    heavy, light = _split(live, hot)
    joined = light.join(spans, "key", "left")
    if heavy is not None:
        joined = joined.unionByName(heavy.join(F.broadcast(_split(spans, hot)[0]), "key", "left"))
    kind = orphan_kind(F.col("at"), F.col("spans"), F.col("first"))
    return (
        joined.select("row_key", F.date_format("at", "yyyy-MM").alias("load_month"), kind.alias("orphan_kind"))
        .filter(F.col("orphan_kind").isNotNull())
    )


def orphan_counts(references: DataFrame, spans: DataFrame, share: float = 0.002) -> DataFrame:
    """(load_month, orphan_kind, orphans) of the references (key, at, row_key), from counts per key and month.

    The counts of the heavy keys meet a broadcast of their spans; of the others, those without a key come from an anti
    join by shuffle, the rest from a join. A month in which no span of its key begins or ends is decided as a whole;
    only the references of the other months are looked at one by one. Null keys are no references.
    """
    live = references.filter(F.col("key").isNotNull())
    periods = by_period(live)
    hot = heavy_keys(periods, share)
    heavy, light = _split(periods, hot)
    missing = light.join(spans, "key", "left_anti").select("load_month", F.lit("missing").alias("orphan_kind"), "refs")
    known = light.join(spans, "key")
    if heavy is not None:
        looked_up = heavy.join(F.broadcast(_split(spans, hot)[0]), "key", "left")
        missing = missing.unionByName(looked_up.filter(F.col("spans").isNull()).select("load_month", F.lit("missing").alias("orphan_kind"), "refs"))
        known = known.unionByName(looked_up.filter(F.col("spans").isNotNull()))
    turn = lambda at: at.isNotNull() & (F.col("first_at") < at) & (at <= F.col("last_at"))
    turns = F.coalesce(F.exists("spans", lambda s: turn(s["start"]) | turn(s["end"])), F.lit(False))
    whole = known.filter(~turns).select("load_month", orphan_kind(F.col("first_at"), F.col("spans"), F.col("first")).alias("orphan_kind"), "refs").filter("orphan_kind is not null")
    mixed = known.filter(turns).select("key", "load_month")
    rows = live.withColumn("load_month", F.date_format("at", "yyyy-MM")).join(mixed, ["key", "load_month"], "left_semi").drop("load_month")
    singles = orphans(rows, spans, share).select("load_month", "orphan_kind", F.lit(1).cast("bigint").alias("refs"))
    every = missing.unionByName(whole).unionByName(singles)
    return every.groupBy("load_month", "orphan_kind").agg(F.sum("refs").alias("orphans"))
