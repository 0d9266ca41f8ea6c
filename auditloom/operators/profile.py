"""Column and data set profiles: one wide aggregate, and the frequency relation for distinct counts and top values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions.text import column
from auditloom.operators.frequency import value_frequencies
from auditloom.operators.quantiles import column_quartiles

TOP_VALUES, SAMPLES, OUTLIER_DISTINCT, IQR_FACTOR = 10, 5, 10, 1.5


@dataclass
class ColumnProfile:
    name: str
    semantic: str
    nulls: int
    null_share: float
    distinct: int
    distinct_share: float
    low: object = None
    high: object = None
    mean: float | None = None
    quartiles: tuple[float, float] | None = None
    top: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    def fences(self) -> tuple[float, float] | None:
        """Outlier fences, or None for columns of few distinct values, without spread, or with a bound that is no number."""
        if self.quartiles is None or self.distinct < OUTLIER_DISTINCT:
            return None
        q1, q3 = self.quartiles
        spread = q3 - q1
        lo, hi = q1 - IQR_FACTOR * spread, q3 + IQR_FACTOR * spread
        return None if spread == 0 or lo != lo or hi != hi else (lo, hi)


@dataclass
class TableProfile:
    rows: int
    columns: dict[str, ColumnProfile]


def wide_statistics(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: rows, and for column i n_i, lo_i, hi_i, mean_i, as far as its type has them."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, (name, kind) in enumerate(types.items()):
        c = column(name)
        if kind == "float":
            c = F.when(~F.isnan(c), c)
        parts.append(F.count(c).alias(f"n_{i}"))
        if kind in ("integer", "float"):
            d = c.cast("double")
            parts += [F.min(d).alias(f"lo_{i}"), F.max(d).alias(f"hi_{i}"), F.avg(d).alias(f"mean_{i}")]
        elif kind == "datetime":
            parts += [F.min(c).cast("string").alias(f"lo_{i}"), F.max(c).cast("string").alias(f"hi_{i}")]
    return df.agg(*parts)


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def top_values(frequencies: DataFrame, most: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of each column, ties by value, with their rank."""
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    return frequencies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def profile_table(df: DataFrame, types: dict[str, str], frequencies: DataFrame | None = None) -> TableProfile:
    """Profile of the typed columns; a few small jobs, whatever the number of columns. Empty tables profile as zeros."""
    vf = value_frequencies(df, list(types)).persist(StorageLevel.MEMORY_AND_DISK) if frequencies is None else frequencies
    stats = wide_statistics(df, types).first()
    order = Window.partitionBy("column").orderBy("first_row", "value")
    early = {}
    for r in vf.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLES).select("column", "value", "rank").collect():
        early.setdefault(r["column"], []).append((r["rank"], r["value"]))
    tops = {}
    categorical = [n for n, k in types.items() if k == "categorical"]
    for r in top_values(vf.filter(F.col("column").isin(*categorical))).collect() if categorical else ():
        tops.setdefault(r["column"], []).append((r["rank"], r["value"], r["cnt"]))
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(vf).collect()}
    if frequencies is None:
        vf.unpersist()
    quartiles = {r["column"]: (r["q1"], r["q3"]) for r in column_quartiles(df, [n for n, k in types.items() if k in ("integer", "float")]).collect()}
    rows = stats["rows"]
    columns = {}
    for i, (name, kind) in enumerate(types.items()):
        given, d = stats[f"n_{i}"], distinct.get(name, 0)
        p = ColumnProfile(name, kind, rows - given, (rows - given) / rows if rows else 0.0, d, d / given if given else 0.0)
        if kind in ("integer", "float"):
            p.low, p.high, p.mean, p.quartiles = stats[f"lo_{i}"], stats[f"hi_{i}"], stats[f"mean_{i}"], quartiles.get(name)
        elif kind == "datetime":
            p.low, p.high = stats[f"lo_{i}"], stats[f"hi_{i}"]
        p.top = [(v, n) for _, v, n in sorted(tops.get(name, []))]
        p.samples = [v for _, v in sorted(early.get(name, []))]
        columns[name] = p
    return TableProfile(rows, columns)
