"""Exact quantiles of any number of groups without gathering a group: sketch, bracket, count.

A mergeable sketch brackets the rank of each quantile. What lies below a bracket is only counted, the values inside it are
counted one by one. Two scans, combined on the map side; no task and no driver ever holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions.session import durable
from auditloom.functions.text import column

#: Half widths of the brackets offered, in units of the sketch's rank error; a group takes the narrowest that spans
#: three ranks, and all of its values where none does (fewer than 3 * accuracy / 200 of them).
_HALF_WIDTHS = (2, 20, 200)
#: Brackets are broadcast up to this many groups; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def sketch(value: Column, probabilities: list[float], accuracy: int) -> list[Column]:
    """Aggregates n, lowest, highest and ladder: values at ranks around each probability, by a mergeable sketch."""
    ranks = [min(max(p + sign * width / accuracy, 0.0), 1.0) for p in probabilities for width in _HALF_WIDTHS for sign in (-1, 1)]
    ladder = F.percentile_approx(value, F.array(*[F.lit(r) for r in ranks]), F.lit(accuracy))
    return [F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), ladder.alias("ladder")]


def bracketed(sketched: DataFrame, probabilities: list[float], accuracy: int) -> DataFrame:
    """Adds ``ends``: for each probability the two values between which its rank lies."""
    ends = []
    for i in range(len(probabilities)):
        for side, widest in ((1, "lowest"), (2, "highest")):
            end = F.col(widest)
            for j, width in reversed(list(enumerate(_HALF_WIDTHS))):
                at = (i * len(_HALF_WIDTHS) + j) * 2 + side
                end = F.when(F.col("n") * width / accuracy >= 3, F.element_at("ladder", at)).otherwise(end)
            ends.append(end)
    return sketched.withColumn("ends", F.array(*ends)).drop("ladder", "lowest", "highest")


def quantiles_between(rows: DataFrame, group: list[str], brackets: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``v`` per group, given the group's ``n`` and ``ends``.

    ``brackets`` must be cheap to read again (written already). One scan of the rows: those outside all brackets are
    counted, the values inside one (4/accuracy of a large group for each probability) are counted one by one, and the
    neighbours of each rank are read off their running sum. A bracket that misses its rank raises; the sketch's error
    bound rules that out. Columns: the group, then ``q``, an array in the order of ``probabilities``.
    """
    few = brackets.select(*group, "n", "ends")
    small = few.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = rows.join(F.broadcast(few) if small else few, group)
    low = [F.element_at("ends", 2 * i + 1) for i in range(len(probabilities))]
    high = [F.element_at("ends", 2 * i + 2) for i in range(len(probabilities))]
    inside = F.lit(False)
    for a, b in zip(low, high, strict=True):
        inside = inside | ((F.col("v") >= a) & (F.col("v") <= b))
    under = [F.count_if(F.col("v") < a).alias(f"under{i}") for i, a in enumerate(low)]
    counted = near.groupBy(*group, F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("w"), *under)
    each = Window.partitionBy(*group)
    known = counted.withColumns({f"below{i}": F.sum(f"under{i}").over(each) for i in range(len(probabilities))}).filter("v is not null")
    frame = known.join(F.broadcast(few) if small else few, group)
    tops = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.col(f"below{i}").alias("below"), low[i].alias("low"), high[i].alias("high")) for i, p in enumerate(probabilities)]))
    running = Window.partitionBy(*group, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        frame.select(*group, "v", "w", "n", tops.alias("b"))
        .filter((F.col("v") >= F.col("b.low")) & (F.col("v") <= F.col("b.high")))
        .select(*group, F.col("b.i").alias("i"), "v", "w", "n", F.col("b.p").alias("p"), F.col("b.below").alias("below"))
        .withColumn("upto", F.col("below") + F.sum("w").over(running))
    )
    at = F.col("p") * (F.col("n") - 1)
    first, second, before = F.floor(at), F.ceil(at), F.col("upto") - F.col("w")
    picked = ranked.groupBy(*group, "i").agg(
        F.max(F.when((first >= before) & (first < F.col("upto")), F.col("v"))).alias("a"),
        F.max(F.when((second >= before) & (second < F.col("upto")), F.col("v"))).alias("b"),
        F.max(at - first).alias("f"),
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).when(
        F.col("f") == 0, F.col("a")
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("q")))), lambda x: x["q"])
    return picked.groupBy(*group).agg(listed.alias("q"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: list[float], accuracy: int = 20_000) -> DataFrame:
    """Exact quantiles of a column per group: (group..., q, n). Nulls are left out; a group without values is absent."""
    rows = df.filter(column(value).isNotNull()).select(*[column(g) for g in group], column(value).cast("double").alias("v"))
    brackets = durable(bracketed(rows.groupBy(*group).agg(*sketch(F.col("v"), probabilities, accuracy)), probabilities, accuracy))
    return quantiles_between(rows, group, brackets, probabilities).join(brackets.select(*group, "n"), group)


def column_quartiles(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, q1, q3, n) of numeric columns, all from the same two scans; NaN counts as null, a column without values
    is absent."""
    cells = []
    for name in names:
        d = column(name).cast("double")
        cells.append(F.struct(F.lit(name).alias("column"), F.when(~F.isnan(d), d).alias("v")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, q1 double, q3 double, n bigint")
    found = exact_quantiles(df.select(F.explode(F.array(*cells)).alias("x")).select("x.*"), ["column"], "v", [0.25, 0.75])
    return found.select("column", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q3"), "n")
