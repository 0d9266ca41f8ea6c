"""The frequency relation: how often each value of each column occurs, from one shuffle, shared by many checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from auditloom.functions.text import column

ROW = "__row_id"


def with_row_ids(df: DataFrame) -> DataFrame:
    """The table with a hidden row number that follows the order of the scan."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt, first_row) of the non-null values; doubles are counted with one zero, NaN as null.

    The cells of a row are exploded into (position, text) pairs and combined on the map side, so the shuffle carries one
    row for each distinct value of a task. No columns give an empty relation.
    """
    rows = with_row_ids(df)
    cells = []
    for name in columns:
        c = column(name)
        kind = df.schema[name].dataType
        if isinstance(kind, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        cells.append(F.struct(F.lit(name).alias("column"), c.cast("string").alias("value")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, value string, cnt bigint, first_row bigint")
    long = rows.select(F.col(ROW), F.explode(F.array(*cells)).alias("x")).select(ROW, "x.column", "x.value").filter("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"), F.min(ROW).alias("first_row"))
