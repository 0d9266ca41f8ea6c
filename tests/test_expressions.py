import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.functions.coerce import coerced, to_boolean, to_datetime, to_day, to_float, to_integer
from auditloom.functions.text import fold, is_null_cell, quoted, strip


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_takes_all_unicode_white_space(spark):
    assert column(spark, [" a\tb ", " \t\n", None, "　x\x1f"], strip) == ["a\tb", "", None, "x"]


def test_null_cells(spark):
    got = column(spark, [None, "", " N/A ", "NaN", "not available", "-", "n", "0", "null "], is_null_cell)
    assert got == [True, True, True, True, True, True, False, False, True]


def test_fold(spark):
    assert column(spark, ["O'Brien-Ünal 2", None, "...", "É x"], fold) == ["obrienünal2", "", "", "éx"]


def test_float_grammar(spark):
    got = column(spark, ["1d", "1f", "1e400", "nan", "inf", "+-7", "3.0e1", "27.", ".5", "", None, "1 0"], to_float)
    assert got == [None, None, None, None, float("inf"), None, 30.0, 27.0, 0.5, None, None, None]


def test_integer_of_the_reference_cases(spark):
    got = column(spark, ["1", "2.5", "1e20", "inf", "-inf", "7", None, "1.0", "1e3", "9007199254740993", "9223372036854775808"], to_integer)
    assert got == [1, None, None, None, None, 7, None, 1, 1000, 9007199254740993, None]


def test_boolean(spark):
    assert column(spark, ["Yes", "no", "YES", "maybe", None, "1", "f"], to_boolean) == [True, False, True, None, None, True, False]


def test_days(spark):
    got = column(spark, ["2022-12-30", "01/02/2020", "13/02/2020", "Feb 29 2023", "5 January 2020", "20200101", "2022-02-30", "2022-11-3l", "2020-01-02 00:00:00", "2020-01-02 10:00:00", "today", None], to_day)
    d = dt.date
    assert got == [d(2022, 12, 30), d(2020, 1, 2), d(2020, 2, 13), None, d(2020, 1, 5), d(2020, 1, 1), None, None, d(2020, 1, 2), None, None, None]


def test_datetimes(spark):
    got = column(spark, ["2020-01-01", "2020-1-5 10:00 PM", "not a date", "10:30", "2020-01-01T10:00:00"], to_datetime)
    assert got == [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 5, 22), None, None, dt.datetime(2020, 1, 1, 10)]


def test_unknown_type_is_refused():
    with pytest.raises(ValueError):
        coerced(None, "decimal")


def test_names_are_quoted():
    assert quoted("a`b.c") == "`a``b.c`"


def test_the_day_query_reads_every_form(spark, tmp_path):
    from auditloom.plans.audit_queries import coerce_day

    cells = ["2020-01-05", "1/5/2020", "2020/1/5", "20200105", "Jan 5 2020", "5 January 2020", " 2020-01-05 ", "2020-02-30", "N/A", None]
    spark.createDataFrame(list(enumerate(cells)), "row_id bigint, signup_date string").write.parquet(str(tmp_path / "messy_sample.parquet"))
    assert sorted(map(tuple, coerce_day(spark, str(tmp_path)).collect())) == [(i, "2020-01-05") for i in range(7)]
