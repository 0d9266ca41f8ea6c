import datetime as dt

import pytest

from auditloom.operators.rules import Rule
from auditloom.streaming.monitor import broken_rules, violations_by_window


def test_violations_are_counted_per_window(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(1), 5), (at(2), None), (at(3), 50), (at(11), 60), (at(12), 7)]
    spark.createDataFrame(rows, "at timestamp, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, v int").parquet(str(tmp_path / "in"))
    rules = [Rule("not_null", "v"), Rule("between", "v", {"max_value": 10})]
    counted = violations_by_window(stream, rules, "at")
    counted.writeStream.format("memory").queryName("violations").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["start"].minute, r["rule"], r["violations"]) for r in spark.table("violations").collect())
    assert got == [(0, "between:v", 1), (0, "not_null:v", 1), (10, "between:v", 1)]
    with pytest.raises(ValueError):
        broken_rules(stream, [Rule("unique", "v")])
