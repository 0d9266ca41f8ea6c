"""The general problems: brute force, damaged input, empty tables."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from auditloom.operators.load_profile import cells_by_load, chunk_statistics, load_changes, load_profile, load_ranges
from auditloom.operators.orphans import life_spans, orphan_counts, orphans
from auditloom.operators.parse_failures import RecordGrammar, load_records, parse_records, split_rows
from auditloom.operators.quantiles import column_quartiles, exact_quantiles


def kinds(text, width=3):
    return [("quoting", p.error_offset) if p.fields is None else p.fields for p in RecordGrammar(width).parse(text)]


def test_grammar_reads_quotes_breaks_and_blanks():
    assert kinds('1,"a ""b"", c",x') == [["1", 'a "b", c', "x"]]
    assert kinds('1,"a\nb",x') == [["1", "a\nb", "x"]]
    assert kinds("") == [[""]]
    assert kinds(None) == [[""]]
    assert kinds("1,,") == [["1", "", ""]]


def test_grammar_reports_where_it_breaks():
    assert kinds('1,a"b,x') == [("quoting", 3)]
    assert kinds('1,"a"b,x') == [("quoting", 5)]
    assert kinds('1,"abc,x') == [("quoting", 2)]


def test_grammar_resumes_at_a_valid_record_start():
    assert kinds('1,"a,x\nno record\n2,b,y\n3,c,z') == [("quoting", 2), ["2", "b", "y"], ["3", "c", "z"]]
    assert kinds('1,"a,x\nk,b,y') == [("quoting", 2)]


def test_long_text_parses(spark):
    assert kinds("1," + "a" * 300_000 + ",x")[0][1] == "a" * 300_000


def test_parse_records_keeps_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "1,2", "r"), (2, None, "r"), (2, '"', "r")], "key int, line string, fields string")
    got = sorted((r["key"], r["reason"] or "") for r in parse_records(df, "line", ["key"], 2).collect())
    assert got == [(1, ""), (2, "columns"), (2, "quoting")]
    assert parse_records(df.limit(0), "line", ["key"], 2).count() == 0
    assert parse_records(df, "line", ["fields"], 2).filter("kept_fields = 'r'").count() == 3


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "N/A", "1.5"), (3, "5.5", "2")], "id int, age string, score string")
    good, bad = split_rows(df, {"age": "integer", "score": "float"})
    assert [(r["id"], r["age"], r["score"]) for r in good.collect()] == [(2, None, 1.5)]
    assert {r["id"]: r["__reasons"] for r in bad.collect()} == {1: ["score"], 3: ["age"]}


def test_exact_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 7000)) for v in np.round(rng.normal(size=n), 2)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (200, 20_000):
        got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.95], accuracy).collect()}
        assert set(got) == {"a", "b", "c"}
        for g, q in got.items():
            assert np.allclose(q, np.quantile([v for k, v in rows if k == g and v is not None], [0.05, 0.5, 0.95]))


def _loads(tmp_path):
    """Two files: one answered by footers (a single load, constant or null columns), one that must be scanned."""
    folder = tmp_path / "t"
    folder.mkdir()
    pq.write_table(pa.table({"load": pa.array([1] * 50, pa.int64()), "v": ["x"] * 40 + [None] * 10, "w": pa.array([None] * 50, pa.string())}), folder / "a.parquet")
    pq.write_table(pa.table({"load": pa.array([2] * 30 + [3] * 20, pa.int64()), "v": ["x"] * 25 + ["y"] * 25, "w": ["N/A", "z"] * 25}), folder / "b.parquet")
    return str(folder)


def test_footers_answer_what_they_can(spark, tmp_path):
    path = _loads(tmp_path)
    df = spark.read.parquet(path)
    stats = {(r["path"][-9:], r["column_name"]): r for r in chunk_statistics(spark, df.inputFiles(), "load", ["v", "w"]).collect()}
    assert stats["a.parquet", "v"]["entries"] == ["x"] and stats["a.parquet", "v"]["nulls"] == 10
    assert sorted(stats["b.parquet", "v"]["entries"]) == ["x", "y"]
    cells = cells_by_load(spark, df, "load", ["v", "w"], [])
    got = {(r["load"], r["column_name"], r["value"]): r["n"] for r in cells.groupBy("load", "column_name", "value").agg(F.sum("cnt").alias("n")).collect()}
    assert got[1, "v", "x"] == 40 and got[1, "v", None] == 10 and got[1, "w", None] == 50
    assert got[2, "v", "x"] == 25 and got[3, "v", "y"] == 20
    assert cells.filter("load = 1").count() == 3  # one row for each value: the file was not scanned


def test_load_changes(spark, tmp_path):
    rows = [(1, str(20 + i % 5), "00001") for i in range(100)] + [(2, str(40 + i % 5), "00001") for i in range(100)] + [(3, "N/A", "1") for _ in range(100)]
    path = str(tmp_path / "x")
    spark.createDataFrame(rows, "load bigint, age string, zip string").write.parquet(path)
    found = load_changes(spark, spark.read.parquet(path), "load", {"age": ("integer", 8.0)}, {"zip": r"\A[0-9]{5}\z"}, {"zip": "written"})
    got = sorted((r["load"], r["column_name"], r["changed"]) for r in found.collect())
    assert got == [(2, "age", "median"), (3, "age", "null_rate"), (3, "zip", "pattern"), (3, "zip", "share")]


def test_orphans_by_time_and_heavy_keys(spark):
    at = lambda d: dt.datetime(2023, 1, d)
    keys = spark.createDataFrame([("A", at(2), at(5)), ("A", at(8), None), ("B", at(1), None), (None, at(1), None)], "key string, start timestamp_ntz, end timestamp_ntz")
    refs = [("A", at(d), d) for d in (1, 3, 5, 9)] + [("C", at(1), 20), (None, at(1), 21), ("B", at(1), 22)] + [("A", at(6), 100 + i) for i in range(50)]
    df = spark.createDataFrame(refs, "key string, at timestamp_ntz, row_key bigint")
    for share in (0.002, 0.5):
        got = {r["row_key"]: r["orphan_kind"] for r in orphans(df, life_spans(keys), share).collect()}
        assert got == {1: "late", 5: "deleted", 20: "missing"} | {100 + i: "deleted" for i in range(50)}
    assert orphans(df.limit(0), life_spans(keys)).count() == 0


def test_load_profile(spark, tmp_path):
    df = spark.read.parquet(_loads(tmp_path))
    got = {(r["load"], r["column_name"]): tuple(r)[2:] for r in load_profile(spark, df, "load", ["v", "w"], {}, {"v": r"\Ax\z"}).collect()}
    assert got[1, "v"] == (50, 0.2, 1, "x", "x", None, None, 0.0, "x", 1.0)  # from footer and dictionary
    assert got[1, "w"] == (50, 1.0, 0, None, None, None, None, None, None, None)
    assert got[2, "v"][:5] == (30, 0.0, 2, "x", "y") and got[2, "v"][7:] == (5 / 30, "x", 25 / 30)
    assert got[3, "w"] == (20, 0.5, 1, "z", "z", None, None, None, "z", 1.0) and len(got) == 6
    rows = [(1, a) for a in ("5", "40", "N/A", "x", "5")]
    path = str(tmp_path / "n")
    spark.createDataFrame(rows, "load bigint, age string").write.parquet(path)
    (r,) = load_profile(spark, spark.read.parquet(path), "load", ["age"], {"age": "integer"}, {}).collect()
    assert tuple(r) == (1, "age", 5, 0.2, 3, "40", "x", 5.0, 40.0, None, "5", 0.5)


def test_a_billion_rows_by_footer_alone(spark, tmp_path):
    """Files of one load and no value each: their counts are sums, however many rows they stand for."""
    path = tmp_path / "f"
    path.mkdir()
    for k in range(6):
        n = 200_000
        pq.write_table(pa.table({"load": pa.array([k % 2 + 1] * n, pa.int64()), "v": pa.nulls(n, pa.string()), "s": pa.array(["a"] * n)}), path / f"{k}.parquet")
    df = spark.read.parquet(str(path))
    cells = cells_by_load(spark, df, "load", ["v", "s"], ["v"])
    assert sorted((r["load"], r["column_name"], r["cnt"]) for r in cells.collect()) == [(1, "s", 600_000), (1, "v", 600_000), (2, "s", 600_000), (2, "v", 600_000)]
    assert load_changes(spark, df, "load", {"v": ("integer", 1.0)}, {}, {"s": "written"}).count() == 0


def test_numbers_are_scanned_where_others_come_from_the_footer(spark, tmp_path):
    path = tmp_path / "g"
    path.mkdir()
    pq.write_table(pa.table({"load": pa.array([1] * 100, pa.int64()), "v": ["5"] * 100}), path / "a.parquet")
    pq.write_table(pa.table({"load": pa.array([2] * 100, pa.int64()), "v": ["5"] * 30 + ["9"] * 70}), path / "b.parquet")
    found = load_changes(spark, spark.read.parquet(str(path)), "load", {"v": ("integer", 3.0)}, {}, {})
    assert sorted((r["load"], r["changed"]) for r in found.collect()) == [(2, "median"), (2, "spread")]


def test_column_quartiles(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i % 2 else 1.0, None) for i in range(1, 102)], "a double, b double, c double")
    got = {r["column"]: tuple(r)[1:] for r in column_quartiles(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (26.0, 76.0, 101), "b": (1.0, 1.0, 50)}
    assert column_quartiles(df.limit(0), ["a"]).count() == 0 and column_quartiles(df, []).count() == 0


def test_orphan_counts_agree_with_the_rows(spark):
    at = lambda m, d: dt.datetime(2023, m, d)
    keys = spark.createDataFrame([("A", at(1, 10), at(3, 5)), ("A", at(4, 8), None), ("B", None, at(2, 1)), ("D", at(9, 1), None)], "key string, start timestamp_ntz, end timestamp_ntz")
    refs = [(k, at(m, d), i) for i, (k, m, d) in enumerate((k, m, d) for k in "ABCD" for m in range(1, 7) for d in (1, 5, 9, 20))] + [("A", None, 900), ("C", None, 901), (None, at(1, 1), 902)]
    df = spark.createDataFrame(refs, "key string, at timestamp_ntz, row_key bigint")
    for share in (0.002, 0.2, 0.9):
        rows = orphans(df, life_spans(keys), share).groupBy("load_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = orphan_counts(df, life_spans(keys), share).collect()
        assert {tuple(r) for r in rows} == {tuple(r) for r in counts} and len(rows) == len(counts)
    assert orphan_counts(df.limit(0), life_spans(keys)).count() == 0


def test_load_records(spark):
    lines = ['1,5,x', '2,"a ""b""",y\n3,7,z', '4,bad"quote,z\n5,8,w', "6,9", None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "no int, line string").withColumn("fields", F.lit("f"))
    good, bad = load_records(df, "line", ["no", "fields"], ["k", "v", "t"], {"v": "integer"})
    assert sorted((r["no"], r["k"], r["v"], r["t"]) for r in good.collect()) == [(0, "1", 5, "x"), (1, "3", 7, "z"), (2, "5", 8, "w")]
    assert sorted((r["no"], r["reasons"], r["error_offset"]) for r in bad.collect()) == [(1, ["v"], None), (2, ["quoting"], 5), (3, ["columns"], None), (4, ["columns"], None), (5, ["columns"], None)]
    assert load_records(df.limit(0), "line", ["no"], ["k"], {})[0].count() == 0


def test_fields_without_an_end_are_read_once():
    grammar = RecordGrammar(2)
    text = '1,"' + "\n" * 20 + "\n".join(f'{i},"a' + "\n" * 3 + 'b" ' for i in range(3000))
    assert grammar.parse(text)[0].fields is None
    long = "1,x\n" * 20_000 + '2,"no end' + '\n3,""""""' * 20_000
    assert len(grammar.parse(long)) == 40_001


def test_load_ranges_by_chunk(spark, tmp_path):
    rng = np.random.default_rng(5)
    loads = np.repeat([1, 1, 2, 3, 4], 500)
    values = [None if rng.random() < 0.2 else f"v{rng.integers(0, 40)}" for _ in loads]
    path = tmp_path / "r"
    path.mkdir()
    columns = pa.table({"load": pa.array(loads, pa.int64()), "v": pa.array(values, pa.string()), "w": pa.array([None] * 1000 + ["b"] * 1500, pa.string())})
    pq.write_table(columns, path / "a.parquet", row_group_size=700)  # mixed and single loads in one file
    pq.write_table(columns, path / "b.parquet", row_group_size=500, use_dictionary=["w"])  # no dictionary for v
    pq.write_table(columns, path / "c.parquet", row_group_size=500, dictionary_pagesize_limit=60, data_page_size=200, write_batch_size=20)  # pages that fall back
    df = spark.read.parquet(str(path))
    got = {(r["load"], r["column_name"]): tuple(r)[2:] for r in load_ranges(spark, df, "load", ["v", "w"]).collect()}
    want = {}
    for k in (1, 2, 3, 4):
        own = {v for n, v in zip(loads, values, strict=True) if n == k and v is not None}
        want[k, "v"] = (len(own), min(own), max(own))
        if k > 1:
            want[k, "w"] = (1, "b", "b")
    assert got == want
    stats = {(r["path"][-9:], r["row_group"], r["column_name"]): r["entries"] for r in chunk_statistics(spark, df.inputFiles(), "load", ["v", "w"]).collect()}
    assert stats["a.parquet", 0, "v"] and stats["b.parquet", 2, "w"] == ["b"] and stats["b.parquet", 0, "v"] is None and stats["c.parquet", 0, "v"] is None
    cells = cells_by_load(spark, df, "load", ["v", "w"], [])
    assert {(r["load"], r["column_name"], r["value"]): r["n"] for r in cells.groupBy("load", "column_name", "value").agg(F.sum("cnt").alias("n")).collect()}[1, "w", None] == 3000
    empty = spark.createDataFrame([], "load bigint, v string")
    assert load_ranges(spark, empty, "load", ["v"]).count() == 0
