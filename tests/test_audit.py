"""The audit on small tables: each check, the rules, the findings, the sources and the reports."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom.functions.schema_store import ConfirmedSchema, best_match, confirm, save, saved
from auditloom.operators import checks as C
from auditloom.operators.findings import rank_findings, sections
from auditloom.operators.frequency import value_frequencies
from auditloom.operators.guess import blank_placeholders, guess_types
from auditloom.operators.profile import profile_table
from auditloom.operators.rules import Rule, run_rules
from auditloom.operators.typos import MOST_VALUES, resolve, typo_checks
from auditloom.plans.audit import Reference, audit
from auditloom.sources.readers import SourceError, delimiter_of, extension, first_rows, json_lines, list_sheets, load_csv, read_raw, read_table, xml_row_tag
from auditloom.sources.workbook import read_sheet, write_workbook


def text(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{n}` string" for n in names))


def counted(spark, **values):
    rows = [(v,) for v, n in values.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string")


def test_null_limits_are_strict(spark):
    df = spark.createDataFrame([(float(i) if i else None,) for i in range(5)], "a double")
    p = profile_table(df, {"a": "float"})
    assert not C.null_checks(p, set())[0].passed
    assert C.null_checks(p, {"a"})[0].passed  # exactly a fifth


def test_duplicates_count_every_copy_and_group_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "z")], "id int, v string")
    assert (C.exact_duplicates(df).affected, C.key_duplicates(df, ["id"]).affected) == (2, 4)
    assert C.key_duplicates(df, []) is None
    assert C.exact_duplicates(df.limit(0)).passed


def test_outliers_need_ten_values_and_a_spread(spark):
    df = spark.createDataFrame([(v, r, 1) for v, r in zip([*range(1, 13), 999], [1, 2, 3, 4, 5] * 2 + [1, 2, 3], strict=True)], "v int, r int, k int")
    p = profile_table(df, dict.fromkeys(("v", "r", "k"), "integer"))
    found = C.outlier_checks(df, p)
    assert [(c.check, c.affected, c.details.count()) for c in found] == [("outliers:v", 1, 1)]


def test_infinite_values_give_no_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(12)] + [(float("inf"),)] * 12, "v double")
    assert all(c.passed for c in C.outlier_checks(df, profile_table(df, {"v": "float"})))


def test_variants_and_their_canonical_form(spark):
    df = counted(spark, Manhattan=3, MANHATTAN=1, Brooklyn=2).unionByName(counted(spark, **{"manhattan ": 1}))
    vf = value_frequencies(df, ["c"])
    groups = C.variant_groups(vf, ["c"]).collect()
    assert [(r["key"], r["spellings"], r["rows"], r["canonical"]) for r in groups] == [("manhattan", 3, 5, "Manhattan")]
    assert C.variant_checks(df, vf, ["c"])[0].details.count() == 5


@pytest.mark.parametrize(
    ("values", "affected"),
    [({"Manhattan": 10, "Manhattn": 1}, 1), ({"cat": 5, "cot": 5}, None), ({"hello": 10, "xyzabc": 1}, None), ({"good": 7, "poor": 4}, 4)],
)
def test_typos(spark, values, affected):
    df = counted(spark, **values)
    found = typo_checks(df, value_frequencies(df, ["c"]), ["c"])
    assert [c.affected for c in found] == ([affected] if affected else [])
    if affected:
        assert typo_checks(df, value_frequencies(df, ["c"]), ["c"], {"c": {min(values, key=values.get)}}) == []


def test_claimed_values_claim_nothing():
    assert resolve([("aaaa", 9, "aabb", 5), ("aabb", 5, "bbbb", 2)]) == {"aabb": "aaaa"}


def test_too_many_values_are_skipped(spark):
    df = spark.range(MOST_VALUES + 50).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    (check,) = typo_checks(df, value_frequencies(df, ["c"]), ["c"])
    assert check.passed and check.summary.startswith("Skipped")


def test_schema_drift():
    assert C.schema_drift({"a": "string"}, None).passed
    assert not C.schema_drift({"a": "string"}, {"a": "float"}).passed
    assert C.schema_drift({"a": "string"}, {"a": "string"}).passed


def test_references_and_spans(spark):
    main = text(spark, k=["1", "2", "x", None])
    ref = text(spark, code=["1.0", "2", "3", None])
    done = audit(main, ConfirmedSchema("m", {"k": "integer"}), references=[Reference("k", ref, "code")])
    check = next(c for c in done.checks if c.kind == "referential")
    assert check.passed and done.coercion_failures == {"k": 1}
    assert C.referential_check(main, "k", ref.filter("code = '2'"), "code").affected == 2
    days = text(spark, opened=["2020-01-02", None, "2020-01-01"], closed=["2020-01-01", "2020-01-01", "2020-01-01"])
    table, _ = confirm(days, {"opened": "datetime", "closed": "datetime"})
    assert C.consistency_check(table, "opened", "closed").affected == 1
    assert C.suggest_pairs({"signup_date": "datetime", "close_date": "datetime", "x": "string"}) == [("signup_date", "close_date")]


def test_rules_and_their_errors(spark):
    df = spark.createDataFrame([(i, str(i), float(i) if i else None) for i in range(30)] + [(0, "q", None)], "id int, s string, n double")
    rules = [
        Rule("unique", "id"), Rule("not_null", "n"), Rule("between", "n", {"max_value": 20}), Rule("in_set", "id", {"value_set": [1, 2, "x"]}),
        Rule("regex", "s", {"regex": "^[0-9]+$"}), Rule("row_count_between", None, {"min_value": 5}), Rule("regex", "s", {"regex": "["}),
        Rule("not_null", "missing"), Rule("between", "n", {}), Rule("between", "s", {"min_value": 1}), Rule("odd", "s"),
    ]
    got = run_rules(df, rules)
    assert [o.failures for o in got[:6]] == [2, 2, 9, 29, 1, 0]
    assert [o.status for o in got] == ["FAIL"] * 5 + ["PASS"] + ["ERROR"] * 5
    assert "Invalid regular expression" in got[6].error


def messy(spark):
    rows = [(str(i), f"Name {i}", str(20 + i % 40), ["North", "Harbour", "north "][i % 3], "2020-01-02", "2020-02-03" if i % 9 else "2019-01-01") for i in range(60)]
    rows += [rows[0], ("7", "Again", "999", "Noth", "2020-01-02", "N/A")]
    return spark.createDataFrame(rows, "id string, name string, age string, area string, signup string, closed string")


TYPES = {"id": "integer", "name": "string", "age": "integer", "area": "categorical", "signup": "datetime", "closed": "datetime"}


def test_whole_audit(spark):
    raw = messy(spark)
    before = raw.collect()
    cleaned, placeholders = blank_placeholders(raw)
    custom = [Rule("unique", "name"), Rule("regex", "name", {"regex": "("})]
    done = audit(cleaned, ConfirmedSchema("t <x>", TYPES, ["id"]), placeholders, pairs=[("signup", "closed")], custom_rules=custom)
    failed = {c.check: c.affected for c in done.checks if not c.passed}
    assert failed == {
        "nulls:closed": 1, "duplicates:exact_rows": 2, "duplicates:key[id]": 4, "outliers:age": 1, "categorical_standardization:area": 41,
        "typos:area": 1, "consistency:closed>=signup": 8,
    }
    assert all(c.affected <= done.profile.rows for c in done.checks)
    assert {o.rule.source for o in done.outcomes} == {"auto", "custom"}
    issues = [f.issue for f in done.findings]
    assert issues.count("Missing values") == 1 and "Values that should be unique repeat" in issues and "Validation rule could not run" in issues
    assert [f.affected for f in done.findings] == sorted((f.affected for f in done.findings), reverse=True)
    between = next(o for o in done.outcomes if o.rule.kind == "between" and o.rule.column == "age")
    assert between.failures == failed["outliers:age"]
    assert raw.collect() == before
    shuffled = audit(cleaned.repartition(7), ConfirmedSchema("t", TYPES, ["id"]), placeholders, pairs=[("signup", "closed")])
    assert {c.check: c.affected for c in shuffled.checks} == {c.check: c.affected for c in done.checks}
    reports = done.reports()
    assert b"t &lt;x&gt;" in reports["t_x_report.html"] and b"| Column |" in reports["t_x_actions.md"]
    names, rows = read_sheet(reports["t_x_scorecard.xlsx"], "Column Profile")
    assert names[0] == "Column" and len(rows) == 6
    assert [k for k, *_ in sections(done.checks)][:2] == ["nulls", "duplicates"]


def test_empty_table(spark):
    done = audit(messy(spark).limit(0), ConfirmedSchema("e", TYPES, ["id"]))
    assert all(c.passed for c in done.checks) and done.findings == []
    assert rank_findings([], [], {}, {}, 0) == []


def test_odd_names_and_repeated_zeros(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, None)], "`a.b``c` double, A string")
    p = profile_table(df, {"a.b`c": "float", "A": "string"})
    assert p.columns["a.b`c"].distinct == 1 and p.columns["A"].nulls == 1


def test_guesses(spark):
    n = 40
    df = text(spark, i=[str(k) for k in range(n)], f=["1.5"] * n, b=["Yes", "no"] * (n // 2), z=["0", "1"] * (n // 2), d=["2020-01-01"] * n, c=["a", "b"] * (n // 2), s=[f"t{k}" for k in range(n)], e=[None] * n)
    assert {k: g.semantic for k, g in guess_types(df).items()} == {"i": "integer", "f": "float", "b": "boolean", "z": "integer", "d": "datetime", "c": "categorical", "s": "string", "e": "string"}


def test_schema_store(tmp_path):
    a = ConfirmedSchema("My Table", {"a": "string", "b": "float"}, ["a"])
    path = save(a, str(tmp_path))
    (tmp_path / "bad_confirmed_schema.json").write_text("{")
    assert path.name == "my_table_confirmed_schema.json" and saved(str(tmp_path)) == [a]
    assert best_match(["a", "b", "c", "d"], [a]) == a and best_match(["a", "c", "d"], [a]) is None
    assert ConfirmedSchema.from_json('{"dataset_name": "x", "column_types": {}}').key_columns == []


def test_sources(spark, tmp_path):
    def file(name, content):
        (tmp_path / name).write_bytes(content)
        return str(tmp_path / name)

    t = read_table(spark, file("a.csv", 'x;y;x\n1;"a;""b""\nc";N/A\n2;;3\n'.encode()))
    assert t.df.columns == ["x", "y", "x.1"] and t.df.count() == 2 and t.placeholders == {"y": 1, "x.1": 1}
    assert read_table(spark, file("l.csv", "n,m\nCaf\xe9,1\n".encode("latin-1"))).df.first()[0] == "Café"
    capped = read_table(spark, file("c.csv", b"n\n" + b"1\n" * 10), max_rows=5)
    assert capped.df.count() == 5 and capped.warnings
    assert not read_table(spark, file("c.csv", b"n\n" + b"1\n" * 10), max_rows=10).warnings
    j = read_table(spark, file("a.json", b'[{"id": 1, "tags": ["a", "b"], "o": {"k": true}}, {"id": 2, "tags": [], "o": null}]'))
    assert j.df.columns == ["id", "o.k", "tags"] and j.df.first()["tags"] == '["a", "b"]'
    assert read_table(spark, file("b.json", b'{"id": 1}\n{"id": 2}\n')).df.count() == 2
    assert read_table(spark, file("e.json", b'{"n": 2, "rows": [{"id": 1}, {"id": 2}]}')).df.columns == ["id"]
    x = read_table(spark, file("a.xml", b'<rows><row id="1"><a>x</a></row><row id="2"><a>y</a></row></rows>'))
    assert sorted(x.df.columns) == ["a", "id"] and x.df.count() == 2
    book = write_workbook({"One": [[("h", "header"), ("k", "")], [("v", ""), (1.5, "percent")]], "Two": [[("z", "")], [("w", "")]]})
    assert zipfile.ZipFile(io.BytesIO(book)).testzip() is None
    path = file("a.xlsx", book)
    assert list_sheets(spark, path) == ["One", "Two"]
    assert [tuple(r) for r in read_table(spark, path).df.collect()] == [("v", "1.5")] and read_table(spark, path, "Two").df.columns == ["z"]
    for name, content in (("e.csv", b"a,b\n"), ("s.json", b"3"), ("p.txt", b"x")):
        with pytest.raises(SourceError):
            read_table(spark, file(name, content))
    with pytest.raises(SourceError):
        xml_row_tag(b'<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/passwd">]><r><a>&e;</a></r>')
    assert delimiter_of("a;b;c\n1;2;3\n") == ";" and delimiter_of("abc") == "," and extension("X.XLSM") == "xlsm"


def test_records_with_too_many_fields_are_reported(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("a,b\n1,2\n3,4,5,6\n7\n8,9,\n'x',\"y, z\"\n,\n3,4,,5\n3,\"4,,,\"\n3,4,5\n", encoding="utf-8")
    good, bad = load_csv(spark, str(path))
    assert [tuple(r) for r in good.collect()] == [("1", "2"), ("7", None), ("8", "9"), ("'x'", "y, z"), (None, None), ("3", "4,,,")]
    assert [tuple(r) for r in bad.collect()] == [("columns", "3,4,5,6"), ("columns", "3,4,,5"), ("columns", "3,4,5")]
    with pytest.raises(SourceError, match="3 records have more fields"):
        read_raw(spark, str(path))


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    assert [tuple(r) for r in read_raw(spark, str(path)).collect()] == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "latin.csv").write_bytes("a;b\nCaf\xe9;1\n".encode("latin-1"))
    assert [tuple(r) for r in read_raw(spark, str(tmp_path / "latin.csv")).collect()] == [("Café", "1")]


def test_damaged_json_lines_are_reported(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text('{"a": 1, "b": [2, "x"]}\n\n{"a": 2}\n{"a": 3, \n{"a": 4, "b": null}\n', encoding="utf-8")
    good, bad = json_lines(spark, str(path))
    assert [r["a"] for r in good.collect()] == ["1", "2", "4"] and [tuple(r) for r in bad.collect()] == [("syntax", '{"a": 3, ')]
    with pytest.raises(SourceError, match="1 lines are no valid JSON"):
        read_raw(spark, str(path))
    (tmp_path / "first.json").write_text('{"a": 3, \n{"a": 4}\n{"a": 5}\n', encoding="utf-8")
    with pytest.raises(SourceError, match="1 lines are no valid JSON"):
        read_raw(spark, str(tmp_path / "first.json"))


def test_json_documents(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"meta": [], "x": [{"q": {"z": 1}, "t": ["a", "b: \\"c\\""]}], "records": [{"q": 9}]}', encoding="utf-8")
    assert [tuple(r) for r in read_raw(spark, str(tmp_path / "e.json")).select("`q.z`", "t").collect()] == [("1", '["a", "b: \\"c\\""]')]
    (tmp_path / "n.json").write_text('[{"k": [{"b": "2", "a": null}, null], "m": []}, {"k": null}]', encoding="utf-8")
    assert [r["k"] for r in read_raw(spark, str(tmp_path / "n.json")).collect()] == ['[{"b": "2"}, null]', None]
    (tmp_path / "o.json").write_text('{\n "a": 1\n}', encoding="utf-8")
    assert [r["a"] for r in read_raw(spark, str(tmp_path / "o.json")).collect()] == ["1"]
    (tmp_path / "s.json").write_text("5", encoding="utf-8")
    with pytest.raises(SourceError):
        read_raw(spark, str(tmp_path / "s.json"))


def test_rules_that_fail_on_the_data_leave_the_others_alone(spark, monkeypatch):
    from auditloom.operators import rules

    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n bigint, s string")
    inf = Rule("in_set", "n", {"value_set": [1, float("inf"), float("nan"), 1e300]})
    got = {o.rule.kind: (o.status, o.failures) for o in run_rules(df, [inf, Rule("not_null", "n"), Rule("regex", "s", {"regex": "["})])}
    assert got == {"in_set": ("FAIL", 1), "not_null": ("FAIL", 1), "regex": ("ERROR", 0)}
    plain = rules.against
    monkeypatch.setattr(rules, "against", lambda d, r: F.raise_error(F.lit("no")).isNull() if r.kind == "between" else plain(d, r))
    got = {o.rule.kind: (o.status, o.failures) for o in run_rules(df, [Rule("between", "n", {"min_value": 0}), Rule("not_null", "n")])}
    assert got == {"between": ("ERROR", 0), "not_null": ("FAIL", 1)}


def test_what_a_check_says_is_not_said_again_by_a_rule(spark):
    df = spark.createDataFrame([(i % 9, float(i) if i else None, "x") for i in range(40)] + [(9, 1e6, "x")], "k bigint, v double, s string")
    types = {"k": "integer", "v": "float", "s": "categorical"}
    profile = profile_table(df, types)
    checks = [*C.null_checks(profile, set()), C.exact_duplicates(df), C.key_duplicates(df, ["k"]), *C.outlier_checks(df, profile)]
    lo, hi = profile.columns["v"].fences()
    rules = [Rule("not_null", "v"), Rule("unique", "k"), Rule("between", "v", {"min_value": lo, "max_value": hi}), Rule("between", "k", {"max_value": 3})]
    found = [(f.issue, f.column) for f in rank_findings(checks, run_rules(df, rules), {}, {"s": 2}, 41)]
    assert found == [("Duplicate keys", "k"), ("Values outside the expected range", "k"), ("Placeholder values treated as null", "s"), ("Missing values", "v"), ("Outliers", "v")]


def test_previews_and_details(spark, tmp_path):
    from auditloom.reports.render import write_details

    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "a bigint, b bigint").coalesce(1)
    assert [r["a"] for r in first_rows(df).collect()] == list(range(10)) and first_rows(df.limit(0)).count() == 0
    checks = [C.key_duplicates(df, ["b"]), C.exact_duplicates(df), C.schema_drift({"a": "integer"}, {})]
    (path,) = write_details(checks, str(tmp_path / "details"))
    assert path.endswith("duplicates_key_b") and sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(0, 10), (1, 10), (2, 10)]


def test_a_small_table_with_known_faults(spark):
    """Every check on one table whose faults are counted by hand."""
    places = ["Alder", "ALDER", "alder ", "Birch", "Brich"]
    rows = [(str(i), f"n{i}", str(30 + i % 20), places[0] if i < 40 else places[3], "2020-01-01", "2020-02-01", str(50 + i % 30), "A" if i % 2 else "B") for i in range(80)]
    rows[3] = ("3", "n3", "999", "ALDER", "2020-01-01", "2019-12-31", "N/A", "Z")
    rows[4] = ("4", "n4", "x", "alder ", "2020-01-01", "", "50.5", "A")
    rows[5] = ("5", "n5", "-", "Brich", "2020-01-01", "2020-01-01", "51", "B")
    rows += [rows[10], (rows[11][0], *rows[12][1:])]
    names = ("id", "name", "age", "place", "opened", "closed", "score", "code")
    types = dict(zip(names, ("integer", "string", "integer", "categorical", "datetime", "datetime", "float", "string"), strict=True))
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    cleaned, placeholders = blank_placeholders(raw)
    assert placeholders == {"age": 1, "closed": 1, "score": 1}
    known = spark.createDataFrame([("A",), ("B",)], "code string")
    done = audit(cleaned, ConfirmedSchema("t", types, ["id"]), placeholders, references=[Reference("code", known, "code")], pairs=[("opened", "closed")])
    done.table.unpersist()
    got = {(f.issue, f.column): f.affected for f in done.findings}
    assert got == {
        ("Missing values", "age"): 2, ("Missing values", "closed"): 1, ("Missing values", "score"): 1, ("Duplicate rows", None): 2, ("Duplicate keys", "id"): 4,
        ("Outliers", "age"): 1, ("Inconsistent casing/whitespace", "place"): 41, ("Possible typos", "place"): 1, ("Referential integrity break", "code"): 1,
        ("Cross-column inconsistency", "closed, opened"): 1, ("Values not matching the confirmed type", "age"): 1, ("Placeholder values treated as null", "age"): 1,
        ("Placeholder values treated as null", "closed"): 1, ("Placeholder values treated as null", "score"): 1,
    }, got
