"""Validation rules, compiled to columns and answered together by one aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column
from auditloom.operators.frequency import value_frequencies
from auditloom.operators.profile import TableProfile

KINDS = ("not_null", "unique", "between", "in_set", "regex", "row_count_between")
RARE_SHARE = 0.01


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str | None = None
    params: dict = field(default_factory=dict, hash=False)
    source: str = "auto"

    def text(self) -> str:
        """The rule's settings in words."""
        if self.kind == "in_set":
            values = list(self.params.get("value_set") or ())
            return "one of " + ", ".join(map(repr, values[:6])) + (", ..." if len(values) > 6 else "")
        if self.kind == "regex":
            return f"matches {self.params.get('regex', '')!r}"
        if self.kind in ("between", "row_count_between"):
            return f"between {bound(self.params.get('min_value'))} and {bound(self.params.get('max_value'))}"
        return ""


def bound(value: float | None) -> str:
    return "unbounded" if value is None else f"{float(value):,.6g}"


@dataclass
class Outcome:
    """``failures`` is the number of rows against the rule; status is PASS, FAIL or ERROR."""

    rule: Rule
    status: str
    failures: int = 0
    share: float = 0.0
    error: str = ""


def problem(df: DataFrame, rule: Rule, types: dict[str, str]) -> str:
    """Why a rule cannot run, or an empty text. Nothing of the data is read; a pattern is tried on a literal."""
    if rule.kind not in KINDS:
        return f"unknown rule {rule.kind!r}"
    p = rule.params
    if rule.kind != "row_count_between" and rule.column not in df.columns:
        return f"there is no column {rule.column!r}"
    if rule.kind in ("between", "row_count_between"):
        bounds = [p.get("min_value"), p.get("max_value")]
        if all(b is None for b in bounds):
            return "a lower or an upper bound is needed"
        if any(b is not None and (isinstance(b, bool) or not isinstance(b, (int, float)) or math.isnan(b)) for b in bounds):
            return "the bounds must be numbers"
        if rule.kind == "between" and df.schema[rule.column].dataType.typeName() not in ("long", "integer", "short", "byte", "float", "double", "decimal"):
            return f"column {rule.column!r} holds no numbers"
    if rule.kind == "in_set" and not p.get("value_set"):
        return "the set of values is empty"
    if rule.kind == "regex":
        if df.schema[rule.column].dataType.typeName() != "string":
            return f"column {rule.column!r} holds no text"
        try:
            df.sparkSession.range(1).select(F.lit("").rlike(str(p.get("regex", "")))).collect()
        except PySparkException as e:
            return f"Invalid regular expression: {str(e).strip().splitlines()[-1][:150]}"
    return ""


def against(df: DataFrame, rule: Rule) -> Column:
    """True for the rows against a rule; nulls are only against not_null."""
    c = column(rule.column)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "between":
        lo, hi = rule.params.get("min_value"), rule.params.get("max_value")
        out = F.lit(False)
        if lo is not None:
            out = out | (c < F.lit(lo))
        if hi is not None:
            out = out | (c > F.lit(hi))
        return F.coalesce(out, F.lit(False))
    if rule.kind == "in_set":
        return F.coalesce(~_member(df, rule.column, list(rule.params["value_set"])), F.lit(False))
    if rule.kind == "regex":
        return F.coalesce(~c.rlike(str(rule.params["regex"])), F.lit(False))
    raise ValueError(f"{rule.kind} is not a rule of rows")


def _member(df: DataFrame, name: str, values: list) -> Column:
    """Membership with the values in the column's type; a value of another type matches nothing."""
    c, kind = column(name), df.schema[name].dataType.typeName()
    if kind == "string":
        own = [v for v in values if isinstance(v, str)]
    elif kind == "boolean":
        own = [v for v in values if isinstance(v, bool)]
    elif kind in ("long", "integer", "short", "byte", "float", "double", "decimal"):
        own = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if kind in ("long", "integer", "short", "byte"):
            own = [int(v) for v in own if math.isfinite(v) and v == int(v) and abs(v) < 2**63]
    else:
        c, own = c.cast("string"), [str(v) for v in values]
    return c.isin(*own) if own else F.when(c.isNotNull(), F.lit(False))


def repeated_rows(frequencies: DataFrame) -> DataFrame:
    """(column, rows): rows whose value occurs more than once in its column."""
    return frequencies.filter("cnt > 1").groupBy("column").agg(F.sum("cnt").alias("rows"))


def baseline_rules(df: DataFrame, profile: TableProfile, frequencies: DataFrame, keys: list[str], nulls_expected: set[str]) -> list[Rule]:
    """Rules that the profile suggests: no nulls but where expected, numbers within the outlier fences, categories of at
    least a hundredth of the values where others are rarer, and a unique single-column key."""
    categorical = [n for n, p in profile.columns.items() if p.semantic == "categorical"]
    usual: dict[str, list] = {}
    if categorical:
        given = {n: profile.columns[n].distinct and profile.rows - profile.columns[n].nulls for n in categorical}
        share = F.lit(None).cast("double")
        for n in categorical:
            share = F.when(F.col("column") == n, F.col("cnt") / F.lit(max(given[n], 1))).otherwise(share)
        kept = frequencies.filter(F.col("column").isin(*categorical)).withColumn("share", share).filter(F.col("share") >= RARE_SHARE)
        for r in kept.orderBy("column", F.desc("cnt"), "value").collect():
            usual.setdefault(r["column"], []).append(r["value"])
    rules = []
    for name, p in profile.columns.items():
        if name not in nulls_expected:
            rules.append(Rule("not_null", name))
        fences = p.fences() if p.semantic in ("integer", "float") else None
        if fences:
            rules.append(Rule("between", name, {"min_value": fences[0], "max_value": fences[1]}))
        if usual.get(name) and len(usual[name]) < p.distinct:
            rules.append(Rule("in_set", name, {"value_set": usual[name]}))
    if len(keys) == 1:
        rules.append(Rule("unique", keys[0]))
    return rules


def _counted(df: DataFrame, rules: dict[tuple, Rule]) -> tuple[int, dict[tuple, int], dict[tuple, str]]:
    """(rows, rows against each rule, error of each rule that cannot run), by one aggregate.

    Should the aggregate fail, each rule runs on its own, so that one that fails on the data leaves the others alone.
    """
    try:
        counts = df.agg(F.count(F.lit(1)), *[F.count_if(against(df, r)) for r in rules.values()]).first()
        return counts[0], dict(zip(rules, counts[1:], strict=True)), {}
    except (PySparkException, ValueError, TypeError, OverflowError) as e:
        if len(rules) == 1:
            (key,) = rules
            return df.count(), {}, {key: f"{type(e).__name__}: {str(e).strip().splitlines()[0][:150]}"}
    failures, broken = {}, {}
    for key, rule in rules.items():
        _, own, error = _counted(df, {key: rule})
        failures |= own
        broken |= error
    return df.count(), failures, broken


def run_rules(df: DataFrame, rules: list[Rule], types: dict[str, str] | None = None, frequencies: DataFrame | None = None) -> list[Outcome]:
    """An outcome for each rule, in order: one pass for the rules of rows, one shared shuffle for uniqueness.

    Rules that cannot run come out as ERROR and leave the others alone. An identical rule given twice counts once, as
    the later one's source.
    """
    types = types or {}
    unique: dict[tuple, Rule] = {}
    for r in rules:
        unique[(r.kind, r.column, repr(sorted(r.params.items(), key=lambda e: e[0])))] = r
    errors = {k: problem(df, r, types) for k, r in unique.items()}
    rowwise = {k: r for k, r in unique.items() if not errors[k] and r.kind not in ("unique", "row_count_between")}
    rows, failures, broken = _counted(df, rowwise)
    errors |= broken
    distinct = sorted({r.column for k, r in unique.items() if r.kind == "unique" and not errors[k]})
    if distinct:
        vf = frequencies if frequencies is not None else value_frequencies(df, distinct)
        repeated = {r["column"]: r["rows"] for r in repeated_rows(vf.filter(F.col("column").isin(*distinct))).collect()}
    outcomes = []
    for k, r in unique.items():
        if errors[k]:
            outcomes.append(Outcome(r, "ERROR", error=errors[k]))
            continue
        if r.kind == "row_count_between":
            lo, hi = r.params.get("min_value"), r.params.get("max_value")
            good = (lo is None or rows >= lo) and (hi is None or rows <= hi)
            outcomes.append(Outcome(r, "PASS" if good else "FAIL"))
            continue
        n = repeated.get(r.column, 0) if r.kind == "unique" else failures[k]
        outcomes.append(Outcome(r, "FAIL" if n else "PASS", n, n / rows if rows else 0.0))
    return outcomes
