"""The anomaly checks. Each gives its verdict from a small aggregate and keeps the rows it concerns as a lazy table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column, match_key
from auditloom.operators.profile import TableProfile

EXPECTED_NULL_SHARE = 0.20

# Parts of column names that mark the start and the end of a span of time.
START_WORDS = ("start", "open", "created", "begin", "issued", "signup", "submitted", "registered")
END_WORDS = ("end", "close", "closed", "finish", "finished", "resolved", "completed")


@dataclass
class CheckResult:
    """``check`` is kind, or kind:detail; ``details`` are the rows concerned, computed only when asked for.

    ``column`` is the column or columns concerned, ``topic`` what the check reports on, ``covers`` the rules that say the
    same: (kind of rule, column, rows against it or None for any number).
    """

    check: str
    passed: bool
    summary: str
    affected: int = 0
    details: DataFrame | None = None
    column: str | None = None
    topic: str = ""
    covers: tuple[tuple[str, str, int | None], ...] = ()

    @property
    def kind(self) -> str:
        return self.check.partition(":")[0]

    @property
    def detail(self) -> str:
        return self.check.partition(":")[2]


def null_checks(profile: TableProfile, nulls_expected: set[str]) -> list[CheckResult]:
    """One verdict for each column: nulls at all, or more than a fifth of the rows where nulls are expected."""
    found = []
    for name, p in profile.columns.items():
        limit = EXPECTED_NULL_SHARE if name in nulls_expected else 0.0
        note = f", up to {limit:.0%} expected" if limit else ""
        found.append(CheckResult(f"nulls:{name}", p.null_share <= limit, f"{p.nulls} of {profile.rows} values missing ({p.null_share:.1%}{note})", p.nulls, column=name, topic="missing", covers=(("not_null", name, p.nulls),)))
    return found


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the keys that occur more than once, with their count ``copies``; nulls form one group."""
    count = "copies" if "copies" not in keys else "__copies"
    return df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def duplicate_check(df: DataFrame, keys: list[str], check: str, noun: str, **about) -> CheckResult:
    groups = duplicate_groups(df, keys)
    count = "copies" if "copies" not in keys else "__copies"
    n, affected = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    return CheckResult(check, n == 0, f"{n} groups of repeated {noun}, {affected} rows in all" if n else f"no repeated {noun}", affected, groups, **about)


def exact_duplicates(df: DataFrame) -> CheckResult:
    return duplicate_check(df, df.columns, "duplicates:exact_rows", "rows", topic="same_rows")


def key_duplicates(df: DataFrame, keys: list[str]) -> CheckResult | None:
    """None without a key."""
    if not keys:
        return None
    shown = ", ".join(keys)
    return duplicate_check(df, keys, f"duplicates:key[{shown}]", f"keys ({shown})", column=shown, topic="same_keys", covers=(("unique", shown, None),))


def outside(name: str, lo: float, hi: float) -> Column:
    """True beyond the fences; null and NaN are never outside."""
    d = column(name).cast("double")
    return F.coalesce(~F.isnan(d) & ((d < lo) | (d > hi)), F.lit(False))


def outlier_checks(df: DataFrame, profile: TableProfile) -> list[CheckResult]:
    """Interquartile outliers of all numeric columns, counted in one pass; columns without fences give no verdict."""
    fences = {n: p.fences() for n, p in profile.columns.items() if p.semantic in ("integer", "float")}
    fences = {n: f for n, f in fences.items() if f is not None}
    if not fences:
        return []
    counts = df.agg(*[F.count_if(outside(n, *f)) for n, f in fences.items()]).first()
    return [
        CheckResult(f"outliers:{n}", k == 0, f"{k} values outside [{f[0]:.2f}, {f[1]:.2f}]" if k else f"all values within [{f[0]:.2f}, {f[1]:.2f}]", k, df.filter(outside(n, *f)), column=n, topic="outlier", covers=(("between", n, k),))
        for (n, f), k in zip(fences.items(), counts, strict=True)
    ]


def schema_drift(current: dict[str, str], prior: dict[str, str] | None) -> CheckResult:
    """Columns added, removed or of another type than in the schema confirmed before."""
    if prior is None:
        return CheckResult("schema_drift", True, "no earlier schema to compare with", topic="drift")
    added, removed = sorted(set(current) - set(prior)), sorted(set(prior) - set(current))
    changed = [f"{c}: {prior[c]} -> {current[c]}" for c in current if c in prior and prior[c] != current[c]]
    parts = [f"{what} {', '.join(names)}" for what, names in (("added", added), ("removed", removed), ("changed", changed)) if names]
    return CheckResult("schema_drift", not parts, "; ".join(parts) or "same columns and types as before", topic="drift")


def variant_groups(frequencies: DataFrame, categorical: list[str]) -> DataFrame:
    """(column, key, spellings, rows, canonical): values that differ only by case or white space, with the most frequent
    spelling; among equals the one seen first."""
    keyed = frequencies.filter(F.col("column").isin(*categorical)).withColumn("key", match_key(F.col("value")))
    grouped = keyed.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("cnt").alias("rows"), F.max_by("value", F.struct("cnt", -F.col("first_row"))).alias("canonical")
    )
    return grouped.filter("spellings > 1")


def variant_checks(df: DataFrame, frequencies: DataFrame, categorical: list[str]) -> list[CheckResult]:
    """A verdict for each categorical column that has such groups, and none for the others."""
    if not categorical:
        return []
    groups = variant_groups(frequencies, categorical)
    found = []
    for r in groups.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.min("canonical").alias("example")).orderBy("column").collect():
        own = groups.filter(F.col("column") == r["column"]).select(F.col("key").alias("__key"))
        rows = df.join(own, match_key(column(r["column"]).cast("string")) == F.col("__key"), "left_semi")
        found.append(CheckResult(f"categorical_standardization:{r['column']}", False, f"{r['n']} values are written in several ways (such as {r['example']!r}), in {r['rows']} rows", r["rows"], rows, column=r["column"], topic="spelling"))
    return found


def orphan_rows(main: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """Rows of the main table whose key, as text, is in no row of the reference; null keys are no references."""
    known = reference.select(column(reference_key).cast("string").alias("__known")).filter("__known is not null").distinct()
    return main.filter(column(key).isNotNull()).join(known, column(key).cast("string") == F.col("__known"), "left_anti")


def referential_check(main: DataFrame, key: str, reference: DataFrame, reference_key: str) -> CheckResult:
    rows = orphan_rows(main, key, reference, reference_key)
    n = rows.count()
    return CheckResult(f"referential:{key}->{reference_key}", n == 0, f"{n} rows refer by '{key}' to no '{reference_key}'" if n else f"every '{key}' is a known '{reference_key}'", n, rows, column=key, topic="orphan")


def consistency_check(df: DataFrame, start: str, end: str) -> CheckResult:
    """Rows whose end lies before their start; rows that lack either are consistent."""
    rows = df.filter(column(start).isNotNull() & column(end).isNotNull() & (column(end) < column(start)))
    n = rows.count()
    return CheckResult(f"consistency:{end}>={start}", n == 0, f"{n} rows have '{end}' before '{start}'" if n else f"'{end}' is never before '{start}'", n, rows, column=f"{end}, {start}", topic="order")


def suggest_pairs(types: dict[str, str]) -> list[tuple[str, str]]:
    """(start, end) pairs of datetime columns whose names speak of a start and an end."""
    dates = [n for n, k in types.items() if k == "datetime"]
    has = lambda name, words: any(w in name.lower() for w in words)
    return [(a, b) for a in dates for b in dates if a != b and has(a, START_WORDS) and has(b, END_WORDS)]
