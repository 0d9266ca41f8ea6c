"""A whole audit of one table: typed table, profile, checks, rules, findings, reports. The data are never changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from auditloom.functions.schema_store import ConfirmedSchema, confirm, file_name
from auditloom.functions.text import column
from auditloom.operators import checks as C
from auditloom.operators.findings import Finding, rank_findings
from auditloom.operators.frequency import value_frequencies
from auditloom.operators.profile import TableProfile, profile_table
from auditloom.operators.rules import Outcome, Rule, baseline_rules, run_rules
from auditloom.operators.typos import typo_checks
from auditloom.reports.render import html_report, markdown_actions, scorecard


@dataclass
class Reference:
    """A check of a column against a key of another table."""

    key: str
    table: DataFrame
    table_key: str


@dataclass
class Audit:
    schema: ConfirmedSchema
    table: DataFrame
    profile: TableProfile
    checks: list[C.CheckResult]
    outcomes: list[Outcome]
    findings: list[Finding]
    coercion_failures: dict[str, int] = field(default_factory=dict)

    def reports(self) -> dict[str, bytes]:
        name = self.schema.dataset_name
        slug = file_name(name).removesuffix("_confirmed_schema.json")
        return {
            f"{slug}_actions.md": markdown_actions(self.findings, name).encode(),
            f"{slug}_report.html": html_report(name, self.profile, self.checks, self.outcomes, self.findings).encode(),
            f"{slug}_scorecard.xlsx": scorecard(self.profile, self.outcomes, self.findings),
        }


def run_checks(
    df: DataFrame,
    types: dict[str, str],
    profile: TableProfile,
    frequencies: DataFrame,
    keys: list[str] | None = None,
    nulls_expected: set[str] | None = None,
    prior: dict[str, str] | None = None,
    references: list[Reference] | None = None,
    pairs: list[tuple[str, str]] | None = None,
    dismissed: dict[str, set[str]] | None = None,
) -> list[C.CheckResult]:
    """All checks in their fixed order: nulls, duplicates, outliers, drift, variants, typos, references, spans of time."""
    categorical = [n for n, k in types.items() if k == "categorical"]
    found = C.null_checks(profile, nulls_expected or set())
    found.append(C.exact_duplicates(df))
    by_key = C.key_duplicates(df, keys or [])
    found += [by_key] if by_key else []
    found += C.outlier_checks(df, profile)
    found.append(C.schema_drift(types, prior))
    found += C.variant_checks(df, frequencies, categorical)
    found += typo_checks(df, frequencies, categorical, dismissed)
    for r in references or []:
        # The reference key takes the type of the column that refers to it, so that 1, "1" and "1.0" are one key.
        kind = types.get(r.key, "string")
        known, _ = confirm(r.table.select(column(r.table_key)), {r.table_key: kind})
        found.append(C.referential_check(df, r.key, known, r.table_key))
    found += [C.consistency_check(df, start, end) for start, end in pairs or []]
    return found


def audit(
    raw: DataFrame,
    schema: ConfirmedSchema,
    placeholders: dict[str, int] | None = None,
    prior: ConfirmedSchema | None = None,
    references: list[Reference] | None = None,
    pairs: list[tuple[str, str]] | None = None,
    custom_rules: list[Rule] | None = None,
    dismissed: dict[str, set[str]] | None = None,
) -> Audit:
    """Audit a text table under its confirmed schema. ``prior`` is the schema confirmed before this one."""
    table, failures = confirm(raw, schema.column_types)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    types = {c: schema.column_types.get(c, "string") for c in table.columns}
    frequencies = value_frequencies(table, list(types)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        profile = profile_table(table, types, frequencies)
        expected = set(schema.nulls_expected_columns)
        found = run_checks(table, types, profile, frequencies, schema.key_columns, expected, prior and prior.column_types, references, pairs, dismissed)
        rules = baseline_rules(table, profile, frequencies, schema.key_columns, expected)
        rules += [Rule(r.kind, r.column, r.params, "custom") for r in custom_rules or []]
        outcomes = run_rules(table, rules, types, frequencies)
    finally:
        frequencies.unpersist()
    findings = rank_findings(found, outcomes, failures, placeholders or {}, profile.rows)
    return Audit(schema, table, profile, found, outcomes, findings, failures)
