"""Findings: what is to be done about a table, from its checks, rules, coercion and placeholders, most rows first."""

from __future__ import annotations

from dataclasses import dataclass

from auditloom.operators.checks import CheckResult
from auditloom.operators.rules import Outcome


@dataclass
class Finding:
    column: str | None
    issue: str
    affected: int
    share: float
    finding: str
    action: str


# The issue labels of the report's contract, by the topic that a check or rule reports on.
ISSUES = {
    "missing": "Missing values",
    "same_rows": "Duplicate rows",
    "same_keys": "Duplicate keys",
    "outlier": "Outliers",
    "spelling": "Inconsistent casing/whitespace",
    "typo": "Possible typos",
    "orphan": "Referential integrity break",
    "order": "Cross-column inconsistency",
    "drift": "Schema drift",
    "repeated": "Values that should be unique repeat",
    "range": "Values outside the expected range",
    "set": "Values outside the allowed set",
    "pattern": "Values not matching the expected pattern",
    "size": "Row count outside the expected range",
    "type": "Values not matching the confirmed type",
    "placeholder": "Placeholder values treated as null",
    "broken_rule": "Validation rule could not run",
}

#: What each kind of rule reports on when it fails.
_RULE_TOPIC = {"not_null": "missing", "unique": "repeated", "between": "range", "in_set": "set", "regex": "pattern", "row_count_between": "size"}

_WHERE = {
    "missing": "List the rows where the cell is null and trace how they were loaded.",
    "same_rows": "The details table has one row for each set of copies; trace why they were delivered again.",
    "same_keys": "The details table has the repeated keys with their number of rows; settle which row counts.",
    "outlier": "The details table has the rows beyond the fences; look their source up before changing any.",
    "spelling": "The details table has the rows of these groups; settle on the most frequent spelling.",
    "typo": "The details table has the rows with the rare spelling; dismiss those that are right.",
    "orphan": "The details table has the rows without a partner; either side may be the one to mend.",
    "order": "The details table has the rows that end before they start.",
    "drift": "Confirm the new schema, or reload the table in its former one.",
    "repeated": "Group the table by this column to see the repeated values.",
    "range": "Filter the table by the bounds to see the rows outside.",
    "set": "Group the table by this column to see the values outside the set.",
    "pattern": "Filter the table by the pattern to see the rows that do not match.",
    "size": "Compare with the number of rows of earlier loads.",
    "type": "The raw table still has these cells as text; they are null in the typed one.",
    "placeholder": "Make sure that each of these spellings means a missing value in this column.",
    "broken_rule": "Rewrite the rule for this table, or drop it.",
}


def _topic_of(check: CheckResult) -> str:
    return check.topic or check.kind


def _finding(topic: str, column: str | None, affected: int, share: float, text: str) -> Finding:
    return Finding(column, ISSUES.get(topic, topic.replace("_", " ").capitalize()), affected, share, text, _WHERE.get(topic, "See the details of the check."))


def _rule_text(o: Outcome, rows: int) -> str:
    if o.status == "ERROR":
        return f"{o.rule.kind} was not evaluated: {o.error}"
    if o.rule.kind == "row_count_between":
        return f"the table has {rows:,} rows; {o.rule.text()} were expected"
    return f"{o.failures:,} of {rows:,} rows break the rule {o.rule.kind} {o.rule.text()}".rstrip()


def rank_findings(
    checks: list[CheckResult], outcomes: list[Outcome], coercion_failures: dict[str, int], placeholders: dict[str, int], rows: int
) -> list[Finding]:
    """Everything to act on, most rows first, then by issue and column.

    A failed rule that says what a failed check has said already is left out: every check names the rules it covers
    (kind, column, rows against it; None where the number may differ), and these are taken from the failed rules.
    """
    part = lambda n: n / rows if rows else 0.0
    failed = [c for c in checks if not c.passed]
    found = [_finding(_topic_of(c), c.column, c.affected, part(c.affected), c.summary) for c in failed]
    found += [_finding("type", name, n, part(n), f"{n:,} cells of {name!r} do not fit its type") for name, n in coercion_failures.items() if n]
    found += [_finding("placeholder", name, n, part(n), f"{n:,} cells of {name!r} spell a missing value") for name, n in placeholders.items() if n]
    covered = {rule for c in failed for rule in c.covers}
    for o in outcomes:
        if o.status == "ERROR":
            found.append(_finding("broken_rule", o.rule.column, 0, 0.0, _rule_text(o, rows)))
        elif o.status != "PASS" and not covered & {(o.rule.kind, o.rule.column, o.failures), (o.rule.kind, o.rule.column, None)}:
            found.append(_finding(_RULE_TOPIC.get(o.rule.kind, o.rule.kind), o.rule.column, o.failures, o.share, _rule_text(o, rows)))
    return sorted(found, key=lambda f: (-f.affected, f.issue, f.column or ""))


@dataclass(frozen=True)
class Section:
    """A part of the report: the kind of its checks, its title and what it tells."""

    kind: str
    title: str
    about: str


SECTIONS = (
    Section("nulls", "Missing values", "How many cells of each column are null, against what was expected of it."),
    Section("duplicates", "Duplicates", "Rows that repeat as wholes or by their key."),
    Section("outliers", "Outliers", "Numbers beyond one and a half times the quartile range."),
    Section("categorical_standardization", "Inconsistent casing / whitespace", "Categories spelled with other case or space."),
    Section("typos", "Possible typos", "Rare categories at most two edits from a frequent one."),
    Section("schema_drift", "Schema drift", "Columns and types against the schema confirmed before."),
    Section("referential", "Referential integrity", "Keys that the table they refer to does not have."),
    Section("consistency", "Cross-column consistency", "Spans of time whose end comes first."),
)


def sections(checks: list[CheckResult]) -> list[tuple[str, str, str, list[CheckResult]]]:
    """(kind, title, description, checks) in the order above, then unknown kinds; failed checks first, most rows first."""
    by_kind: dict[str, list[CheckResult]] = {s.kind: [] for s in SECTIONS}
    for c in checks:
        by_kind.setdefault(c.kind, []).append(c)
    named = {s.kind: s for s in SECTIONS}
    out = []
    for kind, own in by_kind.items():
        if own:
            s = named.get(kind) or Section(kind, kind.replace("_", " ").capitalize(), "")
            out.append((kind, s.title, s.about, sorted(own, key=lambda c: (c.passed, -c.affected))))
    return out
