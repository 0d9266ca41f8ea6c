"""Reports of an audit: ranked actions in Markdown, the whole audit in HTML, a scorecard workbook."""

from __future__ import annotations

import re
from html import escape
from pathlib import Path

from auditloom.operators.checks import CheckResult
from auditloom.operators.findings import Finding, sections
from auditloom.operators.profile import TableProfile
from auditloom.operators.rules import Outcome
from auditloom.sources.workbook import write_workbook


def _cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def _affected(f: Finding) -> str:
    return f"{f.affected:,} ({f.share:.1%})" if f.affected else "—"


def markdown_actions(findings: list[Finding], dataset: str) -> str:
    lines = [f"# Recommended actions: {dataset}", ""]
    if not findings:
        return "\n".join([*lines, "No problems were found."]) + "\n"
    lines += [f"{len(findings)} findings, those that affect most rows first. The data are unchanged.", ""]
    lines += ["| Column | Issue | Rows affected | Finding | Action |", "|---|---|---|---|---|"]
    for f in findings:
        lines.append(f"| {_cell(f.column) if f.column else '*(table-level)*'} | {_cell(f.issue)} | {_affected(f)} | {_cell(f.finding)} | {_cell(f.action)} |")
    return "\n".join(lines) + "\n"


def _table(header: list[str], rows: list[list[object]]) -> str:
    head = "".join(f"<th>{escape(h)}</th>" for h in header)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_report(dataset: str, profile: TableProfile, checks: list[CheckResult], outcomes: list[Outcome], findings: list[Finding]) -> str:
    """One page without outside resources; every text of the data is escaped."""
    failed = sum(o.status != "PASS" for o in outcomes)
    cards = [("Rows", profile.rows), ("Columns", len(profile.columns)), ("Failed checks", sum(not c.passed for c in checks)), ("Failed rules", failed), ("Findings", len(findings))]
    parts = ["".join(f'<div class="card"><b>{v:,}</b><span>{escape(k)}</span></div>' for k, v in cards), "<h2>Checks</h2>"]
    for _, title, text, own in sections(checks):
        parts.append(f"<h3>{escape(title)}</h3><p>{escape(text)}</p>")
        parts.append(_table(["Target", "Result", "Rows", "Summary"], [[c.detail or "table", "pass" if c.passed else "fail", c.affected, c.summary] for c in own]))
    parts.append("<h2>Rules</h2>" + _table(["Rule", "Column", "Settings", "Source", "Status", "Rows against it", "Error"], [[o.rule.kind, o.rule.column, o.rule.text(), o.rule.source, o.status, o.failures, o.error] for o in outcomes]))
    parts.append("<h2>Actions</h2>" + _table(["Column", "Issue", "Rows", "Finding", "Action"], [[f.column or "(table)", f.issue, _affected(f), f.finding, f.action] for f in findings]))
    parts.append("<h2>Profile</h2>" + _table(["Column", "Type", "Missing", "Distinct", "Low", "High", "Mean", "Most frequent"], [
        [p.name, p.semantic, f"{p.nulls} ({p.null_share:.1%})", p.distinct, p.low, p.high, p.mean, ", ".join(f"{v} ({n})" for v, n in p.top)] for p in profile.columns.values()
    ]))
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}.card{display:inline-block;border:1px solid #ccc;padding:8px 16px;margin:4px}.card span{display:block}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(dataset)}</title><style>{style}</style></head><body><h1>{escape(dataset)}</h1>{''.join(parts)}</body></html>"


def scorecard(profile: TableProfile, outcomes: list[Outcome], findings: list[Finding]) -> bytes:
    head = lambda *names: [(n, "header") for n in names]
    colour = {"PASS": "good", "FAIL": "bad", "ERROR": "warn"}
    rules = [head("Rule", "Column", "Settings", "Source", "Status", "Rows against it", "Share", "Error")]
    rules += [[(o.rule.kind, ""), (o.rule.column, ""), (o.rule.text(), ""), (o.rule.source, ""), (o.status, colour[o.status]), (o.failures, ""), (o.share, "percent"), (o.error, "")] for o in outcomes]
    actions = [head("Column", "Issue", "Rows", "Share", "Finding", "Action")]
    actions += [[(f.column or "(table)", ""), (f.issue, ""), (f.affected, ""), (f.share, "percent"), (f.finding, ""), (f.action, "")] for f in findings]
    columns = [head("Column", "Type", "Missing", "Missing share", "Distinct", "Low", "High", "Mean")]
    columns += [[(p.name, ""), (p.semantic, ""), (p.nulls, ""), (p.null_share, "percent"), (p.distinct, ""), (p.low, ""), (p.high, ""), (p.mean, "")] for p in profile.columns.values()]
    return write_workbook({"Rule Summary": rules, "Recommended Actions": actions, "Column Profile": columns})


def write_bundle(files: dict[str, bytes], folder: str) -> list[Path]:
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (target / name).write_bytes(content)
    return [target / name for name in files]


def write_details(checks: list[CheckResult], folder: str) -> list[str]:
    """Write the rows that failed checks concern, each check as a Parquet table of its own below a folder of any file
    system that Spark knows; returns the paths. Nothing passes through the driver."""
    written = []
    for c in checks:
        if not c.passed and c.details is not None:
            name = "_".join(re.findall("[a-z0-9]+", c.check.lower()))
            path = f"{folder.rstrip('/')}/{name}"
            c.details.write.mode("overwrite").parquet(path)
            written.append(path)
    return written
