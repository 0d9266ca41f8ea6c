"""Confirmed schemas: what a person said about a table's columns, kept as JSON and matched to later tables."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.coerce import coerced
from auditloom.functions.text import column

SUFFIX, LEAST_OVERLAP = "_confirmed_schema.json", 0.5


@dataclass
class ConfirmedSchema:
    dataset_name: str
    column_types: dict[str, str]
    key_columns: list[str] = field(default_factory=list)
    nulls_expected_columns: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> ConfirmedSchema:
        raw = json.loads(text)
        return cls(raw["dataset_name"], dict(raw["column_types"]), list(raw.get("key_columns") or []), list(raw.get("nulls_expected_columns") or []))


def file_name(dataset: str) -> str:
    words = re.findall("[a-z0-9]+", dataset.lower())
    return ("_".join(words) if words else "dataset") + SUFFIX


def save(schema: ConfirmedSchema, folder: str) -> Path:
    path = Path(folder) / file_name(schema.dataset_name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(schema.to_json(), encoding="utf-8")
    return path


def saved(folder: str) -> list[ConfirmedSchema]:
    """All readable schemas of a folder, by file name."""
    found = []
    for path in sorted(Path(folder).glob("*" + SUFFIX)):
        try:
            found.append(ConfirmedSchema.from_json(path.read_text(encoding="utf-8")))
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return found


def best_match(columns: list[str], schemas: list[ConfirmedSchema]) -> ConfirmedSchema | None:
    """The schema whose columns overlap most with these, if by at least half of their union; the first among equals."""
    best, score = None, 0.0
    for s in schemas:
        union = set(columns) | set(s.column_types)
        overlap = len(set(columns) & set(s.column_types)) / len(union) if union else 0.0
        if overlap >= LEAST_OVERLAP and overlap > score:
            best, score = s, overlap
    return best


def confirm(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """(the table in its confirmed types, cells of each column that did not fit and are null now), counted in one pass.

    Columns without a type are text. The semantic type is kept in the column's metadata.
    """
    kinds = {c: types.get(c, "string") for c in df.columns}
    typed = {c: coerced(column(c).cast("string"), k) for c, k in kinds.items()}
    counted = df.agg(F.count(F.lit(1)), *[F.count_if(column(c).isNotNull() & typed[c].isNull()) for c in df.columns]).first()
    table = df.select(*[typed[c].alias(c, metadata={"semantic": kinds[c]}) for c in df.columns])
    return table, {c: n for c, n in zip(df.columns, counted[1:], strict=True) if n}
