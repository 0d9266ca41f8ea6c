"""Likely typos: rare values close to a more frequent value of the same column, resolved greedily from the top.

Values are compared by their case- and space-free key. Walking the keys by falling frequency (ties by value), a key that
has not been claimed claims every later, strictly rarer key within the edit distance. Candidate pairs come from a join of
the frequency relation with itself that only meets keys of near length; only these pairs reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column, match_key
from auditloom.operators.checks import CheckResult

MOST_EDITS, MOST_VALUES = 2, 5000


def key_counts(frequencies: DataFrame, categorical: list[str]) -> DataFrame:
    """(column, key, cnt) over the categorical columns."""
    keyed = frequencies.filter(F.col("column").isin(*categorical)).select("column", match_key(F.col("value")).alias("key"), "cnt")
    return keyed.groupBy("column", "key").agg(F.sum("cnt").alias("cnt"))


def candidate_pairs(counts: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """(column, key, cnt, rare, rare_cnt) of keys of one column within the edit distance, the first strictly more frequent.

    Keys meet on their column and length, each replicated to the lengths within the distance: an equality join.
    """
    frequent = counts.withColumn("size", F.explode(F.sequence(F.length("key") - most_edits, F.length("key") + most_edits)))
    rare = counts.select("column", F.col("key").alias("rare"), F.col("cnt").alias("rare_cnt"), F.length("key").alias("size"))
    close = F.levenshtein(F.col("key"), F.col("rare"), most_edits) >= 0
    return frequent.join(rare, ["column", "size"]).filter((F.col("cnt") > F.col("rare_cnt")) & close).select("column", "key", "cnt", "rare", "rare_cnt")


def resolve(pairs: list[tuple[str, int, str, int]]) -> dict[str, str]:
    """rare key to the key that claims it, from (key, cnt, rare, rare_cnt) of one column."""
    claims: dict[str, str] = {}
    for key, _, rare, _ in sorted(pairs, key=lambda p: (-p[1], p[0], -p[3], p[2])):
        if key not in claims and rare not in claims:
            claims[rare] = key
    return claims


def typo_claims(frequencies: DataFrame, categorical: list[str], most_values: int = MOST_VALUES) -> tuple[dict[str, dict[str, str]], set[str]]:
    """({column: {rare key: claiming key}}, columns skipped because they have more than ``most_values`` keys)."""
    if not categorical:
        return {}, set()
    counts = key_counts(frequencies, categorical)
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    skipped = {c for c, n in sizes.items() if n > most_values}
    chosen = [c for c in categorical if c not in skipped]
    pairs: dict[str, list] = {c: [] for c in chosen}
    if chosen:
        for r in candidate_pairs(counts.filter(F.col("column").isin(*chosen))).collect():
            pairs[r["column"]].append((r["key"], r["cnt"], r["rare"], r["rare_cnt"]))
    return {c: resolve(p) for c, p in pairs.items()}, skipped


def typo_checks(df: DataFrame, frequencies: DataFrame, categorical: list[str], dismissed: dict[str, set[str]] | None = None) -> list[CheckResult]:
    """A failed verdict for each column with likely typos, a passed one for a column with too many values to compare.
    ``dismissed`` holds, by column, keys that a person has judged to be right."""
    claims, skipped = typo_claims(frequencies, categorical)
    found = []
    for name in categorical:
        if name in skipped:
            found.append(CheckResult(f"typos:{name}", True, f"Skipped: more than {MOST_VALUES} different values", column=name, topic="typo"))
            continue
        own = {r: k for r, k in claims.get(name, {}).items() if r not in {v.strip().lower() for v in (dismissed or {}).get(name, ())}}
        if not own:
            continue
        rows = df.filter(match_key(column(name)).isin(*own))
        n = rows.count()
        shown = ", ".join(f"{r!r} for {k!r}" for r, k in sorted(own.items())[:5])
        found.append(CheckResult(f"typos:{name}", False, f"{len(own)} rare values look like misspellings ({shown}), in {n} rows", n, rows, column=name, topic="typo"))
    return found
