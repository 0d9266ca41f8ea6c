"""Type guesses for text columns, all columns in one pass over the cells and one over the frequency relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions.coerce import to_datetime, to_float, to_integer
from auditloom.functions.text import column, is_null_cell, strip
from auditloom.operators.frequency import value_frequencies

PARSE_SHARE, CATEGORY_VALUES, CATEGORY_SHARE = 0.95, 200, 0.5

# Pairs of words that make a boolean column; 0 and 1 alone do not.
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("t", "f"), ("y", "n"))


@dataclass
class Guess:
    semantic: str
    confidence: float
    samples: list[str] = field(default_factory=list)


def blank_placeholders(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(the text columns with placeholder spellings as null, how many of each column were placeholders).

    The count includes cells that a reader gives as null where the file had an empty field.
    """
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(is_null_cell(column(c))) for c in text]).first()
    cleaned = df.select(*[F.when(~is_null_cell(column(c)), column(c)).alias(c) if c in text else column(c) for c in df.columns])
    return cleaned, {c: n for c, n in zip(text, counts[1:], strict=True) if n}


def guess_types(df: DataFrame) -> dict[str, Guess]:
    """A guess for each text column of a table whose placeholders are null already."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not names:
        return {}
    parts = []
    for i, name in enumerate(names):
        c = column(name)
        word = F.lower(strip(c))
        number, whole = to_float(c), to_integer(c)
        parts += [F.count(c).alias(f"n_{i}"), F.count(number).alias(f"f_{i}"), F.count_if(number.isNotNull() & whole.isNull()).alias(f"part_{i}"), F.count(to_datetime(c)).alias(f"d_{i}")]
        parts += [F.count_if(word.isin(*pair)).alias(f"b{k}_{i}") for k, pair in enumerate(BOOLEAN_PAIRS)]
    stats = df.agg(*parts).first()
    vf = value_frequencies(df, names)
    distinct = {r["column"]: r["n"] for r in vf.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("column").orderBy("first_row", "value")
    samples: dict[str, list] = {}
    for r in vf.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").collect():
        samples.setdefault(r["column"], []).append((r["rank"], r["value"]))
    guesses = {}
    for i, name in enumerate(names):
        n = stats[f"n_{i}"]
        shown = [v for _, v in sorted(samples.get(name, []))]
        if not n:
            guess = Guess("string", 0.0)
        elif any(stats[f"b{k}_{i}"] == n for k in range(len(BOOLEAN_PAIRS))):
            guess = Guess("boolean", 1.0)
        elif stats[f"f_{i}"] / n >= PARSE_SHARE:
            guess = Guess("float" if stats[f"part_{i}"] else "integer", stats[f"f_{i}"] / n)
        elif stats[f"d_{i}"] / n >= PARSE_SHARE:
            guess = Guess("datetime", stats[f"d_{i}"] / n)
        elif distinct.get(name, 0) <= CATEGORY_VALUES and distinct.get(name, 0) / n <= CATEGORY_SHARE:
            guess = Guess("categorical", 1 - distinct.get(name, 0) / n)
        else:
            guess = Guess("string", 1.0)
        guess.samples = shown
        guesses[name] = guess
    return guesses
