"""Text expressions shared by every operator: strip, null cells, folding, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a cell is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0          "
    "      　"
)

# The spellings that stand for a missing value, trimmed and in lower case.
NULL_SPELLINGS = (
    "", "na", "n/a", "n.a.", "none", "null", "nul", "nil", "-", "--", "unknown", "unk", "missing",
    "not available", "not applicable", "?", "nan", "nat",
)


def quoted(name: str) -> str:
    """The column name as a SQL identifier; back ticks are doubled."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, whatever characters (dots, ticks) it holds."""
    return F.col(quoted(name))


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends. Null stays null."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_cell(c: Column) -> Column:
    """True for null and for the placeholder spellings, whatever case or padding. Never null."""
    return stripped_is_null_cell(strip(c))


def stripped_is_null_cell(s: Column) -> Column:
    """The same of a cell that is trimmed already."""
    return s.isNull() | F.lower(s).isin(*NULL_SPELLINGS)


def fold(c: Column) -> Column:
    """Lower case without anything but letters and digits. Null folds to the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def match_key(c: Column) -> Column:
    """Key under which two spellings are case or white-space variants of each other."""
    return F.lower(strip(c))
