"""Text cells to the six semantic types, as native expressions that never raise.

A cell that cannot take the type becomes null; the caller counts or reports it by comparing with the
cell before. Empty text fails every type but string and categorical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import strip

# The literals of the boolean type, in lower case.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

_NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_INFINITE = r"\A[+-]?(?i:inf|infinity)\z"
_PLAIN_INTEGER = r"\A[+-]?[0-9]+\z"


def float_of(s: Column) -> Column:
    """Double of a trimmed cell, by the grammar of decimal numbers. Spelled infinities pass; a number too large for a double and
    spelled NaN become null."""
    d = s.try_cast("double")
    finite = F.when(s.rlike(_NUMBER) & (F.abs(d) < F.lit(float("inf"))), d)
    return F.when(s.rlike(_INFINITE), d).otherwise(finite)


def integer_of(s: Column) -> Column:
    """Long of a trimmed cell. Integral decimals ("1.0", "1e3") pass; fractions, infinities and anything from 2^63 on become null.
    Plain digits keep their exact value beyond 2^53."""
    d = s.try_cast("double")
    integral = s.rlike(_NUMBER) & (F.abs(d) < F.lit(2.0**63)) & (d % F.lit(1.0) == F.lit(0.0))
    return F.when(s.rlike(_PLAIN_INTEGER), s.try_cast("bigint")).when(integral, d.try_cast("bigint"))


def to_float(c: Column) -> Column:
    return float_of(strip(c))


def to_integer(c: Column) -> Column:
    return integer_of(strip(c))


def to_boolean(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin(*TRUE_WORDS), F.lit(True)).when(s.isin(*FALSE_WORDS), F.lit(False))


# The written forms of a day besides ISO, as patterns over a trimmed cell without its time, with the form
# in which each is read (a replacement that gives ISO, or a named-month format). Where two are given, the first that
# names an existing day counts.
_FORMS = (
    (r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z", ("$1-$2-$3",), ()),
    (r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z", ("$3-$1-$2", "$3-$2-$1"), ()),
    (r"\A([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})\z", ("$1-$2-$3",), ()),
    (r"\A[A-Za-z]{3} [0-9]{1,2} [0-9]{4}\z", (), ("MMM d yyyy",)),
    (r"\A[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}\z", (), ("d MMMM yyyy", "d MMM yyyy")),
    (r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z", ("$1-$2-$3",), ()),
    (r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})\z", ("20$3-$1-$2", "20$3-$2-$1"), ()),
)
_MIDNIGHT = r"(?i)(?:[ T]0{1,2}:00(?::00(?:\.0{1,9})?)?| 12:00(?::00)? AM)\z"
_CLOCK = r"(?i)[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?(?: ?(AM|PM))?\z"


def _day_of(s: Column) -> Column:
    """The day a trimmed text without a time writes; month first where both orders name a day."""
    found = F.when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), s.try_cast("date"))
    for pattern, replacements, formats in _FORMS:
        read = [F.regexp_replace(s, pattern, r).try_cast("date") for r in replacements]
        read += [F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats]
        found = found.when(s.rlike(pattern), F.coalesce(*read))
    return found


def day_of(s: Column) -> Column:
    """Date of a trimmed cell that writes a day that exists, with or without a midnight time; else null."""
    return _day_of(F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, _MIDNIGHT, "")).otherwise(s))


def to_day(c: Column) -> Column:
    return day_of(strip(c))


def to_datetime(c: Column) -> Column:
    """Timestamp without zone: ISO timestamps, then the other forms of a day with an optional clock time.
    Offsets are dropped, clock-relative texts ("now", a bare time) are null."""
    s = strip(c)
    hour, minute, second = (F.regexp_extract(s, _CLOCK, g).try_cast("int") for g in (1, 2, 3))
    half = F.upper(F.regexp_extract(s, _CLOCK, 4))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    day = _day_of(F.regexp_replace(s, _CLOCK, ""))
    valid = hour24.between(0, 23) & minute.between(0, 59) & F.coalesce(second, F.lit(0)).between(0, 59)
    clock = hour24 * 3600 + minute * 60 + F.coalesce(second, F.lit(0))
    clocked = F.when(valid, day.cast("timestamp_ntz") + F.make_dt_interval(secs=clock))
    return (
        F.when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9].*)?\z"), s.try_cast("timestamp_ntz"))
        .when(s.rlike(_CLOCK), clocked)
        .otherwise(_day_of(s).cast("timestamp_ntz"))
    )


def coerced(c: Column, semantic: str) -> Column:
    """The cell in a semantic type. Raises ValueError for an unknown type name."""
    if semantic in ("string", "categorical"):
        return c.cast("string")
    makers = {"integer": to_integer, "float": to_float, "boolean": to_boolean, "datetime": to_datetime}
    if semantic not in makers:
        raise ValueError(f"unknown type {semantic!r}")
    return makers[semantic](c)
