"""Scalar functions whose exact meaning differs from Spark's built-in of that name, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_space(s: Column) -> Column:
    """White space of every kind off both ends, not blanks alone."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def substring_clip(s: Column, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 is clipped and uses up length."""
    if length is not None and length < 0:
        raise ValueError("negative substring length")
    begin = max(start, 1)
    if length is None:
        return F.substring(s, F.lit(begin), F.length(s))
    end = start - 1 + length
    return F.when(s.isNull(), F.lit(None).cast("string")).when(F.lit(end < begin), F.lit("")).otherwise(F.substring(s, begin, max(end - begin + 1, 0)))


def ceil_keep(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor_keep(x: Column) -> Column:
    return F.floor(x).cast("double")


def mod_null(a: Column, b: Column) -> Column:
    """Sign of a; null where b is 0."""
    return F.try_mod(a, b)


def power_checked(x: Column, y: Column) -> Column:
    out = F.pow(x, y)
    return F.when(F.isnan(out), F.raise_error(F.lit("POWER: not a number")).cast("double")).otherwise(out)


def sqrt_checked(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("SQRT of a negative number")).cast("double")).otherwise(F.sqrt(x))


def number_to_text(x: Column) -> Column:
    """1.0 becomes '1'; other numbers as Spark writes them."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def text_to_boolean(s: Column) -> Column:
    """true, t, 1 and false, f, 0 in any case; anything else fails."""
    low = F.lower(s)
    return F.when(low.isin("true", "t", "1"), F.lit(True)).when(low.isin("false", "f", "0"), F.lit(False)).when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))


EXTRACTS = {
    "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear, "QUARTER": F.quarter, "WEEK": F.weekofyear,
    "DOW": lambda t: F.dayofweek(t) - 1, "EPOCH": lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000),
    "MICROSECOND": lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)), "MILLISECOND": lambda t: F.floor(F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) / 1000),
}


def extract(field: str, t: Column) -> Column:
    """UTC; DOW counts from Sunday = 0; sub-second fields leave whole seconds out; EPOCH is whole seconds."""
    name = {"DAYOFWEEK": "DOW", "DAYOFYEAR": "DOY", "MILLISECONDS": "MILLISECOND", "MICROSECONDS": "MICROSECOND"}.get(field.upper(), field.upper())
    return F.floor(EXTRACTS[name](t)).cast("long")


def date_trunc_keep(field: str, t: Column, is_date: bool) -> Column:
    """A date stays a date for YEAR, MONTH and DAY; otherwise a timestamp, never before 1970."""
    out = F.date_trunc(field, t)
    if is_date and field.upper() in ("YEAR", "MONTH", "DAY"):
        return out.cast("date")
    return F.greatest(out, F.lit("1970-01-01").cast("timestamp_ntz"))


#: Types that a cast leaves alone: only to themselves.
IDENTITY_ONLY = ("decimal", "date", "timestamp", "timestamp_ntz", "binary", "variant")


def cast_checked(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """CAST between texts, numbers and booleans; dates, times, decimals and bytes cast to their own type alone."""
    a, b = have.typeName(), want.typeName()
    if a != b and (a in IDENTITY_ONLY or b in IDENTITY_ONLY):
        raise TypeError(f"no cast from {a} to {b}")
    if a == "string" and b == "boolean":
        return text_to_boolean(c)
    if a in ("double", "float") and b == "string":
        return number_to_text(c)
    return (F.btrim(c) if a == "string" and b != "string" else c).cast(want)


def sum_checked(c: Column, kind: T.DataType) -> Column:
    """SUM of the input's own type: a sum beyond it is an error."""
    return F.sum(c).cast(kind)
