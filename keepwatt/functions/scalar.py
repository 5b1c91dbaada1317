"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_months(start: Column, end: Column) -> Column:
    """Signed number of complete months from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("MONTH", start, end)


def cast_float(c: Column, strict: bool = True) -> Column:
    return c.cast("double") if strict else c.try_cast("double")


def cast_int(c: Column, strict: bool = True, missing_is_error: bool = True) -> Column:
    """To BIGINT, truncating toward zero, also from text like '3.0'. Strict: bad text is an
    error, and so are missing values unless ``missing_is_error`` is off."""
    text = c.cast("string")
    digits = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    if not strict:
        return F.when(digits, text.try_cast("bigint")).otherwise(
            text.try_cast("double").try_cast("bigint"))
    number = F.when(digits, text.cast("bigint")).otherwise(text.cast("double").cast("bigint"))
    if not missing_is_error:
        return number
    missing = F.raise_error(F.lit("cannot convert a missing value to an integer"))
    return F.when(c.isNotNull(), number).otherwise(missing.cast("bigint"))


def cast_text(c: Column) -> Column:
    return c.cast("string")


def cast_timestamp(c: Column, fmt: str | None = None, strict: bool = True) -> Column:
    if strict:
        return F.to_timestamp(c, fmt) if fmt else c.cast("timestamp")
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.try_cast("timestamp")


def cast_boolean_flag(c: Column) -> Column:
    """1 for 't' or 'true' in any case, 0 for everything else including missing; no trimming."""
    return F.when(F.lower(c.cast("string")).isin("t", "true"), 1).otherwise(0)


def churn_label(c: Column) -> Column:
    return F.when(c == 1, "churn").when(c == 0, "no churn")


def evenly_spaced(index: Column, lo: Column, hi: Column, points: int) -> Column:
    """Point ``index`` of ``points`` evenly spaced ones from ``lo`` to ``hi``, both included."""
    if points == 1:
        return lo
    inner = lo + index * ((hi - lo) / (points - 1))
    return F.when(index == points - 1, hi).otherwise(inner)
