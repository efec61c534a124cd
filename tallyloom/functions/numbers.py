"""Number rules of the KPI sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * value / total, 2)).otherwise(F.lit(0.0))


def variation(current: Column, previous: Column) -> Column:
    return (
        F.when(previous <= 0, F.when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
        .otherwise(F.round(F.lit(100.0) * (current - previous) / previous, 2))
    )


def whole_number(value: Column) -> Column:
    """Blank is 0, a number keeps its whole part, anything else is null."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(text.try_cast("double").try_cast("int"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.greatest(
        F.lit(0).cast("long"), F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    )


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))
