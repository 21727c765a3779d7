"""Labels, dates, percentages and tolerant property access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_text(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def short_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, 12)


def date_text(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Formatted date; unreadable or missing text reads 'Date unavailable'."""
    parsed = F.try_to_timestamp(value)
    return F.coalesce(F.date_format(parsed, pattern), F.lit("Date unavailable"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull(), "Unavailable").otherwise(
        F.format_string(f"%.{digits}f%%", value * 100)
    )


def fixed(value: Column, digits: int = 2) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, F.format_string(f"%.{digits}f", value)).otherwise("—")


def json_property(json: Column, key: str, default: str | None = None) -> Column:
    value = F.get_json_object(json, f"$.{key}")
    return value if default is None else F.coalesce(value, F.lit(default))
