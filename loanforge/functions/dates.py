"""Calendar period labels and date parts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("Monthly", "Quarterly", "Half-yearly", "Yearly")


def period_label(d: Column, freq: str) -> Column:
    """Label of the calendar period: 2024-03, 2024Q1, 2024H1 or 2024."""
    y = F.year(d).cast("string")
    if freq == "Monthly":
        return F.date_format(d, "yyyy-MM")
    if freq == "Quarterly":
        return F.concat(y, F.lit("Q"), F.quarter(d).cast("string"))
    if freq == "Half-yearly":
        return F.concat(y, F.lit("H"), F.when(F.month(d) <= 6, "1").otherwise("2"))
    if freq == "Yearly":
        return y
    raise ValueError(f"unknown frequency {freq!r}")


def date_parts(d: Column, prefix: str) -> dict[str, Column]:
    """year, month, day, Monday=0 weekday, weekend flag, quarter; null dates give 0."""
    zero = F.lit(0)
    return {
        f"{prefix}_year": F.coalesce(F.year(d), zero),
        f"{prefix}_month": F.coalesce(F.month(d), zero),
        f"{prefix}_day": F.coalesce(F.day(d), zero),
        f"{prefix}_dayofweek": F.coalesce(F.weekday(d), zero),
        f"{prefix}_is_weekend": F.coalesce((F.weekday(d) >= 5).cast("int"), zero),
        f"{prefix}_quarter": F.coalesce(F.quarter(d), zero),
    }
