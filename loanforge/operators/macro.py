"""Macro series: alignment of mixed frequencies and month-precise as-of joins without look-ahead.

Series tables are calendar sized (dates, not loans), so ordering them in one
window is bounded; loans only ever see an equi join on the month.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _calendar(*order: str):
    return Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def assemble(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per observation date, one forward-filled column per series; of equal dates the largest value."""
    wide = series.groupBy("obs_date").pivot("series", list(names)).agg(F.max("value"))
    return wide.select("obs_date", *[F.last(n, ignorenulls=True).over(_calendar("obs_date")).alias(n) for n in names])


def as_of_months(series: DataFrame, months: DataFrame, names: Sequence[str]) -> DataFrame:
    """Value of every series at each month start: the last observation on or before it.

    ``months`` holds one column ``month``.
    """
    wide = series.groupBy("obs_date").pivot("series", list(names)).agg(F.max("value"))
    asked = months.where("month is not null").select(F.col("month").alias("obs_date"), F.lit(1).alias("asked"))
    both = wide.withColumn("asked", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    # rows of the same date: observations first, so that a month start sees its own observation
    w = _calendar("obs_date", "asked")
    filled = both.select("obs_date", "asked", *[F.last(n, ignorenulls=True).over(w).alias(f"macro_{n}") for n in names])
    return filled.where("asked = 1").select(F.col("obs_date").alias("month"), *[f"macro_{n}" for n in names])


def attach(df: DataFrame, date_col: str, series: DataFrame, names: Sequence[str], lookback_days: int | None = 400) -> DataFrame:
    """Add ``macro_<series>`` columns as of the month of ``date_col``; null before the first observation."""
    dated = df.withColumn("__month", F.trunc(date_col, "month").cast("date"))
    months = dated.select(F.col("__month").alias("month")).distinct()
    if lookback_days is not None:
        span = df.agg(F.min(date_col).cast("date").alias("lo"), F.max(date_col).cast("date").alias("hi")).first()
        if span["lo"] is not None:
            start = span["lo"] - dt.timedelta(days=lookback_days)
            series = series.where(F.col("obs_date").between(F.lit(start), F.lit(span["hi"])))
    lut = as_of_months(series, months, names)
    return dated.join(lut, dated["__month"] == lut["month"], "left").drop("__month", "month")


def attach_one(df: DataFrame, date_col: str, series: DataFrame, name: str) -> DataFrame:
    """A single series as of each date."""
    return attach(df, date_col, series.where(F.col("series") == name), [name], lookback_days=None)


def latest_values(series: DataFrame, on_or_before: dt.date | None = None) -> DataFrame:
    """Last observation per series, optionally up to a date."""
    s = series.where(F.col("value").isNotNull())
    if on_or_before is not None:
        s = s.where(F.col("obs_date") <= F.lit(on_or_before))
    return s.groupBy("series").agg(F.max_by("value", "obs_date").alias("value"), F.max("obs_date").alias("obs_date"))
