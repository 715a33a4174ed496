"""Additive score contributions, top drivers and reason codes for linear scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: float(r[c] or 0.0) for c in cols}


def contributions(coefficients: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """Array of (feature, value, contribution): coefficient times distance from the mean, nulls at the mean."""
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                (F.lit(float(b)) * (F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c]))).alias("contribution"),
            )
            for c, b in coefficients.items()
        ]
    )


def mean_abs_contribution(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float] | None = None, top: int = 15) -> DataFrame:
    """Mean absolute contribution of the strongest features."""
    means = means or column_means(df, list(coefficients))
    a = df.agg(
        *[F.avg(F.abs(F.lit(float(b)) * (F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c])))).alias(c) for c, b in coefficients.items()]
    )
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in coefficients])).alias("r")).select("r.*")
    return rows.orderBy(F.col("v").desc(), "feature").limit(top).select("feature", F.round("v", 6).alias("mean_abs_contribution"))


def _strongest(coefficients: Mapping[str, float], means: Mapping[str, float], n: int) -> Column:
    """The ``n`` largest contributions of the row: an in-row sort, no shuffle."""
    by_size = F.array_sort(
        contributions(coefficients, means),
        lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
        .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
        .when(a["feature"] < b["feature"], -1)
        .when(a["feature"] > b["feature"], 1)
        .otherwise(0),
    )
    return F.slice(by_size, 1, n)


def top_drivers(
    df: DataFrame, key: str, coefficients: Mapping[str, float], means: Mapping[str, float] | None = None, n: int = 12
) -> DataFrame:
    """The ``n`` largest contributions of every row, ranked."""
    means = means or column_means(df, list(coefficients))
    x = df.select(key, F.posexplode(_strongest(coefficients, means, n)).alias("pos", "s"))
    return x.select(
        key, (F.col("pos") + 1).alias("rank"), "s.feature", F.round("s.value", 4).alias("value"), F.round("s.contribution", 6).alias("contribution")
    )


def reason_codes(
    df: DataFrame, key: str, coefficients: Mapping[str, float], p: str = "p", threshold: float = 0.5,
    means: Mapping[str, float] | None = None, n: int = 5,
) -> DataFrame:
    """Decision label and the five strongest drivers as text for every row."""
    means = means or column_means(df, list(coefficients))
    text = F.transform(
        _strongest(coefficients, means, n),
        lambda s: F.concat(s["feature"], F.when(s["contribution"] > 0, " increases").otherwise(" reduces"), F.lit(" default risk")),
    )
    return df.select(
        key,
        F.when(F.col(p) >= threshold, "HIGH RISK").otherwise("LOW RISK").alias("decision"),
        F.round(p, 6).alias("probability"),
        F.concat_ws("; ", text).alias("reasons"),
    )
