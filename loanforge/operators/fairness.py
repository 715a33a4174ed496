"""Group performance and disparate impact over protected columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanforge.operators.evaluate import auc_column
from loanforge.operators.ordering import score_ladder

# Column-name stems treated as protected characteristics.
PROTECTED_STEMS = [
    "gender", "sex", "age", "ethnicity", "race", "nationality", "marital", "education", "employment", "loan_purpose",
]


def protected_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in PROTECTED_STEMS)]


def group_performance(scored: DataFrame, group: str, min_rows: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """count, default rate, mean PD and AUC per group of at least ``min_rows`` rows."""
    g = scored.withColumn("group", F.coalesce(F.col(group).cast("string"), F.lit("Unknown"))).select("group", y, p)
    base = (
        g.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg(y), 4).alias("default_rate"),
            F.round(F.avg(p), 4).alias("avg_predicted_pd"),
        )
        .where(F.col("count") >= min_rows)
    )
    auc = score_ladder(g, y, p, ["group"]).groupBy("group").agg(F.round(auc_column(), 4).alias("auc"))
    return base.join(auc, "group", "left")


def bias_check(scored: DataFrame, group: str, min_rows: int = 10) -> DataFrame:
    """AUC gap over groups with PASS below 0.05, WARN below 0.10, else FAIL."""
    x = group_performance(scored, group, min_rows).agg(
        F.count("auc").alias("n_groups"), F.max("auc").alias("max_auc"), F.min("auc").alias("min_auc")
    )
    gap = F.round(F.col("max_auc") - F.col("min_auc"), 4)
    return x.select(
        "n_groups", "max_auc", "min_auc", gap.alias("auc_gap"),
        F.when(F.col("n_groups") < 2, "WARN").when(gap < 0.05, "PASS").when(gap < 0.10, "WARN").otherwise("FAIL").alias("status"),
    )


def disparate_impact(df: DataFrame, protected: Sequence[str], y: str = "y", fail_below: float = 0.80) -> DataFrame:
    """Lowest over highest outcome rate per protected column with 2 to 20 groups."""
    long = df.select(
        F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in protected])).alias("s"),
    ).select("y", "s.*")
    rates = long.where("v is not null").groupBy("feature", "v").agg(F.avg("y").alias("rate"))
    x = rates.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_groups"), F.round(F.min("rate"), 4).alias("min_rate"), F.round(F.max("rate"), 4).alias("max_rate")
    )
    ratio = F.when(F.col("max_rate") > 0, F.round(F.col("min_rate") / F.col("max_rate"), 4)).otherwise(F.lit(1.0))
    return x.where(F.col("n_groups").between(2, 20)).select(
        "*", ratio.alias("di_ratio"), F.when(ratio < fail_below, "FAIL").otherwise("PASS").alias("status")
    )
