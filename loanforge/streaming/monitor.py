"""Streaming jobs: windowed score monitoring, scoring of new rows, and the run-event stream.

The same aggregate and scoring functions run on batch tables, so a stream's
result can be compared with the batch result row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.functions.expressions import bin_left_closed, settle, status_above
from loanforge.operators.stress import PSI_FAIL, PSI_FLOOR, PSI_WARN
from loanforge.sources.runlog import latest_by_stage


@dataclass(frozen=True)
class ReferenceBins:
    """Frozen score bins of the training sample."""

    lo: float
    hi: float
    shares: tuple[float, ...]


def fit_reference(scored: DataFrame, p: str = "p", bins: int = 10) -> ReferenceBins:
    r = scored.agg(F.min(p).cast("double").alias("lo"), F.max(p).cast("double").alias("hi")).first()
    b = bin_left_closed(F.col(p).cast("double"), F.lit(r["lo"]), F.lit(r["hi"]), bins)
    n = {x["b"]: x["n"] for x in scored.where(F.col(p).isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    return ReferenceBins(r["lo"], r["hi"], tuple(n.get(i, 0) / total for i in range(bins)))


def period_window(ts: Column, width: str) -> Column:
    return F.window(ts, width)


def window_counts(scored: DataFrame, ref: ReferenceBins, width: str = "30 days", ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """n, sum of outcomes, sum of scores and bin counts per tumbling window."""
    k = len(ref.shares)
    x = F.least(F.greatest(F.col(p).cast("double"), F.lit(ref.lo)), F.lit(ref.hi))
    b = bin_left_closed(x, F.lit(ref.lo), F.lit(ref.hi), k)
    return (
        scored.withColumn("__b", b)
        .groupBy(F.window(F.col(ts), width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sum_y"), F.sum(F.col(p)).alias("sum_p"),
            *[F.count_if(F.col("__b") == i).alias(f"b{i}") for i in range(k)],
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "sum_y", "sum_p", *[f"b{i}" for i in range(k)])
    )


def monitor_report(counts: DataFrame, ref: ReferenceBins) -> DataFrame:
    """Backtest gap and stability index per window, with the retraining trigger."""
    psi = F.lit(0.0)
    for i, e in enumerate(ref.shares):
        e = e or PSI_FLOOR
        a = F.when(F.col(f"b{i}") == 0, F.lit(PSI_FLOOR)).otherwise(F.col(f"b{i}") / F.col("n"))
        psi = psi + (a - F.lit(e)) * F.log(a / F.lit(e))
    gap = F.abs(F.col("sum_y") - F.col("sum_p")) / F.col("n")
    return counts.select(
        "window_start", "window_end", "n",
        settle(F.col("sum_y") / F.col("n"), 6).alias("actual_dr"), settle(F.col("sum_p") / F.col("n"), 6).alias("avg_pred_pd"),
        settle(gap, 4).alias("gap"), F.round(psi, 6).alias("psi"), status_above(psi, PSI_WARN, PSI_FAIL).alias("status"),
        (psi > PSI_FAIL).alias("trigger"),
    )


def start_monitor(
    scored_stream: DataFrame, ref: ReferenceBins, out: str, checkpoint: str, width: str = "30 days", lateness: str = "3650 days", ts: str = "ts"
):
    """Monitor arriving scored rows; every update of a window is appended with its batch number.

    State is one row per open window; the watermark drops windows older than ``lateness``.
    """
    counts = window_counts(scored_stream.withWatermark(ts, lateness), ref, width, ts)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder, so results stay exactly-once
        monitor_report(batch, ref).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """Last written state of every window."""
    t = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    w = Window.partitionBy("window_start").orderBy(F.col("batch").desc())
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch")


def start_scoring(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Frozen plan and model over new rows: a stateless projection with a file sink."""
    return score(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_run_events(events: DataFrame, out: str, checkpoint: str, id_col: str = "run_id", ts: str = "ts"):
    """Event stream that keeps the latest event per stage; repeated events change nothing.

    Batch ``n`` merges its own latest rows with version ``n-1`` (one row per
    stage) into version ``n``; replaying a batch rewrites the same version.
    """
    spark = events.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{out}/version={batch_id - 1}"))
        latest_by_stage(rows, ts=ts, run_id=id_col).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_versions(spark: SparkSession, out: str) -> DataFrame:
    t = spark.read.option("basePath", out).parquet(f"{out}/version=*")
    top = t.agg(F.max("version")).first()[0]
    return t.where(F.col("version") == top).drop("version")


def read_table_stream(spark: SparkSession, path: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over one named table."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{path}/{name}.parque[t]")


def event_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zone-less timestamps as instants, as watermarks need."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols if isinstance(types[c], T.TimestampNTZType)})
