"""Run-event log: append-only table of finished stages with a JSON summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("stage", T.StringType(), False),
        T.StructField("summary", T.StringType(), True),
    ]
)


def append_events(events: DataFrame, path: str) -> None:
    """Append events to the log folder, one partition per stage."""
    events.select(*[f.name for f in EVENT_SCHEMA.fields]).write.mode("append").partitionBy("stage").parquet(path)


def append_artifacts(payloads: DataFrame, path: str) -> None:
    """Append full payloads ``(run_id, stage, payload)`` beside the log."""
    payloads.write.mode("append").partitionBy("stage").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def parse_summary(events: DataFrame, schema: str, col: str = "summary") -> DataFrame:
    """JSON summary as typed columns; text that is not JSON gives nulls."""
    return events.withColumn("parsed", F.from_json(col, schema)).select("*", "parsed.*").drop("parsed")


def latest_by_stage(events: DataFrame, stage: str = "stage", ts: str = "ts", run_id: str = "run_id") -> DataFrame:
    """Latest event of every stage: one map-side-combined aggregate, no sort of the log."""
    rest = [c for c in events.columns if c != stage]
    return events.groupBy(stage).agg(F.max_by(F.struct(*rest), F.struct(ts, run_id)).alias("e")).select(stage, "e.*")


def find_event(events: DataFrame, run_id: object, col: str = "run_id") -> DataFrame:
    """One event by id; the filter reaches the scan."""
    return events.where(F.col(col) == F.lit(run_id))


def activity_feed(logs: Sequence[tuple[str, DataFrame]], n: int | None = None) -> DataFrame:
    """Union of several logs, newest first."""
    parts = [df.select(F.lit(name).alias("source"), *EVENT_SCHEMA.fieldNames()) for name, df in logs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.orderBy(F.col("ts").desc(), "run_id", "source")
    return out.limit(n) if n else out
