"""Sinks: exports and replace-table loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanforge.sources.readers import read_csv


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write a dataset, report or plan table as CSV, JSON or Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def replace_table(spark: SparkSession, csv_path: str, table_path: str) -> int:
    """Load a CSV into a table folder, replacing it; returns the stored row count."""
    read_csv(spark, csv_path).write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path).count()
