"""Session helpers shared by tests, the benchmark and long-running fits."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "loanforge") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    shuffle = str(cores) if str(cores).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _private_folder() -> str:
    path = tempfile.mkdtemp(prefix="loanforge-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the session's ``spark.checkpoint.dir``.

    With the setting unset, local mode (tests and the benchmark) uses one private
    folder per process, deleted when the process ends; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        return _private_folder()
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so that lost executors only re-read it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a query's own written tables."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/loanforge-{name}-{uuid.uuid4().hex}"
