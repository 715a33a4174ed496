"""Scans: delimited files, named tables, table listing and inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens a header CSV treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Null out missing-value tokens of string columns and NaN of float columns in one projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(~F.trim(c).isin(list(tokens)), c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def infer_csv_schema(spark: SparkSession, path: str, tokens: Sequence[str] = NA_TOKENS) -> T.StructType:
    """Column types of a header CSV from one aggregate over the string scan.

    A column is bigint or double when every non-missing value parses, else
    boolean, else string.
    """
    raw = null_tokens(spark.read.csv(path, header=True), tokens)
    checks = []
    for c in raw.columns:
        v = F.trim(F.col(f"`{c}`"))
        checks += [
            F.count(v).alias(f"n__{c}"),
            F.count(v.try_cast("bigint")).alias(f"i__{c}"),
            F.count(v.try_cast("double")).alias(f"d__{c}"),
            F.count_if(F.lower(v).isin("true", "false")).alias(f"b__{c}"),
        ]
    r = raw.agg(*checks).first()
    fields = []
    for c in raw.columns:
        n = r[f"n__{c}"]
        kind: T.DataType = T.StringType()
        if n and r[f"i__{c}"] == n:
            kind = T.LongType()
        elif n and r[f"d__{c}"] == n:
            kind = T.DoubleType()
        elif n and r[f"b__{c}"] == n:
            kind = T.BooleanType()
        elif not n:
            kind = T.DoubleType()
        fields.append(T.StructField(c, kind, True))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV to a table; pass a stored ``schema`` to skip the inference scan."""
    schema = schema or infer_csv_schema(spark, path)
    raw = null_tokens(spark.read.csv(path, header=True))
    return raw.select(
        *[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name)
          if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema.fields]
    )


def list_tables(spark: SparkSession, path: str) -> list[str]:
    """Tables of a source folder, by Hadoop listing so that any store works."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a named source; an unknown name is an error at analysis time."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a small scan over all cores before costly per-row work.

    Only a scan that yields fewer partitions than there are cores is
    repartitioned; by then it is at most a few file splits. A large table has
    more splits than cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def load_named(spark: SparkSession, path: str, name: str) -> DataFrame:
    """As :func:`load_table`, with the list of valid names in the error."""
    known = list_tables(spark, path)
    if name not in known:
        raise ValueError(f"unknown table {name!r}; available: {', '.join(known)}")
    return load_table(spark, path, name)


def inspect_table(df: DataFrame, name: str) -> DataFrame:
    """Row count plus dtype, unique ratio and the five smallest sample values per column, over all rows.

    Columns are unpivoted once, so values are counted in one shuffle whatever their number.
    """
    types = dict(df.dtypes)
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("v")) for i, c in enumerate(df.columns)])
    values = df.select(F.explode(items).alias("s")).select("s.*").groupBy("position", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("position").orderBy("v")
    first = values.where("v is not null").withColumn("r", F.row_number().over(w)).where("r <= 5")
    first = first.groupBy("position").agg(F.array_sort(F.collect_list("v")).alias("first"))
    stats = values.groupBy("position").agg(F.sum("k").alias("row_count"), F.count("v").alias("u")).join(first, "position", "left")
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype")) for c in df.columns])
    return stats.select(
        F.lit(name).alias("table"), "row_count", "position", F.element_at(names, F.col("position") + 1).alias("c"),
        F.round(F.col("u") / F.col("row_count"), 4).alias("unique_ratio"), F.coalesce(F.concat_ws("|", "first"), F.lit("")).alias("sample_values"),
    ).select("table", "row_count", "position", "c.*", "unique_ratio", "sample_values")
