"""Analytic tables derived from the supplied tables, in Spark and as SQL text.

The SQL twins are CTE bodies that DuckDB runs for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanforge.sources.readers import load_table

LOANS_FREQ = {0: "monthly", 1: "quarterly", 2: "semi-annual", 3: "annual"}


def _scored_base(spark: SparkSession, path: str) -> DataFrame:
    o = load_table(spark, path, "orders")
    c = load_table(spark, path, "customer")
    z = F.lit(-2.0) + F.col("o_totalprice") / F.lit(200000.0) - F.col("c_acctbal") / F.lit(8000.0)
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("key"),
            F.col("o_orderdate").alias("ts"),
            F.col("c_mktsegment").alias("grp"),
            F.col("o_orderpriority").alias("prio"),
            F.col("c_acctbal").alias("acctbal"),
            F.col("o_totalprice").alias("price"),
            F.round(1.0 / (1.0 + F.exp(-z)), 6).alias("p"),
            "o_orderstatus",
            "c_nationkey",
        )
        .withColumn("y", F.when(((F.col("key") * 7919) % 10007) / F.lit(10007.0) < F.col("p"), 1).otherwise(0))
    )


def scored_loans(spark: SparkSession, path: str) -> DataFrame:
    """Scored table contract: key, y, p, ts, grp (+ drivers acctbal, price, prio)."""
    return _scored_base(spark, path).drop("o_orderstatus", "c_nationkey")


SCORED = """scored AS (
  SELECT *, CASE WHEN ((key*7919)%10007)/10007.0::DOUBLE < p THEN 1 ELSE 0 END AS y FROM (
    SELECT o_orderkey AS key, o_orderdate AS ts, c_mktsegment AS grp, o_orderpriority AS prio,
           c_acctbal AS acctbal, o_totalprice AS price,
           round(1.0::DOUBLE/(1.0::DOUBLE+exp(-(-2.0::DOUBLE+o_totalprice/200000.0::DOUBLE-c_acctbal/8000.0::DOUBLE))),6) AS p
    FROM orders JOIN customer ON o_custkey=c_custkey))"""

SPLIT = """split AS (
  SELECT *, CASE WHEN rn <= round(0.15::DOUBLE*n_cls) THEN 'test'
                 WHEN rn <= round(0.15::DOUBLE*n_cls)+round(0.15::DOUBLE*n_cls) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(key AS VARCHAR)||'42'), key) AS rn,
               count(*) OVER (PARTITION BY y) AS n_cls FROM scored))"""


def loans(spark: SparkSession, path: str) -> DataFrame:
    """Exposure table: amount, rate, months elapsed, months term, frequency, days past due, PDs, LTV."""
    li = load_table(spark, path, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount", "l_quantity", "l_shipdate"
    )
    o = load_table(spark, path, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    p = load_table(spark, path, "part").select("p_partkey", "p_size", "p_retailprice")
    freq = F.element_at(
        F.create_map(*[F.lit(x) for kv in LOANS_FREQ.items() for x in kv]), F.col("l_linenumber") % 4
    )
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("loan_amount"),
        F.col("l_tax").alias("interest_rate"),
        (F.col("l_quantity").cast("int")).alias("months_on_book"),
        (F.lit(12) + F.col("p_size") * 6).alias("term_months"),
        freq.alias("payment_frequency"),
        (F.abs(F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))) % 120).alias("dpd"),
        (F.lit(0.01) + F.col("l_discount") * F.lit(0.5)).alias("orig_pd"),
        (F.lit(0.01) + F.col("l_discount") * F.lit(0.5) + F.col("l_tax") * F.lit(0.4)).alias("pd"),
        (F.lit(0.4) + (F.col("p_size") / F.lit(50.0))).alias("ltv"),
        F.col("o_orderpriority").alias("product"),
    )


LOANS = """loans AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice AS loan_amount, l_tax AS interest_rate, CAST(l_quantity AS INTEGER) AS months_on_book,
         12+p_size*6 AS term_months,
         CASE l_linenumber%4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'semi-annual' ELSE 'annual' END AS payment_frequency,
         abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))%120 AS dpd,
         0.01::DOUBLE+l_discount*0.5::DOUBLE AS orig_pd,
         0.01::DOUBLE+l_discount*0.5::DOUBLE+l_tax*0.4::DOUBLE AS pd,
         0.4::DOUBLE+p_size/50.0::DOUBLE AS ltv, o_orderpriority AS product
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)"""


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Modelling table with nulls placed by rule: 6% and 9% sparse, one half-empty column, counts and flags."""
    k = F.col("key")
    return (
        _scored_base(spark, path)
        .select(
            "key",
            "ts",
            "y",
            F.when(k % 17 != 0, F.col("acctbal")).alias("acctbal"),
            "price",
            F.when(k % 10 >= 5, F.col("price") / 1000.0 - F.col("acctbal")).alias("sparse"),
            F.when(k % 13 != 0, F.when(k % 7 < 5, 0).otherwise(k % 5)).cast("int").alias("late_count"),
            F.when(k % 19 != 0, (k % 3 == 0).cast("int")).alias("has_card"),
            (F.col("price") * 0.5 + 10.0).alias("price_half"),
            F.when(k % 11 != 0, F.col("prio")).alias("prio"),
            F.col("grp").alias("segment"),
            F.col("o_orderstatus").alias("status"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
            F.when(k % 2 == 0, "Yes").otherwise("No").alias("opted_in"),
        )
    )


FEATURES = (
    SCORED
    + """, feats AS (
  SELECT s.key, s.ts, s.y,
         CASE WHEN s.key%17<>0 THEN s.acctbal END AS acctbal, s.price,
         CASE WHEN s.key%10>=5 THEN s.price/1000.0::DOUBLE-s.acctbal END AS sparse,
         CAST(CASE WHEN s.key%13<>0 THEN CASE WHEN s.key%7<5 THEN 0 ELSE s.key%5 END END AS INTEGER) AS late_count,
         CASE WHEN s.key%19<>0 THEN CASE WHEN s.key%3=0 THEN 1 ELSE 0 END END AS has_card,
         s.price*0.5::DOUBLE+10.0::DOUBLE AS price_half,
         CASE WHEN s.key%11<>0 THEN s.prio END AS prio, s.grp AS segment, o.o_orderstatus AS status,
         'N'||c.c_nationkey AS nation, CASE WHEN s.key%2=0 THEN 'Yes' ELSE 'No' END AS opted_in
  FROM scored s JOIN orders o ON o.o_orderkey=s.key JOIN customer c ON c.c_custkey=o.o_custkey)"""
)

NUMERIC = ["acctbal", "price", "sparse", "late_count", "has_card", "price_half"]
CATEGORICAL = ["prio", "segment", "status", "nation"]


def macro_series(spark: SparkSession, path: str) -> DataFrame:
    """Long series table ``(series, obs_date, value)``: one monthly, one quarterly series."""
    o = load_table(spark, path, "orders").select("o_orderdate", "o_totalprice")
    spec = F.array(
        F.struct(F.lit("avg_price").alias("series"), F.trunc("o_orderdate", "month").alias("obs_date")),
        F.struct(F.lit("order_count").alias("series"), F.trunc("o_orderdate", "quarter").alias("obs_date")),
    )
    return (
        o.select("o_totalprice", F.explode(spec).alias("s"))
        .groupBy("s.series", "s.obs_date")
        .agg(
            F.when(F.col("series") == "avg_price", F.avg("o_totalprice"))
            .otherwise(F.count(F.lit(1)).cast("double"))
            .alias("value")
        )
    )


MACRO = """macro AS (
  SELECT 'avg_price' AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date, avg(o_totalprice) AS value FROM orders GROUP BY 2
  UNION ALL
  SELECT 'order_count', CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2)"""
