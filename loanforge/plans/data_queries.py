"""Scan, role and profile queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loanforge.operators import profile as pf
from loanforge.operators import roles
from loanforge.plans.fixtures import CATEGORICAL, FEATURES, NUMERIC, SCORED, feature_table, scored_loans
from loanforge.plans.registry import Registry
from loanforge.session import scratch_path
from loanforge.sources import readers, writers

REG = Registry()
FT = "WITH " + FEATURES
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
FEATURE_COLUMNS = ["key", "ts", "y", "acctbal", "price", "sparse", "late_count", "has_card", "price_half", "prio",
                   "segment", "status", "nation", "opted_in"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


@REG.query("a1_csv_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch_path(spark, "csv")
    writers.export(readers.load_table(spark, d, "customer"), path, "csv")
    return readers.read_csv(spark, path)


@REG.query("a2_named_table", "SELECT * FROM supplier")
def _(spark, d):
    return readers.load_named(spark, d, "supplier")


@REG.query("a3_list_tables", union(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in TABLES))
def _(spark, d):
    out = None
    for t in readers.list_tables(spark, d):
        n = readers.load_table(spark, d, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("row_count"))
        out = n if out is None else out.unionByName(n)
    return out


_CUST = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@REG.query(
    "a3_inspect_table",
    "WITH s AS (SELECT * FROM customer), n AS (SELECT count(*) AS n FROM customer) "
    + union(
        f"SELECT 'customer' AS \"table\", (SELECT n FROM n) AS row_count, {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
        f"round(count(DISTINCT {c})/count(*)::DOUBLE,4) AS unique_ratio, "
        f"array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))),1,5),'|') AS sample_values FROM s"
        for i, (c, t) in enumerate(_CUST)
        if t != "double"
    ),
)
def _(spark, d):
    df = readers.load_table(spark, d, "customer")
    return readers.inspect_table(df, "customer").where(F.col("dtype") != "double")


def _role_case(table: str, col: str) -> str:
    return f"""SELECT '{col}' AS "column", CASE WHEN num>=0.95 THEN 'numeric' WHEN sep>=0.8 AND dat>=0.95 THEN 'datetime'
 WHEN (u>0.9*n AND u>50) OR u>0.95*n THEN 'id' ELSE 'categorical' END AS detected_type FROM (
 SELECT count({col})::DOUBLE n, count(DISTINCT {col}) u, count(TRY_CAST(trim({col}) AS DOUBLE))/count({col})::DOUBLE num,
  avg(CASE WHEN regexp_matches({col},'[-/:]') THEN 1.0 ELSE 0.0 END) sep, count(TRY_CAST({col} AS TIMESTAMP))/count({col})::DOUBLE dat FROM {table})"""


@REG.query("a6_table_export", "SELECT * FROM supplier")
def _(spark, d):
    t = readers.load_table(spark, d, "supplier")
    path = scratch_path(spark, "export")
    writers.export(t, path, "json")
    return spark.read.schema(t.schema).json(path)


@REG.query("a7_replace_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, d):
    csv, table = scratch_path(spark, "csv"), scratch_path(spark, "table")
    t = readers.load_table(spark, d, "part")
    writers.export(t, csv, "csv")
    writers.replace_table(spark, csv, table)
    writers.replace_table(spark, csv, table)  # a second load leaves one copy
    return spark.read.parquet(table)


@REG.query(
    "b1_column_types",
    union(
        ["SELECT 'event_id' AS \"column\", CASE WHEN count(DISTINCT event_id)>0.9*count(*) THEN 'id' ELSE 'numeric' END AS detected_type FROM events",
         "SELECT 'ts', 'datetime'", "SELECT 'user_id', CASE WHEN count(DISTINCT user_id)>0.9*count(*) THEN 'id' ELSE 'numeric' END FROM events",
         _role_case("events", "event_type"), "SELECT 'value', 'numeric'", _role_case("events", "props")]
    ),
)
def _(spark, d):
    return roles.detected_types(readers.load_table(spark, d, "events"))


@REG.query(
    "b1_column_types_text",
    union([_role_case("doc", c) for c in ("day", "amount", "lang", "source", "code")]).replace("FROM doc", """FROM (
 SELECT strftime(DATE '2020-01-01' + CAST(doc_id%365 AS INTEGER),'%Y-%m-%d') AS day, CAST(n_chars AS VARCHAR) AS amount, lang, source, md5(CAST(doc_id AS VARCHAR)) AS code FROM documents)"""),
)
def _(spark, d):
    t = readers.load_table(spark, d, "documents")
    return roles.detected_types(
        t.select(
            F.date_format(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("day"),
            F.col("n_chars").cast("string").alias("amount"),
            "lang",
            "source",
            F.md5(F.col("doc_id").cast("string")).alias("code"),
        )
    )


@REG.query(
    "b2_target_candidates",
    FT + """, c AS (SELECT 1 AS o, 'y' AS "column", count(DISTINCT y)=2 AS a FROM feats)
 SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rank, "column" FROM c WHERE a""",
)
def _(spark, d):
    return roles.target_candidate_table(feature_table(spark, d))


@REG.query(
    "b2_target_candidates_by_rate",
    FT + """, r AS (SELECT 1 AS o, 'bad_mark' AS "column", avg(y) AS m FROM feats UNION ALL SELECT 2, 'has_card', avg(has_card) FROM feats)
 SELECT CAST(row_number() OVER (ORDER BY CASE WHEN "column" LIKE '%bad%' OR "column" LIKE '%default%' THEN 0 ELSE 1 END, o) AS INTEGER) AS rank, "column"
 FROM r WHERE m BETWEEN 0.01 AND 0.5""",
)
def _(spark, d):
    f = feature_table(spark, d)
    return roles.target_candidate_table(f.select("key", "ts", "acctbal", "has_card", F.col("y").alias("bad_mark"), "price", "late_count"))


_TASK = """SELECT '{c}' AS "column", CASE WHEN u<=2 AND lo>-1 AND hi<2 THEN 'binary' WHEN u<=10 AND fr=0 THEN 'multiclass' ELSE 'regression' END AS task_type
 FROM (SELECT count(DISTINCT {c}) u, min({c}) lo, max({c}) hi, count(*) FILTER ({c}<>round({c})) fr FROM feats)"""


@REG.query("b4_task_type", FT + " " + union(_TASK.format(c=c) for c in ("y", "late_count", "price", "has_card", "acctbal")))
def _(spark, d):
    return roles.task_types(feature_table(spark, d), ["y", "late_count", "price", "has_card", "acctbal"])


@REG.query(
    "b5_date_columns",
    """WITH r AS (SELECT 1 AS o, 'origination_date' AS "column", count(TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP))/count(*)::DOUBLE AS rate, true AS preferred FROM orders
 UNION ALL SELECT 2, 'default_date', count(o_orderdate)/count(*)::DOUBLE, false FROM orders
 UNION ALL SELECT 3, 'o_orderpriority', count(TRY_CAST(o_orderpriority AS TIMESTAMP))/count(*)::DOUBLE, false FROM orders)
 SELECT CAST(row_number() OVER (ORDER BY preferred DESC, o) AS INTEGER) AS rank, "column", preferred FROM r WHERE rate>=0.8""",
)
def _(spark, d):
    o = readers.load_table(spark, d, "orders")
    return roles.date_column_table(
        o.select(
            "o_orderkey",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("origination_date"),
            F.col("o_orderdate").alias("default_date"),
            "o_orderpriority",
        )
    )


@REG.query(
    "b9_target_bins_quantile",
    """WITH q AS (SELECT quantile_cont(o_totalprice,[0.2,0.4,0.6,0.8]) AS q FROM orders)
 SELECT 'Band_'||(1+len(list_filter(q, lambda x: x < o_totalprice))) AS band, count(*) AS n FROM orders, q WHERE o_totalprice IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return roles.bin_counts(readers.load_table(spark, d, "orders"), "o_totalprice", n_bins=5)


@REG.query(
    "b9_target_bins_equal_width",
    """WITH q AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders), e AS (SELECT list_transform([1,2,3,4], lambda i: lo+(hi-lo)*i/5) AS q FROM q)
 SELECT 'Band_'||(1+len(list_filter(q, lambda x: x < o_totalprice))) AS band, count(*) AS n FROM orders, e WHERE o_totalprice IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return roles.bin_counts(readers.load_table(spark, d, "orders"), "o_totalprice", n_bins=5, method="equal_width")


@REG.query(
    "b9_target_bins_custom",
    """SELECT CASE WHEN o_totalprice<=100000 THEN 'low' WHEN o_totalprice<=250000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n
 FROM orders WHERE o_totalprice BETWEEN 0 AND 1e9 GROUP BY 1""",
)
def _(spark, d):
    return roles.bin_counts(
        readers.load_table(spark, d, "orders"), "o_totalprice", edges=[0, 100000, 250000, 1e9], labels=["low", "mid", "high"]
    )


@REG.query(
    "c1_missingness",
    FT + " , t AS (" + union(f"SELECT '{c}' AS \"column\", count(*)-count({c}) AS missing, count(*) AS n FROM feats" for c in FEATURE_COLUMNS)
    + """) SELECT "column", missing, round(missing/n::DOUBLE*100,4) AS percentage FROM t UNION ALL
 SELECT '__total__', CAST(sum(missing) AS BIGINT), round(sum(missing)/sum(n)::DOUBLE*100,4) FROM t""",
)
def _(spark, d):
    return pf.missingness(feature_table(spark, d))


@REG.query(
    "c2_duplicate_rows",
    """WITH r AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey%20=0), g AS (SELECT count(*) AS n FROM (SELECT r AS w FROM r) GROUP BY w)
 SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n-1) AS BIGINT) AS duplicate_rows, round(sum(n-1)/sum(n)::DOUBLE*100,4) AS duplicate_rate FROM g""",
)
def _(spark, d):
    rows = readers.load_table(spark, d, "lineitem")
    return pf.duplicate_rows(rows.unionByName(rows.where("l_orderkey % 20 = 0")))


_NSUM = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}),3) AS mean, round(stddev_samp({c}),3) AS std, round(min({c})::DOUBLE,3) AS min,
 round(quantile_cont({c}::DOUBLE,0.25),3) AS q25, round(quantile_cont({c}::DOUBLE,0.5),3) AS q50, round(quantile_cont({c}::DOUBLE,0.75),3) AS q75,
 round(max({c})::DOUBLE,3) AS max, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM feats"""
_CSUM = """SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
 (SELECT {c} FROM feats WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1),
 (SELECT count(*) FROM feats WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) FROM feats"""


@REG.query("c3_summary_statistics", FT + " " + union([_NSUM.format(c=c) for c in NUMERIC] + [_CSUM.format(c=c) for c in CATEGORICAL]))
def _(spark, d):
    return pf.summary_statistics(feature_table(spark, d), NUMERIC, CATEGORICAL)


_C4 = [("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"), ("o_orderstatus", "categorical", "string"),
       ("o_totalprice", "numeric", "double"), ("o_orderdate", "datetime", "timestamp_ntz"), ("o_orderpriority", "categorical", "string")]


@REG.query(
    "c4_column_type_table",
    union(
        f"SELECT '{c}' AS \"column\", '{r}' AS detected_type, '{t}' AS dtype, count(DISTINCT {c}) AS unique_values, count({c}) AS non_null_count FROM orders"
        for c, r, t in _C4
    ),
)
def _(spark, d):
    return roles.column_type_table(readers.load_table(spark, d, "orders"))


def _dd(c: str, num: bool) -> str:
    stats = (
        f"round(min({c})::DOUBLE,4) AS min, round(max({c})::DOUBLE,4) AS max, round(avg({c}),4) AS mean"
        if num
        else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
    )
    return (
        f"SELECT '{c}' AS \"column\", count(*)-count({c}) AS missing, round((count(*)-count({c}))/count(*)::DOUBLE*100,2) AS missing_pct, {stats}, "
        f"count(DISTINCT {c}) AS \"unique\", array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))),1,3),', ') AS sample_values FROM feats"
    )


_DD_NUMBERS = ["key", "y", "acctbal", "price", "sparse", "late_count", "has_card", "price_half"]


@REG.query("c5_data_dictionary", FT + " " + union(_dd(c, c in _DD_NUMBERS) for c in [*_DD_NUMBERS, "ts", "prio", "segment", "status", "nation", "opted_in"]))
def _(spark, d):
    return pf.data_dictionary(feature_table(spark, d))


def corr_sql(cols, table="feats") -> str:
    return union(
        f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a},{b}),0) AS r FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


@REG.query("c6_correlation_matrix", FT + f", r AS ({corr_sql(NUMERIC)}) SELECT a, b, round(r,4) AS corr FROM r")
def _(spark, d):
    return pf.correlation_pairs(feature_table(spark, d), NUMERIC)


_H = ["price", "acctbal", "sparse", "late_count"]


@REG.query(
    "c7_histograms",
    FT + ", b AS (" + union(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM feats" for c in _H)
    + "), v AS (" + union(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM feats WHERE {c} IS NOT NULL" for c in _H)
    + """), n AS (SELECT v."column", CAST(least(floor((x-lo)/(hi-lo)*20),19) AS INTEGER) AS bin, count(*) AS n FROM v JOIN b ON v."column"=b."column" GROUP BY 1,2)
 SELECT b."column", CAST(i AS INTEGER) AS bin, round(lo+(hi-lo)*i/20.0::DOUBLE,4) AS lo, round(lo+(hi-lo)*(i+1)/20.0::DOUBLE,4) AS hi, coalesce(n,0) AS count
 FROM b CROSS JOIN range(0,20) t(i) LEFT JOIN n ON n."column"=b."column" AND n.bin=i""",
)
def _(spark, d):
    return pf.histograms(feature_table(spark, d), _H)


@REG.query(
    "c8_iqr_outliers",
    FT + ", t AS (" + union(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER ({c}<q1-1.5::DOUBLE*(q3-q1) OR {c}>q3+1.5::DOUBLE*(q3-q1)) AS outlier_count "
        f"FROM feats, (SELECT quantile_cont({c}::DOUBLE,0.25) q1, quantile_cont({c}::DOUBLE,0.75) q3 FROM feats)"
        for c in NUMERIC
    ) + ") SELECT \"column\", outlier_count, round(outlier_count/n::DOUBLE,4) AS outlier_fraction, round(outlier_count/n::DOUBLE,4)>0.02 AS has_outliers FROM t",
)
def _(spark, d):
    return pf.iqr_outliers(feature_table(spark, d), NUMERIC)


@REG.query(
    "c9_date_integrity",
    """SELECT 'l_shipdate' AS "column", strftime(min(l_shipdate),'%Y-%m-%d') AS min_date, strftime(max(l_shipdate),'%Y-%m-%d') AS max_date,
 count(*) FILTER (l_shipdate>DATE '2000-01-01') AS future_count, count(*) FILTER (year(l_shipdate)<1900) AS ancient_count FROM lineitem""",
)
def _(spark, d):
    return pf.date_integrity(readers.load_table(spark, d, "lineitem"), ["l_shipdate"], dt.date(2000, 1, 1))


@REG.query(
    "c10_class_distribution",
    "WITH " + SCORED + """, g AS (SELECT CAST(y AS VARCHAR) AS class, count(*) AS n FROM scored GROUP BY 1)
 SELECT class, n, round(max(n) OVER ()/(min(n) OVER ())::DOUBLE,2) AS imbalance_ratio, round(max(n) OVER ()/(min(n) OVER ())::DOUBLE,2)>3 AS is_imbalanced FROM g""",
)
def _(spark, d):
    return pf.class_distribution(scored_loans(spark, d), "y")


@REG.query(
    "c11_leakage_columns",
    FT + ", z AS (SELECT *, y+price/1e9::DOUBLE AS recov, 2-y*3 AS flip FROM feats), r AS ("
    + union(f"SELECT '{c}' AS \"column\", corr({c},y) AS r FROM z WHERE {c} IS NOT NULL" for c in ("acctbal", "price", "recov", "flip"))
    + ") SELECT \"column\", round(r,4) AS corr FROM r WHERE abs(r)>0.95",
)
def _(spark, d):
    f = feature_table(spark, d).withColumn("recov", F.col("y") + F.col("price") / F.lit(1e9)).withColumn("flip", 2 - F.col("y") * 3)
    return pf.leakage_columns(f, ["acctbal", "price", "recov", "flip"], "y")


@REG.query("c12_preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def _(spark, d):
    return pf.preview(readers.load_table(spark, d, "part"), ["p_partkey"], 10)


@REG.query(
    "c13_categorical_analysis",
    FT + ", v AS (" + union(f"SELECT '{c}' AS \"column\", {c} AS v, count(*) AS n FROM feats WHERE {c} IS NOT NULL GROUP BY 2" for c in CATEGORICAL)
    + "), m AS (" + union(f"SELECT '{c}' AS \"column\", 1-count({c})/count(*)::DOUBLE AS m FROM feats" for c in CATEGORICAL)
    + """) SELECT m."column", round(max(m),6) AS missing_pct, count(*) AS cardinality, count(*)=2 AS is_binary, CASE WHEN count(*)<=8 THEN 'onehot' ELSE 'ordinal' END AS encoding,
 round(max(n)/sum(n)::DOUBLE,6) AS top_freq, CASE WHEN count(*)>1 THEN round((max(n)-min(n))/sum(n)::DOUBLE,6) ELSE 0 END AS freq_imbalance
 FROM m JOIN v ON m."column"=v."column" GROUP BY 1""",
)
def _(spark, d):
    return pf.categorical_analysis(feature_table(spark, d), CATEGORICAL)


@REG.query(
    "c14_numeric_analysis",
    FT + ", t AS (" + union(
        f"SELECT '{c}' AS \"column\", 1-count({c})/count(*)::DOUBLE AS m, skewness({c}) AS s, "
        f"CASE WHEN max(q3)>max(q1) THEN count(*) FILTER ({c}<q1-3*(q3-q1) OR {c}>q3+3*(q3-q1))/count({c})::DOUBLE ELSE 0 END AS f "
        f"FROM feats, (SELECT quantile_cont({c}::DOUBLE,0.25) q1, quantile_cont({c}::DOUBLE,0.75) q3 FROM feats)"
        for c in NUMERIC
    ) + """) SELECT "column", round(m,6) AS missing_pct, round(s,4) AS skewness, round(f,6) AS outlier_frac, f>0.02 AS has_outliers,
 CASE WHEN f>0.02 THEN 'robust' ELSE 'standard' END AS scaler, CASE WHEN f>0.02 OR m>0.2 THEN 'median' ELSE 'mean' END AS safety_net_imputer FROM t""",
)
def _(spark, d):
    return pf.numeric_analysis(feature_table(spark, d), NUMERIC)


_TR = ["price", "acctbal", "ratio", "cube"]


@REG.query(
    "c15_transform_recommendation",
    FT + ", z AS (SELECT price, acctbal, 1000.0::DOUBLE/(1.0::DOUBLE+price/1000.0::DOUBLE) AS ratio, price*price*price/1e12::DOUBLE AS cube FROM feats), t AS ("
    + union(f"SELECT '{c}' AS \"column\", skewness({c}) AS s, skewness(CASE WHEN {c}>0 THEN ln(1+{c}) END) AS p, min({c}) AS lo FROM z" for c in _TR)
    + """) SELECT "column", CASE WHEN abs(s)>=1 AND 1-abs(p)/abs(s)>=0.3 THEN 'log1p' ELSE 'none' END AS transform, round(s,4) AS skew,
 CASE WHEN abs(s)>=1 THEN round(p,4) END AS post_transform_skew,
 CASE WHEN abs(s)<0.5 THEN 'symmetric' WHEN abs(s)<1 THEN 'mild_skew' WHEN 1-abs(p)/abs(s)>=0.3 THEN 'skewed' ELSE 'ineffective' END AS reason,
 abs(s)>=1 AND 1-abs(p)/abs(s)>=0.3 AS default_on FROM t""",
)
def _(spark, d):
    from loanforge.operators.prep import transform_table

    f = feature_table(spark, d).select(
        "price", "acctbal", (F.lit(1000.0) / (F.lit(1.0) + F.col("price") / F.lit(1000.0))).alias("ratio"),
        (F.col("price") * F.col("price") * F.col("price") / F.lit(1e12)).alias("cube"),
    )
    return transform_table(f, _TR)


@REG.query(
    "c16_transformation_review",
    FT + ", z AS (SELECT price, acctbal, exp(price/50000.0::DOUBLE) AS wide, late_count FROM feats), t AS (" + union(
        f"SELECT '{c}' AS feature, skewness({c}) AS s, min({c})<=0 AS neg, quantile_cont({c}::DOUBLE,0.01) AS lo, quantile_cont({c}::DOUBLE,0.99) AS hi FROM z"
        for c in ("price", "acctbal", "wide", "late_count")
    ) + """) SELECT feature, round(s,3) AS skewness, neg AS has_negatives,
 CASE WHEN abs(s)>2 AND NOT neg THEN 'log_or_sqrt' WHEN abs(s)>2 THEN 'binning_or_yeo_johnson' WHEN hi-lo>0 AND hi/greatest(abs(lo),1e-9)>1000 THEN 'woe_or_log_scale' ELSE 'none' END AS recommendation,
 CASE WHEN abs(s)>2 OR (hi-lo>0 AND hi/greatest(abs(lo),1e-9)>1000) THEN 'WARN' ELSE 'OK' END AS status FROM t""",
)
def _(spark, d):
    f = feature_table(spark, d).select("price", "acctbal", F.exp(F.col("price") / F.lit(50000.0)).alias("wide"), "late_count")
    return pf.transformation_review(f, ["price", "acctbal", "wide", "late_count"])
