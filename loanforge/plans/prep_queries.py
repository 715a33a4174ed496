"""Cleaning, split and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanforge.operators import prep, splits
from loanforge.plans.data_queries import union
from loanforge.plans.fixtures import CATEGORICAL, FEATURES, NUMERIC, SCORED, feature_table, scored_loans
from loanforge.plans.registry import Registry
from loanforge.sources.readers import load_table

REG = Registry()
FT = "WITH " + FEATURES
SPLIT = "WITH " + SCORED + """, h AS (SELECT *, ('0x'||substr(md5(CAST(key AS VARCHAR)||'42'),1,13))::BIGINT AS h FROM scored),
 split AS (SELECT *, CASE WHEN rn<=floor(n_cls*0.15::DOUBLE+0.5) THEN 'test' WHEN rn<=2*floor(n_cls*0.15::DOUBLE+0.5) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS rn, count(*) OVER (PARTITION BY y) AS n_cls FROM h))"""


def split_scored(spark, d):
    return splits.stratified_split(scored_loans(spark, d), "y", ["key"])


def e1_input(spark, d):
    li = load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("loan_id"),
        F.col("l_linenumber").alias("dpd_bucket"),
        F.col("l_quantity").alias("amount"),
        F.col("l_linenumber").alias("recovery_rate"),
        F.col("l_returnflag").alias("product"),
        (F.col("l_quantity") > 25).cast("int").alias("default"),
    )


@REG.query(
    "e1_cleaning_report",
    """WITH g AS (SELECT l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1,2)
 SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n)-count(*) AS BIGINT) AS duplicates_removed,
 'loan_id' AS id_dropped, 'dpd_bucket' AS late_origin_dropped, 'recovery_rate' AS post_default_dropped FROM g""",
)
def _(spark, d):
    return splits.cleaning_report(e1_input(spark, d), ["loan_id"], "default")


@REG.query(
    "e1_model_frame",
    "SELECT DISTINCT l_quantity AS amount, l_returnflag AS product, CASE WHEN l_quantity>25 THEN 1 ELSE 0 END AS \"default\" FROM lineitem",
)
def _(spark, d):
    return splits.finalize_xy(e1_input(spark, d), ["loan_id"], "default")[0]


@REG.query("e2_stratified_split", SPLIT + " SELECT key, y, split FROM split")
def _(spark, d):
    return split_scored(spark, d).select("key", "y", "split")


@REG.query(
    "e3_split_stats",
    SPLIT + """, g AS (SELECT split, CAST(y AS VARCHAR) AS class, count(*) AS n FROM split GROUP BY 1,2)
 SELECT split, class, n, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_n, round(sum(n) OVER (PARTITION BY split)/(sum(n) OVER ())::DOUBLE,6) AS split_pct,
 round(n/(sum(n) OVER (PARTITION BY split))::DOUBLE,6) AS class_share FROM g""",
)
def _(spark, d):
    return splits.split_stats(split_scored(spark, d), "y")


_OOT = "WITH " + SCORED + """, n AS (SELECT count(ts) AS n FROM scored), w AS (SELECT CASE WHEN round_even(n*0.2::DOUBLE,0)<greatest(round_even(n*0.1::DOUBLE,0),100)
  THEN least(greatest(round_even(n*0.1::DOUBLE,0),100), n//2) ELSE least(greatest(round_even(n*0.15::DOUBLE,0),greatest(round_even(n*0.1::DOUBLE,0),100)),round_even(n*0.2::DOUBLE,0)) END AS k, n FROM n),
 c AS (SELECT min(ts) AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS rn FROM scored), w WHERE rn<=k)"""


@REG.query(
    "e4_oot_report",
    _OOT + """ SELECT count(*) FILTER (ts>=cut) AS oot_n, count(*) FILTER (ts<cut OR ts IS NULL) AS dev_n, count(ts) AS n_dated_rows, strftime(max(cut),'%Y-%m-%d') AS cutoff_date FROM scored, c""",
)
def _(spark, d):
    return splits.oot_report(scored_loans(spark, d), "ts")


@REG.query("e4_oot_split", _OOT + " SELECT key, CASE WHEN ts>=cut THEN 'oot' ELSE 'development' END AS part FROM scored, c")
def _(spark, d):
    return splits.oot_split(scored_loans(spark, d), "ts").select("key", "part")


@REG.query(
    "e5_class_weights",
    "WITH " + SCORED + ", g AS (SELECT y, count(*) AS n FROM scored GROUP BY y) SELECT y, n, round((sum(n) OVER ())::DOUBLE/(count(*) OVER ()*n),6) AS weight FROM g",
)
def _(spark, d):
    return splits.class_weights(scored_loans(spark, d), "y")


@REG.query(
    "e6_capped_sample",
    "WITH " + SCORED + " SELECT key, y, p FROM scored QUALIFY row_number() OVER (ORDER BY CAST('0x' || substring(md5(CAST(key AS VARCHAR) || '42'),1,13) AS BIGINT)) <= 5000",
)
def _(spark, d):
    return splits.capped_sample(scored_loans(spark, d), ["key"], 5000).select("key", "y", "p")


@REG.query(
    "f1_missing_treatment",
    FT + ", t AS (" + union(
        [
            f"""SELECT '{c}' AS "column", 1-count({c})/count(*)::DOUBLE AS m, false AS cat, count(DISTINCT {c}) AS u,
 min({c})>=0 AND count(*) FILTER ({c}<>round({c}))=0 AS cnt, skewness({c}) AS s,
 count(*) FILTER ({c}=0) AS z, (SELECT max(k) FROM (SELECT count(*) AS k FROM feats WHERE {c} IS NOT NULL GROUP BY {c})) AS top FROM feats"""
            for c in NUMERIC
        ]
        + [f"SELECT '{c}', 1-count({c})/count(*)::DOUBLE, true, 0, false, 0, 0, 0 FROM feats" for c in CATEGORICAL]
    ) + """) SELECT "column", CASE WHEN m>0.4 THEN 'review_flag' WHEN cat THEN 'unknown_category' WHEN u=2 THEN 'zero_fill'
  WHEN cnt AND z>0 AND z=top AND s>1 THEN 'zero_fill' ELSE 'statistical' END AS treatment, round(m,4) AS missing_pct FROM t WHERE m>0""",
)
def _(spark, d):
    return prep.treatment_table(feature_table(spark, d), NUMERIC, CATEGORICAL)


_F3 = ["price", "price_half", "has_card"]


@REG.query(
    "f3_imputation_strategy",
    FT + ", m AS (SELECT 1-count(acctbal)/count(*)::DOUBLE AS miss, count(*) AS n FROM feats), r AS (" + union(
        f"SELECT abs(corr(acctbal,{c})) AS r FROM feats WHERE acctbal IS NOT NULL AND {c} IS NOT NULL" for c in ["price", "price_half", "sparse", "has_card"]
    ) + """), x AS (SELECT round(max(r),4) AS r FROM r) SELECT 'acctbal' AS "column", r AS max_corr,
 CASE WHEN r>=0.3 THEN CASE WHEN miss>0.15 THEN 'mice' ELSE 'knn' END ELSE 'median' END AS method, CASE WHEN r>=0.3 THEN 1 ELSE 0 END AS n_strong,
 round(miss,4) AS missing_pct, n AS n_rows FROM x, m""",
)
def _(spark, d):
    return prep.strategy_table(feature_table(spark, d), ["acctbal"], ["acctbal", "price", "price_half", "sparse", "has_card"])


@REG.query(
    "f4_constant_fills",
    FT + " SELECT key, coalesce(prio,'Unknown') AS prio, coalesce(has_card,0) AS has_card, coalesce(late_count,0) AS late_count FROM feats",
)
def _(spark, d):
    f = feature_table(spark, d)
    return prep.constant_fills(f, {"prio": "unknown_category", "has_card": "zero_fill", "late_count": "zero_fill"}).select(
        "key", "prio", "has_card", "late_count"
    )


@REG.query(
    "f5_median_imputation",
    FT + ", m AS (SELECT quantile_cont(acctbal,0.5) AS a, quantile_cont(sparse,0.5) AS s FROM feats) SELECT key, round(coalesce(acctbal,a),6) AS acctbal, round(coalesce(sparse,s),6) AS sparse FROM feats, m",
)
def _(spark, d):
    f = feature_table(spark, d)
    out = prep.fill_constants(f, prep.fit_medians(f, ["acctbal", "sparse"]))
    return out.select("key", F.round("acctbal", 6).alias("acctbal"), F.round("sparse", 6).alias("sparse"))


@REG.query(
    "f6_knn_imputation",
    FT + """, h AS (SELECT key, y, acctbal, price, sparse, ('0x'||substr(md5(CAST(key AS VARCHAR)||'42'),1,13))::BIGINT AS h FROM feats),
 cut AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS rn, count(*) OVER (PARTITION BY y) AS nc FROM h),
 tr AS (SELECT acctbal::DOUBLE AS a, price::DOUBLE AS p, sparse::DOUBLE AS s FROM cut WHERE rn>2*floor(nc*0.15::DOUBLE+0.5)),
 c AS (SELECT avg(a) AS ma, stddev_pop(a) AS da, avg(p) AS mp, stddev_pop(p) AS dp, avg(s) AS ms, stddev_pop(s) AS ds FROM tr),
 q AS (SELECT key, (price-mp)/dp AS zp, (sparse-ms)/ds AS zs FROM h, c WHERE acctbal IS NULL),
 dn AS (SELECT (a-ma)/da AS za, (p-mp)/dp AS zp, (s-ms)/ds AS zs FROM tr, c WHERE a IS NOT NULL),
 pr AS (SELECT q.key, za, (coalesce(pow(q.zp-dn.zp,2),0)+coalesce(pow(q.zs-dn.zs,2),0))*3.0/((q.zp-dn.zp IS NOT NULL)::INT+(q.zs-dn.zs IS NOT NULL)::INT) AS d FROM q, dn),
 nb AS (SELECT key, za, row_number() OVER (PARTITION BY key ORDER BY d, za) AS rn FROM pr WHERE d IS NOT NULL),
 es AS (SELECT key, avg(za) AS z FROM nb WHERE rn<=5 GROUP BY key)
 SELECT h.key, round(coalesce(acctbal, coalesce(z,0)*da+ma),4) AS acctbal, price, sparse FROM h CROSS JOIN c LEFT JOIN es ON es.key=h.key""",
)
def _(spark, d):
    f = splits.stratified_split(feature_table(spark, d), "y", ["key"]).select("key", "split", "acctbal", "price", "sparse")
    plan = prep.fit_knn(f.where("split = 'train'"), ["acctbal", "price", "sparse"], ["acctbal"])
    return prep.apply_knn(f, plan).select("key", F.round("acctbal", 4).alias("acctbal"), "price", "sparse")


@REG.query("f7_imputation_plan")
def _(spark, d):
    f = feature_table(spark, d)
    plan = prep.fit_imputation(f, NUMERIC, CATEGORICAL)
    return prep.apply_imputation(f, plan).select("key", *NUMERIC, *CATEGORICAL)


def _chained_sql(rounds: int, alpha: str = "0.001::DOUBLE") -> str:
    """Rounds of two-predictor ridge regressions on standardised columns, each target in turn, by Cramer's rule."""
    out = [
        "c AS MATERIALIZED (SELECT avg(acctbal) ma, stddev_pop(acctbal) da, avg(price) mp, stddev_pop(price) dp, avg(sparse) ms, stddev_pop(sparse) ds FROM feats)",
        "s0 AS MATERIALIZED (SELECT key, acctbal IS NOT NULL oa, sparse IS NOT NULL os, coalesce((acctbal-ma)/da,0) a, (price-mp)/dp p, coalesce((sparse-ms)/ds,0) s FROM feats, c)",
    ]
    for i in range(2 * rounds):
        t, v = ("a", "s") if i % 2 == 0 else ("s", "a")
        out += [
            f"m{i} AS MATERIALIZED (SELECT count(*)+{alpha} n, sum(p) u, sum({v}) v, sum(p*p)+{alpha} uu, sum(p*{v}) uv, sum({v}*{v})+{alpha} vv, sum({t}) t, sum(p*{t}) ut, sum({v}*{t}) vt FROM s{i} WHERE o{t})",
            f"""b{i} AS MATERIALIZED (SELECT (t*(uu*vv-uv*uv)-u*(ut*vv-uv*vt)+v*(ut*uv-uu*vt))/d b0, (n*(ut*vv-vt*uv)-t*(u*vv-uv*v)+v*(u*vt-ut*v))/d b1,
 (n*(uu*vt-uv*ut)-u*(u*vt-ut*v)+t*(u*uv-uu*v))/d b2 FROM (SELECT *, n*(uu*vv-uv*uv)-u*(u*vv-uv*v)+v*(u*uv-uu*v) d FROM m{i}))""",
            f"s{i + 1} AS MATERIALIZED (SELECT key, oa, os, {'CASE WHEN oa THEN a ELSE b0+b1*p+b2*s END a, p, s' if t == 'a' else 'a, p, CASE WHEN os THEN s ELSE b0+b1*p+b2*a END s'} FROM s{i}, b{i})",
        ]
    return FT + ", " + ",\n ".join(out) + f" SELECT key, round(a*da+ma,2) AS acctbal, price, round(s*ds+ms,2) AS sparse FROM s{2 * rounds} JOIN feats USING (key), c"


@REG.query("f7_chained_imputation", _chained_sql(10))
def _(spark, d):
    f = feature_table(spark, d).select("key", "acctbal", "price", "sparse")
    plan = prep.fit_chained(f, ["acctbal", "price", "sparse"], ["acctbal", "sparse"], rounds=10, tolerance=0.0)
    return prep.apply_chained(f, plan).withColumns({c: F.round(c, 2) for c in ("acctbal", "sparse")})


@REG.query(
    "f8_preprocessing_report",
    FT + ", n AS (" + union(
        f"SELECT '{c}' AS \"column\", CASE WHEN max(q3)>max(q1) THEN count(*) FILTER ({c}<q1-3*(q3-q1) OR {c}>q3+3*(q3-q1))/count({c})::DOUBLE ELSE 0 END AS f, 1-count({c})/count(*)::DOUBLE AS m "
        f"FROM feats, (SELECT quantile_cont({c}::DOUBLE,0.25) q1, quantile_cont({c}::DOUBLE,0.75) q3 FROM feats)"
        for c in ("acctbal", "price", "sparse")
    ) + "), k AS (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, 1-count({c})/count(*)::DOUBLE AS m FROM feats" for c in CATEGORICAL)
    + """) SELECT "column", 'numeric' AS type, CASE WHEN f>0.02 THEN 'robust' ELSE 'standard' END AS action, CASE WHEN f>0.02 OR m>0.2 THEN 'median' ELSE 'mean' END AS safety_net_imputer,
 'none' AS suggested, CASE WHEN m>0.4 THEN 'review_flag' WHEN m>0 THEN 'statistical' END AS treatment FROM n
 UNION ALL SELECT "column", 'categorical', CASE WHEN u<=8 THEN 'onehot' ELSE 'ordinal' END, NULL, NULL, CASE WHEN m>0 THEN 'unknown_category' END FROM k
 UNION ALL SELECT 'opted_in','boolean','cast_0_1',NULL,NULL,NULL UNION ALL SELECT 'ts','datetime','date_parts',NULL,NULL,NULL""",
)
def _(spark, d):
    return prep.preprocessing_report(feature_table(spark, d), ["acctbal", "price", "sparse"], CATEGORICAL, ["opted_in"], ["ts"])


def _quick_iv(cols) -> str:
    parts = []
    for c in cols:
        if c in NUMERIC:
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST(len(list_filter(list_distinct(q), lambda x: x < {c})) AS VARCHAR) AS b, y FROM feats, "
                f"(SELECT quantile_cont({c}::DOUBLE,[0.2,0.4,0.6,0.8]) AS q FROM feats) WHERE {c} IS NOT NULL"
            )
        else:
            parts.append(
                f"SELECT '{c}', CASE WHEN {c} IN (SELECT {c} FROM feats WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 5) THEN {c} ELSE 'Other' END, y FROM feats WHERE {c} IS NOT NULL"
            )
    return ", lb AS (" + union(parts) + """), cl AS (SELECT "column", b, sum(1-y)+0.5::DOUBLE AS g, sum(y)+0.5::DOUBLE AS d, count(*) AS n FROM lb GROUP BY 1,2),
 qi AS (SELECT "column", sum((d/td-g/tg)*ln((d/td)/(g/tg))) AS iv, sum(n) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY "column") AS tg, sum(d) OVER (PARTITION BY "column") AS td FROM cl) GROUP BY 1)"""


_QI = ["acctbal", "price", "sparse", "prio", "nation"]


@REG.query("f10_quick_iv", FT + _quick_iv(_QI) + " SELECT \"column\", round(iv,4) AS iv, CAST(n AS BIGINT) AS rows_available FROM qi")
def _(spark, d):
    return prep.quick_iv(feature_table(spark, d), ["acctbal", "price", "sparse"], ["prio", "nation"])


_DI = ["acctbal", "sparse", "price"]


@REG.query(
    "f9_drop_impact",
    FT + _quick_iv(_DI) + ", r AS (" + union(
        f"SELECT '{a}' AS \"column\", '{b}' AS o, corr({a},{b}) AS r FROM feats WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a in _DI for b in _DI + ["price_half"] if a != b
    ) + """), bp AS (SELECT "column", arg_max(o, abs(r)) AS o, arg_max(r, abs(r)) AS r FROM r GROUP BY 1), t AS (SELECT count(*) AS n FROM feats)
 SELECT qi."column", round(iv,4) AS iv, CASE WHEN iv<0.02 THEN 'Not useful' WHEN iv<0.1 THEN 'Weak' WHEN iv<0.3 THEN 'Medium' WHEN iv<0.5 THEN 'Strong' ELSE 'Suspiciously high (check for leakage)' END AS iv_label,
 CASE WHEN abs(r)>=0.6 THEN o END AS redundant_col, CASE WHEN abs(r)>=0.6 THEN round(r,3) END AS redundant_corr, CAST(qi.n AS BIGINT) AS rows_available,
 round(qi.n/t.n::DOUBLE,6) AS rows_available_pct, CASE WHEN iv<0.1 THEN 'safe' WHEN iv<0.3 THEN 'caution' ELSE 'risk' END AS verdict_tone FROM qi JOIN bp ON qi."column"=bp."column", t""",
)
def _(spark, d):
    return prep.drop_impact(feature_table(spark, d), _DI, _DI + ["price_half"])


def _pair(cols, q):
    return ", ".join(f"quantile_cont({c}::DOUBLE,{a}) AS {c}_{n}" for c in cols for n, a in q)


@REG.query(
    "f11_winsorize",
    FT + f", q AS (SELECT {_pair(['acctbal', 'price'], [('lo', 0.01), ('hi', 0.99)])} FROM feats) "
    "SELECT key, CASE WHEN acctbal IS NOT NULL THEN round(least(greatest(acctbal,acctbal_lo),acctbal_hi),4) END AS acctbal, round(least(greatest(price,price_lo),price_hi),4) AS price FROM feats, q",
)
def _(spark, d):
    f = feature_table(spark, d)
    out = prep.winsorize(f, prep.fit_winsor(f, ["acctbal", "price"]))
    return out.select("key", F.round("acctbal", 4).alias("acctbal"), F.round("price", 4).alias("price"))


@REG.query(
    "f12_standard_scale",
    FT + ", s AS (SELECT avg(price) m, stddev_pop(price) sd, avg(acctbal) m2, stddev_pop(acctbal) sd2 FROM feats) SELECT key, round((price-m)/sd,6) AS price, round((acctbal-m2)/sd2,6) AS acctbal FROM feats, s",
)
def _(spark, d):
    f = feature_table(spark, d)
    out = prep.scale(f, prep.fit_standard(f, ["price", "acctbal"]))
    return out.select("key", F.round("price", 6).alias("price"), F.round("acctbal", 6).alias("acctbal"))


@REG.query(
    "f13_robust_scale",
    FT + ", s AS (SELECT quantile_cont(price,0.5) m, quantile_cont(price,0.75)-quantile_cont(price,0.25) w FROM feats) SELECT key, round((price-m)/w,6) AS price FROM feats, s",
)
def _(spark, d):
    f = feature_table(spark, d)
    return prep.scale(f, prep.fit_robust(f, ["price"])).select("key", F.round("price", 6).alias("price"))


@REG.query("f14_log1p", FT + " SELECT key, round(ln(1+greatest(coalesce(acctbal,0),0)),6) AS acctbal_log FROM feats")
def _(spark, d):
    return feature_table(spark, d).select("key", F.round(prep.log1p_clipped(F.col("acctbal")), 6).alias("acctbal_log"))


def _power_sql(cols, steps: int = 12) -> str:
    """Newton steps for the power of each column, then the standardised transform."""
    out, picked = [], []
    for c in cols:
        out.append(f"x_{c} AS MATERIALIZED (SELECT key, {c}::DOUBLE x, ln(1+abs({c}::DOUBLE)) u FROM feats)")
        out.append(f"l_{c}_0 AS MATERIALIZED (SELECT 1.0::DOUBLE l)")
        for i in range(steps):
            out.append(
                f"""l_{c}_{i + 1} AS MATERIALIZED (SELECT l-(j-n*a/v)/(-n*((b+k)/v-2*pow(a/v,2))) l FROM (
 SELECT any_value(l) l, count(x) n, sum(sign(x)*u) j, var_pop(p) v, covar_pop(p,q) a, var_pop(q) b, covar_pop(p,r) k FROM (
 SELECT x, u, l, CASE WHEN x>=0 THEN (e-1)/m ELSE -(e-1)/m END p, (e*(u*m-1)+1)/(m*m) q, CASE WHEN x>=0 THEN 1 ELSE -1 END*(e*(u*u*m*m-2*u*m+2)-2)/(m*m*m) r FROM (
 SELECT *, exp(u*m) e FROM (SELECT *, CASE WHEN x>=0 THEN l ELSE 2-l END m FROM x_{c}, l_{c}_{i} WHERE x IS NOT NULL)))))"""
            )
        out.append(f"y_{c} AS MATERIALIZED (SELECT key, CASE WHEN x>=0 THEN (exp(l*u)-1)/l ELSE -(exp((2-l)*u)-1)/(2-l) END y FROM x_{c}, l_{c}_{steps})")
        picked.append(f"round((y_{c}.y-(SELECT avg(y) FROM y_{c}))/(SELECT stddev_pop(y) FROM y_{c}),5) AS {c}")
    return FT + ", " + ",\n ".join(out) + f" SELECT feats.key, {', '.join(picked)} FROM feats " + " ".join(f"JOIN y_{c} ON y_{c}.key=feats.key" for c in cols)


@REG.query("f15_yeo_johnson", _power_sql(["acctbal", "late_count"]))
def _(spark, d):
    cols = ["acctbal", "late_count"]
    f = feature_table(spark, d).select("key", *cols)
    lam = prep.fit_yeo_johnson_all(f, cols)
    staged = f.select("key", *[prep.yeo_johnson(F.col(c).cast("double"), lam[c]).alias(c) for c in cols])
    return prep.scale(staged, prep.fit_standard(staged, cols)).select("key", *[F.round(c, 5).alias(c) for c in cols])


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@REG.query("f16_one_hot", None)
def _(spark, d):
    f = feature_table(spark, d)
    cats = prep.fit_categories(f, ["segment", "status"])
    out = prep.one_hot(f.select("key", "segment", "status"), cats)
    names = [c for c in out.columns if c not in ("key", "segment", "status")]
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names]))
    return out.select(items.alias("s")).groupBy("s.column").agg(F.sum("s.v").cast("bigint").alias("n_set"), F.count(F.lit(1)).alias("n"))


REG.sql["f16_one_hot"] = FT + union(
    [" SELECT 'segment_'||segment AS \"column\", count(*) AS n_set, (SELECT count(*) FROM feats) AS n FROM feats GROUP BY segment",
     "SELECT 'status_'||status, count(*), (SELECT count(*) FROM feats) FROM feats GROUP BY status"]
)


@REG.query(
    "f17_ordinal",
    FT + """, c AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT coalesce(nation,'Unknown') AS v FROM feats)),
 p AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT coalesce(prio,'Unknown') AS v FROM feats))
 SELECT key, c.i AS nation_ord, p.i AS prio_ord FROM feats JOIN c ON c.v=coalesce(nation,'Unknown') JOIN p ON p.v=coalesce(prio,'Unknown')""",
)
def _(spark, d):
    f = feature_table(spark, d)
    return prep.ordinal(f, prep.fit_categories(f, ["nation", "prio"])).select("key", "nation_ord", "prio_ord")


@REG.query(
    "f18_boolean_to_number",
    """SELECT l_orderkey, l_linenumber, CASE lower(trim(w)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 WHEN 't' THEN 1.0 ELSE coalesce(TRY_CAST(w AS DOUBLE),0) END AS flag
 FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber%5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'NO' WHEN 2 THEN '0.5' WHEN 3 THEN 'T' ELSE l_returnflag||'?' END AS w FROM lineitem)""",
)
def _(spark, d):
    m = F.col("l_linenumber") % 5
    w = F.when(m == 0, " Yes").when(m == 1, "NO").when(m == 2, "0.5").when(m == 3, "T").otherwise(F.concat("l_returnflag", F.lit("?")))
    return load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", prep.boolean_to_number(w).alias("flag"))


@REG.query(
    "f19_date_parts",
    """SELECT l_orderkey, l_linenumber, year(s) AS ship_year, month(s) AS ship_month, day(s) AS ship_day, isodow(s)-1 AS ship_dayofweek, CASE WHEN isodow(s)>=6 THEN 1 ELSE 0 END AS ship_is_weekend, quarter(s) AS ship_quarter
 FROM (SELECT *, l_shipdate AS s FROM lineitem)""",
)
def _(spark, d):
    from loanforge.functions.dates import date_parts

    return load_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *[v.alias(k) for k, v in date_parts(F.col("l_shipdate"), "ship").items()]
    )


@REG.query("f20_routed_preparation")
def _(spark, d):
    f = splits.stratified_split(feature_table(spark, d), "y", ["key"])
    plan = prep.fit_prep(f.where("split = 'train'"), NUMERIC, CATEGORICAL, ["opted_in"], ["ts"])
    return prep.apply_prep(f, plan, ["key", "y", "split"])
