"""Binning, weight of evidence, interaction and feature-plan queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from loanforge.operators import features as fe
from loanforge.operators import splits
from loanforge.operators.evaluate import univariate_gini
from loanforge.operators.models import cached
from loanforge.operators.profile import high_correlation
from loanforge.plans.data_queries import corr_sql, union
from loanforge.plans.fixtures import CATEGORICAL, FEATURES, NUMERIC, feature_table
from loanforge.plans.registry import Registry

REG = Registry()
FT = "WITH " + FEATURES
QN = ["acctbal", "price", "sparse", "price_half"]
VN = ["late_count", "has_card"]


def bucket_sql(c: str, table: str = "feats") -> str:
    """Rows (feature, bucket, y) of one column under the train buckets of the same table."""
    if c in QN or c not in VN + CATEGORICAL:
        return (
            f"SELECT '{c}' AS feature, CAST(CASE WHEN {c} IS NULL THEN -2 ELSE len(list_filter(q, lambda x: x < {c})) END AS VARCHAR) AS bucket, y "
            f"FROM {table}, (SELECT list_slice(list_sort(list_distinct(quantile_cont({c}::DOUBLE,[0,0.2,0.4,0.6,0.8,1]))),2,-2) AS q FROM {table})"
        )
    if c in VN:
        return (
            f"SELECT '{c}' AS feature, CAST(coalesce(i,-2) AS VARCHAR) AS bucket, y FROM {table} LEFT JOIN "
            f"(SELECT v, row_number() OVER (ORDER BY v)-1 AS i FROM (SELECT DISTINCT {c} AS v FROM {table} WHERE {c} IS NOT NULL)) ON v={c}"
        )
    return f"SELECT '{c}' AS feature, coalesce({c},'__MISSING__') AS bucket, y FROM {table}"


WOE = """, cells AS (SELECT feature, bucket, CAST(sum(1-y) AS BIGINT) AS good, CAST(sum(y) AS BIGINT) AS bad FROM lb GROUP BY 1,2),
 sh AS (SELECT *, (good+0.5::DOUBLE)/(sum(good) OVER w+0.5::DOUBLE*count(*) OVER w) AS g, (bad+0.5::DOUBLE)/(sum(bad) OVER w+0.5::DOUBLE*count(*) OVER w) AS b FROM cells WINDOW w AS (PARTITION BY feature)),
 woe AS (SELECT feature, bucket, good, bad, ln(g/b) AS woe, (g-b)*ln(g/b) AS iv_part FROM sh),
 iv AS (SELECT feature, greatest(sum(iv_part),0) AS iv, count(*) AS n_buckets FROM woe GROUP BY feature)"""


def woe_sql(cols, table="feats") -> str:
    return ", lb AS (" + union(bucket_sql(c, table) for c in cols) + ")" + WOE


@REG.query(
    "g1_bucketer_fit",
    FT + " , e AS (" + union(
        f"SELECT '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}::DOUBLE,[0,0.2,0.4,0.6,0.8,1]))) AS q FROM feats" for c in QN
    ) + "), v AS (" + union(f"SELECT '{c}' AS feature, list_sort(list(DISTINCT {c}::DOUBLE) FILTER ({c} IS NOT NULL)) AS q FROM feats" for c in VN)
    + """), k AS (SELECT 'prio' AS feature, list_sort(list(DISTINCT coalesce(prio,'__MISSING__'))) AS q FROM feats)
 SELECT feature, 'edge' AS kind, CAST(unnest(range(len(q))) AS INTEGER) AS position, round(unnest(q),6) AS edge, NULL AS category FROM e
 UNION ALL SELECT feature, 'value', CAST(unnest(range(len(q))) AS INTEGER), round(unnest(q),6), NULL FROM v
 UNION ALL SELECT feature, 'category', CAST(unnest(range(len(q))) AS INTEGER), NULL, unnest(q) FROM k""",
)
def _(spark, d):
    f = feature_table(spark, d)
    return fe.bucketer_table(f, fe.fit_bucketers(f, QN + VN, ["prio"]))


@REG.query(
    "g2_bucketer_apply",
    FT + ", q AS (SELECT quantile_cont(acctbal,[0.2,0.4,0.6,0.8]) AS a, quantile_cont(sparse,[0.2,0.4,0.6,0.8]) AS s FROM feats) SELECT key, "
    "CAST(CASE WHEN acctbal IS NULL THEN -2 ELSE len(list_filter(a, lambda x: x < acctbal)) END AS INTEGER) AS acctbal_bin, "
    "CAST(CASE WHEN sparse IS NULL THEN -2 ELSE len(list_filter(s, lambda x: x < sparse)) END AS INTEGER) AS sparse_bin, "
    "CASE WHEN has_card IS NULL THEN -2 ELSE has_card END AS has_card_bin FROM feats, q",
)
def _(spark, d):
    f = feature_table(spark, d)
    specs = fe.fit_bucketers(f, ["acctbal", "sparse", "has_card"], [])
    return fe.apply_bucketers(f, specs).select("key", "acctbal_bin", "sparse_bin", "has_card_bin")


@REG.query(
    "g3_woe_map",
    FT + woe_sql(["acctbal", "late_count", "prio"]) + " SELECT feature, bucket, good, bad, round(woe,6) AS woe, round(iv_part,6) AS iv_part FROM woe",
)
def _(spark, d):
    f = feature_table(spark, d)
    specs = fe.fit_numeric_bucketers(f, ["acctbal", "late_count"])
    buckets = {c: s.code(F.col(c)) for c, s in specs.items()}
    buckets["prio"] = F.coalesce(F.col("prio"), F.lit(fe.MISSING_LABEL))
    t = fe.woe_table(fe.woe_cells(f, buckets))
    return t.select("feature", "bucket", "good", "bad", F.round("woe", 6).alias("woe"), F.round("iv_part", 6).alias("iv_part"))


@REG.query("g4_information_value", FT + woe_sql(NUMERIC + CATEGORICAL) + " SELECT feature, round(iv,5) AS iv, n_buckets FROM iv")
def _(spark, d):
    return fe.information_value(feature_table(spark, d), NUMERIC, CATEGORICAL)


@REG.query(
    "g4_document_quality_iv",
    """WITH feats AS (SELECT quality AS y, n_chars, lang, source FROM documents JOIN labels ON documents.doc_id=labels.doc_id), lb AS (
 SELECT 'n_chars' AS feature, CAST(len(list_filter(q, lambda x: x < n_chars)) AS VARCHAR) AS bucket, y FROM feats, (SELECT list_distinct(quantile_cont(n_chars::DOUBLE,[0.2,0.4,0.6,0.8])) AS q FROM feats)
 UNION ALL SELECT 'lang', coalesce(lang,'__MISSING__'), y FROM feats UNION ALL SELECT 'source', coalesce(source,'__MISSING__'), y FROM feats)""" + WOE
    + " SELECT feature, round(iv,5) AS iv, n_buckets FROM iv",
)
def _(spark, d):
    from loanforge.sources.readers import load_table

    t = load_table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    f = t.join(load_table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return fe.information_value(f, ["n_chars"], ["lang", "source"])


@REG.query(
    "g5_information_value_unsmoothed",
    FT + ", lb AS (" + union(
        f"SELECT '{c}' AS feature, len(list_filter(q, lambda x: x < {c})) AS bucket, y FROM feats, (SELECT list_distinct(quantile_cont({c}::DOUBLE,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM feats) WHERE {c} IS NOT NULL"
        for c in QN
    ) + """), t AS (SELECT sum(y)::DOUBLE AS e, sum(1-y)::DOUBLE AS n FROM feats), c AS (SELECT feature, bucket, sum(y) AS bad, sum(1-y) AS good FROM lb GROUP BY 1,2),
 x AS (SELECT feature, bad/e AS de, good/n AS dn FROM c, t WHERE bad>0 AND good>0)
 SELECT feature, round(sum((de-dn)*ln(de/dn)),5) AS iv, count(*) AS bins, sum((de-dn)*ln(de/dn))<0.02 AS low_iv FROM x GROUP BY 1""",
)
def _(spark, d):
    return fe.information_value_unsmoothed(feature_table(spark, d), QN)


@REG.query(
    "g6_binned_mutual_information",
    FT + woe_sql(QN + VN) + """, r AS (SELECT feature, good AS c, good+bad AS m, sum(good) OVER w AS t, sum(good+bad) OVER w AS n FROM cells WINDOW w AS (PARTITION BY feature)
 UNION ALL SELECT feature, bad, good+bad, sum(bad) OVER w, sum(good+bad) OVER w FROM cells WINDOW w AS (PARTITION BY feature))
 SELECT feature, round(sum(CASE WHEN c>0 THEN c/n::DOUBLE*ln(c*n::DOUBLE/(m*t::DOUBLE)) ELSE 0 END),5) AS mi FROM r GROUP BY 1""",
)
def _(spark, d):
    return fe.binned_mutual_information(feature_table(spark, d), QN + VN)


_FILL = ", fl AS (SELECT y, " + ", ".join(
    f"coalesce({c}::DOUBLE,(SELECT quantile_cont({c}::DOUBLE,0.5) FROM feats)) AS {c}" for c in NUMERIC
) + " FROM feats)"


@REG.query(
    "g7_multicollinearity_pairs",
    FT + _FILL + ", r AS (" + corr_sql(NUMERIC, "fl") + ") SELECT a AS feature_1, b AS feature_2, round(r,4) AS correlation FROM r WHERE abs(r)>=0.9",
)
def _(spark, d):
    return fe.multicollinearity_pairs(feature_table(spark, d), NUMERIC)


@REG.query("g8_vif")
def _(spark, d):
    return fe.vif_table(feature_table(spark, d), ["acctbal", "price", "sparse", "late_count", "has_card"])


@REG.query("g9_high_correlation", FT + f", r AS ({corr_sql(NUMERIC)}) SELECT a, b, round(r,4) AS corr FROM r WHERE abs(r)>0.75")
def _(spark, d):
    return high_correlation(feature_table(spark, d), NUMERIC, 0.75)


def gini_sql(cols, table) -> str:
    parts = union(f"SELECT '{c}' AS feature, {c}::DOUBLE AS s, y FROM {table}" for c in cols)
    return f""", gl AS ({parts}), gg AS (SELECT feature, s, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM gl GROUP BY 1,2),
 gc AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(pos) OVER (PARTITION BY feature) AS tp, sum(neg) OVER (PARTITION BY feature) AS tn FROM gg),
 gi AS (SELECT feature, abs(2*sum(neg*(cp-pos*0.5::DOUBLE))/max(tp*tn)-1) AS gini FROM gc GROUP BY 1)"""


@REG.query("g10_univariate_gini", FT + _FILL + gini_sql(NUMERIC, "fl") + " SELECT feature, round(gini,4) AS gini FROM gi")
def _(spark, d):
    return univariate_gini(feature_table(spark, d), NUMERIC)


@REG.query(
    "g11_interaction_columns",
    FT + woe_sql(["segment", "status"]) + """ SELECT f.key, round(coalesce(acctbal,0)*price,4) AS acctbal_x_price, round(price*ws.woe,4) AS price_x_segment_WOE, round(ws.woe*wt.woe,6) AS segment_WOE_x_status_WOE
 FROM feats f JOIN woe ws ON ws.feature='segment' AND ws.bucket=f.segment JOIN woe wt ON wt.feature='status' AND wt.bucket=f.status""",
)
def _(spark, d):
    f = feature_table(spark, d)
    woe, _ = fe.fit_woe(f, [], ["segment", "status"])
    i = [fe.Interaction("acctbal_x_price", "acctbal", "price", "numeric_numeric"),
         fe.Interaction("price_x_segment_WOE", "price", "segment", "numeric_woe"),
         fe.Interaction("segment_WOE_x_status_WOE", "segment", "status", "woe_woe")]
    return f.select("key", *[F.round(fe.interaction_column(x, woe), n).alias(x.name) for x, n in zip(i, (4, 4, 6))])


_PAIRS = list(combinations(["acctbal", "price", "late_count"], 2))
_IX = ", ix AS (SELECT y, " + ", ".join(f"coalesce({a},0)*coalesce({b},0) AS {a}_x_{b}" for a, b in _PAIRS) + " FROM feats)"
_IXN = [f"{a}_x_{b}" for a, b in _PAIRS]


def _ix_buckets(c: str) -> str:
    # quantile buckets on more than five distinct values; same rule as bucket_sql
    return bucket_sql(c, "ix")


@REG.query(
    "g13_interaction_scores",
    FT + _IX + ", lb AS (" + union(_ix_buckets(c) for c in _IXN) + ")" + WOE + gini_sql(_IXN, "ix")
    + " SELECT iv.feature, round(iv,5) AS iv, round(gini,4) AS gini FROM iv JOIN gi ON iv.feature=gi.feature",
)
def _(spark, d):
    f = feature_table(spark, d)
    cands = fe.numeric_pairs(["acctbal", "price", "late_count"], [], {}, [])
    return fe.score_interactions(f, cands, fe.WoeMaps({}, {}))


@REG.query("g14_redundancy_filter")
def _(spark, d):
    with cached(feature_table(spark, d).select("y", *NUMERIC, *CATEGORICAL)) as f:
        woe, iv = fe.fit_woe(f, NUMERIC, CATEGORICAL)
        cands = fe.interaction_candidates(NUMERIC, CATEGORICAL, iv, {c: len(woe.specs[c].categories) for c in CATEGORICAL})
        kept = fe.select_interactions(f, cands, woe, NUMERIC, min_iv=0.0)
    rows = [(i.name, i.a, i.b, i.kind, float(i.iv), float(i.gini or 0.0)) for i in kept]
    return spark.createDataFrame(rows, "name string, feature_a string, feature_b string, kind string, iv double, gini double")


@REG.query(
    "g15_frequency_encoding",
    FT + ", c AS (SELECT nation, count(*)::DOUBLE/(SELECT count(nation) FROM feats) AS s FROM feats WHERE nation IS NOT NULL GROUP BY 1) SELECT key, round(coalesce(s,0),6) AS nation_freq FROM feats LEFT JOIN c ON c.nation=feats.nation",
)
def _(spark, d):
    f = feature_table(spark, d)
    return fe.frequency_encode(f, f, "nation").select("key", F.round("nation_freq", 6).alias("nation_freq"))


@REG.query(
    "g16_near_constant",
    FT + ", z AS (SELECT *, 1 AS one, CASE WHEN key%500=0 THEN 1 ELSE 0 END AS rare FROM feats), v AS (" + union(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, count(*) AS n FROM z WHERE {c} IS NOT NULL GROUP BY 2" for c in ("acctbal", "has_card", "one", "rare")
    ) + ") SELECT feature, count(*) AS \"unique\", round(max(n)/sum(n)::DOUBLE,6) AS top_share, count(*)<=1 OR max(n)/sum(n)::DOUBLE>0.99 AS near_constant FROM v GROUP BY 1",
)
def _(spark, d):
    f = feature_table(spark, d).withColumn("one", F.lit(1)).withColumn("rare", (F.col("key") % 500 == 0).cast("int"))
    return fe.near_constant(f, ["acctbal", "has_card", "one", "rare"])


def _plan(spark, d):
    f = splits.stratified_split(feature_table(spark, d), "y", ["key"])
    return f, fe.fit_features(f.where("split = 'train'"), NUMERIC, CATEGORICAL, transform_choices={"price": "log1p"})


@REG.query("g17_feature_plan")
def _(spark, d):
    _, plan = _plan(spark, d)
    rows = [(s, c, float(plan.iv[c]) if c in plan.iv else None) for s, c in plan.steps()]
    return spark.createDataFrame(rows, "step string, column string, iv double")


_TRAIN = """, h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ('0x'||substr(md5(CAST(key AS VARCHAR)||'42'),1,13))::BIGINT) AS rn, count(*) OVER (PARTITION BY y) AS nc FROM feats),
 tr AS (SELECT * FROM h WHERE rn>2*floor(nc*0.15::DOUBLE+0.5))"""


@REG.query(
    "g18_feature_plan_apply",
    FT + _TRAIN + ", lb AS (" + bucket_sql("status", "tr") + ")" + WOE
    + """, q AS (SELECT quantile_cont(acctbal,[0.2,0.4,0.6,0.8]) AS a FROM tr), fr AS (SELECT nation, count(*)::DOUBLE/(SELECT count(*) FROM tr) AS s FROM tr GROUP BY 1)
 SELECT f.key, round(ln(1+greatest(price,0)),6) AS price_log, CAST(CASE WHEN acctbal IS NULL THEN -2 ELSE len(list_filter(a, lambda x: x < acctbal)) END AS INTEGER) AS acctbal_bin,
 round(coalesce(fr.s,0),6) AS nation_freq, round(coalesce(w.woe,0),6) AS status_woe
 FROM feats f LEFT JOIN fr ON fr.nation=f.nation LEFT JOIN woe w ON w.feature='status' AND w.bucket=f.status, q""",
)
def _(spark, d):
    f = splits.stratified_split(feature_table(spark, d), "y", ["key"])
    train = f.where("split = 'train'")
    woe, iv = fe.fit_woe(train, ["acctbal"], ["status"])
    plan = fe.FeaturePlan(
        log_cols=("price",), bins={"acctbal": woe.specs["acctbal"]}, woe=woe, woe_cols=("status",), iv=iv,
        frequencies={"nation": {r["category"]: r["share"] for r in fe.frequency_table(train, "nation").collect()}},
    )
    out = fe.apply_features(f, plan)
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("price_log",)], "acctbal_bin", F.round("nation_freq", 6).alias("nation_freq"), F.round("status_woe", 6).alias("status_woe"))
