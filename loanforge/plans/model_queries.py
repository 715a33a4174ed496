"""Model fit, comparison, replication, importance and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanforge.operators import evaluate as ev
from loanforge.operators import features as fe
from loanforge.operators import models as md
from loanforge.operators import rules as ru
from loanforge.operators import tasks
from loanforge.operators.splits import stratified_split
from loanforge.plans.feature_queries import gini_sql, woe_sql
from loanforge.plans.data_queries import union
from loanforge.plans.evaluation_queries import METRICS_SQL
from loanforge.plans.fixtures import FEATURES, NUMERIC, SCORED, feature_table, scored_loans
from loanforge.plans.registry import Registry
from loanforge.session import scratch_path
from loanforge.sources.readers import load_table
from loanforge.streaming import monitor as mon

REG = Registry()
W = "WITH " + SCORED
FT = "WITH " + FEATURES
ROLES = md.Roles("y", ("key",), ("acctbal", "price", "late_count"), ("segment", "status"), (), ())
WIDE = md.Roles("y", ("key",), ("acctbal", "price", "late_count", "has_card"), ("segment", "status", "prio"), ("opted_in",), ("ts",))


def _filled(cols) -> str:
    return ", fm AS (SELECT y, " + ", ".join(f"coalesce({c}::DOUBLE,(SELECT quantile_cont({c}::DOUBLE,0.5) FROM feats)) AS {c}" for c in cols) + " FROM feats)"


_I1N = ["acctbal", "price", "price_half", "late_count"]
_I1F = [*_I1N, "segment", "status"]
_MI = ", lb AS (" + union(
    f"SELECT '{c}' AS feature, CAST(len(list_filter(q, lambda x: x < {c})) AS VARCHAR) AS bucket, y FROM fm, (SELECT list_slice(list_sort(list_distinct(quantile_cont({c}::DOUBLE,[0,0.2,0.4,0.6,0.8,1]))),2,-2) AS q FROM fm)"
    if c != "late_count" else f"SELECT '{c}', CAST({c} AS VARCHAR), y FROM fm"
    for c in _I1N
) + """), cells AS (SELECT feature, bucket, CAST(sum(1-y) AS BIGINT) AS good, CAST(sum(y) AS BIGINT) AS bad FROM lb GROUP BY 1,2),
 mr AS (SELECT feature, good AS c, good+bad AS m, sum(good) OVER w AS t, sum(good+bad) OVER w AS n FROM cells WINDOW w AS (PARTITION BY feature) UNION ALL SELECT feature, bad, good+bad, sum(bad) OVER w, sum(good+bad) OVER w FROM cells WINDOW w AS (PARTITION BY feature)),
 mi AS (SELECT avg(v) AS v FROM (SELECT feature, round(sum(CASE WHEN c>0 THEN c/n::DOUBLE*ln(c*n::DOUBLE/(m*t::DOUBLE)) ELSE 0 END),5) AS v FROM mr GROUP BY 1))"""


@REG.query(
    "i1_dataset_characteristics",
    FT + _filled(_I1N) + _MI + ", st AS (SELECT count(*) AS n, 100*(" + "+".join(f"1-count({c})/count(*)::DOUBLE" for c in _I1F) + f")/{len(_I1F)} AS miss, greatest(count(*) FILTER (y=0),count(*) FILTER (y=1))/least(count(*) FILTER (y=0),count(*) FILTER (y=1))::DOUBLE AS r FROM feats), pr AS ("
    + union(f"SELECT abs(corr({a},{b})) AS r FROM feats WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_I1N) for b in _I1N[i + 1 :])
    + "), co AS (SELECT 100*count(*) FILTER (r>0.8)/count(*)::DOUBLE AS c FROM pr), li AS (SELECT avg(abs(r)) AS l FROM (" + union(f"SELECT corr({c},y) AS r FROM feats WHERE {c} IS NOT NULL" for c in _I1N) + """))
 SELECT 'size' AS characteristic, round(least(log10(n+1)/5,1),6) AS score FROM st UNION ALL SELECT 'dimensionality', round(6/100.0::DOUBLE,6) UNION ALL SELECT 'missingness', round(least(miss/30,1),6) FROM st
 UNION ALL SELECT 'imbalance', round(least((r-1)/9,1),6) FROM st UNION ALL SELECT 'categorical', round(2/6.0::DOUBLE,6) UNION ALL SELECT 'multicollinearity', round(least(c/40,1),6) FROM co
 UNION ALL SELECT 'nonlinearity', round(greatest(0,least(1,least(v/0.15,1)-l)),6) FROM mi, li""",
)
def _(spark, d):
    return md.characteristics_table(feature_table(spark, d), _I1F, _I1N, ["segment", "status"], "y")


@REG.query("i4_weighted_fit")
def _(spark, d):
    train, _, test = md.three_way(feature_table(spark, d), WIDE)
    return md.fit_model(train, WIDE).score(test)


@REG.query("i5_cross_validation")
def _(spark, d):
    aucs = md.cross_validate(feature_table(spark, d), ROLES, folds=5)
    return spark.createDataFrame([(i, round(a, 6)) for i, a in enumerate(aucs)], "fold int, auc double")


@REG.query("i6_random_search")
def _(spark, d):
    train, _, _ = md.three_way(feature_table(spark, d), ROLES)
    rows = [(i + 1, str(sorted(p.items())), round(a, 6)) for i, (p, a) in enumerate(md.random_search(train, ROLES))]
    return spark.createDataFrame(rows, "rank int, params string, mean_auc double")


@REG.query("i7_out_of_time")
def _(spark, d):
    return md.evaluate_oot(feature_table(spark, d), ROLES, "ts")


@REG.query("i8_scoring")
def _(spark, d):
    f = feature_table(spark, d)
    train, _, _ = md.three_way(f, ROLES)
    path = scratch_path(spark, "model")
    md.fit_model(train, ROLES).save(path)
    return md.load_model(spark, path).score(f)


@REG.query("i9_model_comparison")
def _(spark, d):
    return md.compare_models(feature_table(spark, d), ROLES, ["Logistic Regression", "Decision Tree", "Random Forest"])


_AMOUNT = md.Roles("price", ("key",), ("acctbal", "late_count"))


@REG.query(
    "i4_regression_fit",
    FT + """, tr AS (SELECT key, y, price, acctbal, late_count FROM feats WHERE key%4<>0),
 m AS (SELECT quantile_cont(acctbal::DOUBLE,0.5) ma, quantile_cont(late_count::DOUBLE,0.5) ml FROM tr),
 b AS (SELECT quantile_cont(a,0.01) la, quantile_cont(a,0.99) ha FROM (SELECT coalesce(acctbal::DOUBLE,ma) a FROM tr, m)),
 z AS (SELECT quantile_cont(l,0.99) hl, min(l) ll FROM (SELECT coalesce(late_count::DOUBLE,0) l FROM tr)),
 x AS (SELECT f.key, f.price, f.key%4<>0 AS tr, least(greatest(coalesce(f.acctbal::DOUBLE,ma),la),ha) a, least(greatest(coalesce(f.late_count::DOUBLE,0),ll),hl) l FROM feats f, m, b, z),
 s AS (SELECT avg(price) p, avg(a) a, avg(l) l, var_pop(a) aa, var_pop(l) ll, covar_pop(a,l) al, covar_pop(a,price) ap, covar_pop(l,price) lp FROM x WHERE tr),
 c AS (SELECT p, a, l, (ap*ll-lp*al)/(aa*ll-al*al) ba, (lp*aa-ap*al)/(aa*ll-al*al) bl FROM s)
 SELECT x.key, round(c.p+ba*(x.a-c.a)+bl*(x.l-c.l),2) AS prediction FROM x, c WHERE NOT tr""",
)
def _(spark, d):
    f = feature_table(spark, d)
    m = tasks.fit_task_model(f.where("key % 4 <> 0"), _AMOUNT, "regression")
    return m.score(f.where("key % 4 = 0"), ["key"]).select("key", F.round("prediction", 2).alias("prediction"))


_STATUS = md.Roles("status", ("key",), ("price", "acctbal", "late_count"), ("prio", "segment"))


@REG.query("i4_multiclass_fit")
def _(spark, d):
    f = feature_table(spark, d)
    m = tasks.fit_task_model(f.where("key % 4 <> 0"), _STATUS, "multiclass")
    return m.score(f.where("key % 4 = 0")).select("key", "prediction", *[F.round(F.col("probabilities")[c], 4).alias(f"p_{c}") for c in m.classes])


@REG.query("i9_regression_comparison")
def _(spark, d):
    return tasks.compare_task_models(feature_table(spark, d), md.Roles("price", ("key",), ("acctbal", "late_count"), ("prio", "segment")), "regression")


@REG.query("i9_multiclass_comparison")
def _(spark, d):
    return tasks.compare_task_models(feature_table(spark, d), _STATUS, "multiclass")


def _challenger(spark, d):
    z = F.lit(-1.0) - F.col("acctbal") / F.lit(5000.0)
    return scored_loans(spark, d).withColumn("p", F.round(1.0 / (1.0 + F.exp(-z)), 6))


def metric_cte(src: str, tag: str, p: str = "p") -> str:
    """METRICS_SQL over another scored CTE; every CTE name gets the tag."""
    s = METRICS_SQL
    for name in ("gg", "ll", "lm", "cf", "mt"):
        s = s.replace(f" {name} AS (", f" {tag}{name} AS (").replace(f"FROM {name}", f"FROM {tag}{name}").replace(f"\n, {name} AS", f"\n, {tag}{name} AS")
    return s.replace("FROM scored", f"FROM {src}")


_SCALL = ", sall AS (SELECT * REPLACE ('all' AS grp) FROM scored), schl AS (SELECT * REPLACE ('all' AS grp, round(1.0::DOUBLE/(1.0::DOUBLE+exp(-(-1.0::DOUBLE-acctbal/5000.0::DOUBLE))),6) AS p) FROM scored)"


@REG.query(
    "i10_champion_challenger",
    W + _SCALL + metric_cte("sall", "w_") + metric_cte("schl", "c_") + """ SELECT 'challenger' AS challenger, w_mt.metric, w_mt.value AS champion_value, c_mt.value AS challenger_value, round(c_mt.value-w_mt.value,4) AS delta,
 CASE WHEN w_mt.metric='roc_auc' AND w_mt.value<c_mt.value-0.02 THEN 'WARN' ELSE 'PASS' END AS status FROM w_mt JOIN c_mt ON w_mt.metric=c_mt.metric WHERE w_mt.metric IN ('roc_auc','gini','recall')""",
)
def _(spark, d):
    return ev.side_by_side({"champion": ev.metric_table(scored_loans(spark, d), 0.3), "challenger": ev.metric_table(_challenger(spark, d), 0.3)})


@REG.query("i11_replication_fit")
def _(spark, d):
    r = md.replicate(feature_table(spark, d), ROLES)
    return ev.metric_table(r.scored, None, y="y")


@REG.query("i12_seed_stability")
def _(spark, d):
    aucs = md.seed_aucs(feature_table(spark, d), ROLES)
    checks = ru.stability_checks(aucs, {})
    rows = [("auc", float(i), round(a, 6), "") for i, a in enumerate(aucs)] + [(c, 0.0, float(v or 0.0), s) for c, _, v, s in checks if c == "R4.6"]
    return spark.createDataFrame(rows, "item string, seq double, value double, status string")


@REG.query("i13_ablation")
def _(spark, d):
    a = md.ablation(feature_table(spark, d), ROLES)
    return spark.createDataFrame([(k, v) for k, v in a.items()], "feature string, auc_drop double")


@REG.query(
    "i14_replication_checks",
    W + _SCALL + METRICS_SQL + metric_cte("sall", "w_") + """, w AS (SELECT m.grp, m.metric, m.value AS a, r.value AS b, abs(m.value-r.value) AS d FROM mt m JOIN w_mt r ON r.metric=m.metric),
 x AS (SELECT grp, max(d) FILTER (metric='roc_auc') AS auc, max(d) FILTER (metric='gini') AS gini, max(d) FILTER (metric='ks') AS ks, max(d/abs(b)) FILTER (metric IN ('accuracy','precision','recall','f1')) AS rel FROM w GROUP BY grp)
 SELECT grp AS entity, 'R4.2' AS check_id, 'high' AS severity, round(auc,6) AS difference, CASE WHEN auc<=0.03 THEN 'PASS' WHEN auc<=0.06 THEN 'WARN' ELSE 'FAIL' END AS status FROM x
 UNION ALL SELECT grp, 'R4.3', 'high', round(greatest(gini,ks),6), CASE WHEN gini<=0.05 AND ks<=0.03 THEN 'PASS' ELSE 'FAIL' END FROM x
 UNION ALL SELECT grp, 'R4.4', 'medium', round(rel,6), CASE WHEN rel>0.05 THEN 'FAIL' ELSE 'PASS' END FROM x UNION ALL SELECT grp, 'R4.8', 'medium', NULL, 'SKIP' FROM x""",
)
def _(spark, d):
    s = scored_loans(spark, d)
    rep = ev.metric_table(s, 0.3, ["grp"]).withColumnRenamed("grp", "entity")
    whole = ev.metric_table(s, 0.3)
    groups = rep.select("entity").distinct()
    reported = rep.select("entity", "metric").join(whole, "metric")  # the whole-table value of each group metric
    return ru.replication_checks(rep, reported.join(groups, "entity", "left_semi"))


@REG.query(
    "i15_importance_agreement",
    FT + woe_sql(NUMERIC) + _filled(NUMERIC).replace("fm AS", "fl AS") + gini_sql(NUMERIC, "fl") + """, a AS (SELECT feature, round(iv,5) AS rep, row_number() OVER (ORDER BY round(iv,5) DESC, feature) AS rr FROM iv),
 b AS (SELECT feature, round(gini,4) AS sta, row_number() OVER (ORDER BY round(gini,4) DESC, feature) AS rs FROM gi), j AS (SELECT a.feature, rr, rs, abs(rep/sum(rep) OVER () - sta/sum(sta) OVER ()) AS d FROM a JOIN b ON a.feature=b.feature),
 s AS (SELECT count(*) FILTER (rr<=5 AND rs<=5) AS o, count(*) FILTER (rr=1 AND rs=1)>0 AS f, avg(d) AS m FROM j)
 SELECT o AS overlap, f AS same_first, round(m,6) AS mean_difference, CASE WHEN o/5.0>=0.8 AND f AND m<0.15 THEN 'PASS' WHEN o/5.0>=0.6 AND m<0.25 THEN 'WARN' ELSE 'FAIL' END AS status FROM s""",
)
def _(spark, d):
    f = feature_table(spark, d)
    rep = fe.information_value(f, NUMERIC, []).select("feature", F.col("iv").alias("importance"))
    return ru.importance_agreement(rep, ev.univariate_gini(f, NUMERIC).select("feature", F.col("gini").alias("importance")))


@REG.query("k1_feature_importance")
def _(spark, d):
    train, _, _ = md.three_way(feature_table(spark, d), ROLES)
    return md.importance_table(spark, md.fit_model(train, ROLES, "Random Forest", {"numTrees": 20}))


@REG.query("k5_quick_importance")
def _(spark, d):
    return md.quick_importance(feature_table(spark, d), ["acctbal", "price", "late_count", "has_card"], "y")


# ---- streaming -----------------------------------------------------------

_REF = ", rb AS (SELECT min(p) AS lo, max(p) AS hi FROM scored), rs AS (SELECT CAST(least(floor((p-lo)/(hi-lo)*10),9) AS INTEGER) AS b, count(*)::DOUBLE/(SELECT count(*) FROM scored) AS e FROM scored, rb GROUP BY 1)"


@REG.query(
    "p1_window_monitoring",
    W + _REF + """, wi AS (SELECT CAST(floor(epoch(ts)/2592000) AS BIGINT) AS w, CAST(least(floor((p-lo)/(hi-lo)*10),9) AS INTEGER) AS b, y, p FROM scored, rb),
 ww AS (SELECT w, count(*) AS n, avg(y) AS a, avg(p) AS q, abs(avg(y)-avg(p)) AS gap FROM wi GROUP BY w),
 bb AS (SELECT ww.w, r.i AS b, coalesce(max(rs.e),0.0001::DOUBLE) AS e, coalesce(nullif(count(wi.b),0)/max(ww.n)::DOUBLE,0.0001::DOUBLE) AS x FROM ww CROSS JOIN range(0,10) r(i) LEFT JOIN rs ON rs.b=r.i LEFT JOIN wi ON wi.w=ww.w AND wi.b=r.i GROUP BY 1,2),
 ps AS (SELECT w, sum((x-e)*ln(x/e)) AS psi FROM bb GROUP BY w)
 SELECT ww.w*2592000 AS window_start, n, round(CAST(a AS DECIMAL(28,10)),6)::DOUBLE AS actual_dr, round(CAST(q AS DECIMAL(28,10)),6)::DOUBLE AS avg_pred_pd, round(CAST(gap AS DECIMAL(28,8)),4)::DOUBLE AS gap, round(psi,6) AS psi, CASE WHEN psi>=0.25 THEN 'FAIL' WHEN psi>=0.1 THEN 'WARN' ELSE 'PASS' END AS status, psi>0.25 AS "trigger" FROM ww JOIN ps ON ps.w=ww.w""",
)
def _(spark, d):
    ref = mon.fit_reference(scored_loans(spark, d))
    out, ck = scratch_path(spark, "monitor"), scratch_path(spark, "monitor-state")
    c = load_table(spark, d, "customer")
    o = mon.event_time(mon.read_table_stream(spark, d, "orders"), ["o_orderdate"])
    z = F.lit(-2.0) + F.col("o_totalprice") / F.lit(200000.0) - F.col("c_acctbal") / F.lit(8000.0)
    k = F.col("o_orderkey")
    s = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderdate").alias("ts"), k.alias("key"), F.round(1.0 / (1.0 + F.exp(-z)), 6).alias("p")
    ).withColumn("y", F.when(((F.col("key") * 7919) % 10007) / F.lit(10007.0) < F.col("p"), 1).otherwise(0))
    mon.start_monitor(s, ref, out, ck).awaitTermination()
    t = mon.latest_windows(spark, out)
    return t.select(F.unix_timestamp("window_start").alias("window_start"), "n", "actual_dr", "avg_pred_pd", "gap", "psi", "status", "trigger")


@REG.query("p2_stream_scoring")
def _(spark, d):
    f = feature_table(spark, d).select("key", "y", "acctbal", "price", "segment")
    roles = md.Roles("y", ("key",), ("acctbal", "price"), ("segment",))
    train = stratified_split(f, "y", ["key"]).where("split = 'train'").drop("split")
    model = md.fit_model(train, roles)
    src, out, ck = (scratch_path(spark, x) for x in ("arrivals", "scores", "scores-state"))
    f.write.parquet(src)
    stream = spark.readStream.schema(f.schema).parquet(src)
    mon.start_scoring(stream, lambda s: model.score(s, ["key", "y"]), out, ck).awaitTermination()
    return spark.read.parquet(out)


@REG.query(
    "p3_run_event_stream",
    "SELECT event_type AS stage, arg_max(CAST(event_id AS VARCHAR), ts) AS run_id, arg_max(props, ts) AS summary FROM events GROUP BY 1",
)
def _(spark, d):
    e = mon.event_time(mon.read_table_stream(spark, d, "events"), ["ts"]).select(
        F.col("event_id").cast("string").alias("run_id"), "ts", F.col("event_type").alias("stage"), F.col("props").alias("summary")
    )
    out, ck = scratch_path(spark, "events"), scratch_path(spark, "events-state")
    mon.start_run_events(e, out, ck).awaitTermination()
    return mon.current_versions(spark, out).select("stage", "run_id", "summary")
