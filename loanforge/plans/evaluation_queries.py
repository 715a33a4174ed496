"""Evaluation, fairness and explanation queries over the scored table."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from loanforge.operators import evaluate as ev
from loanforge.operators import fairness as fair
from loanforge.operators.ordering import score_ladder
from loanforge.plans.fixtures import FEATURES, SCORED, feature_table, scored_loans
from loanforge.plans.registry import Registry

REG = Registry()
W = "WITH " + SCORED
LADDER = W + """, g AS (SELECT p AS score, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM scored GROUP BY p),
lad AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
 sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g)
"""
GRID = "[" + ",".join(f"{t!r}::DOUBLE" for t in ev.THRESHOLDS) + "]"
SWEEP = W + f""", t AS (SELECT unnest({GRID}) AS t),
c AS (SELECT t, sum(CASE WHEN y=1 AND p>=t THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y=0 AND p>=t THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN y=1 AND p<t THEN 1 ELSE 0 END)::DOUBLE AS fn FROM scored, t GROUP BY t),
m AS (SELECT t, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END AS precision, CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END AS recall,
  CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS f1 FROM c)
"""
CONF = W + """, c AS (SELECT count(*) FILTER (y=1 AND p>=0.3::DOUBLE) AS tp, count(*) FILTER (y=0 AND p>=0.3::DOUBLE) AS fp,
 count(*) FILTER (y=0 AND p<0.3::DOUBLE) AS tn, count(*) FILTER (y=1 AND p<0.3::DOUBLE) AS fn FROM scored)
"""


@REG.query(
    "j0_score_ladder",
    LADDER + """SELECT score, CAST(pos AS BIGINT) pos, CAST(neg AS BIGINT) neg, CAST(cp AS BIGINT) cum_pos, CAST(cn AS BIGINT) cum_neg,
 CAST(tp AS BIGINT) tot_pos, CAST(tn AS BIGINT) tot_neg FROM lad""",
)
def _(spark, d):
    return score_ladder(scored_loans(spark, d))


@REG.query(
    "j1_threshold_metrics",
    CONF + """SELECT 0.3::DOUBLE AS threshold, tp, fp, tn, fn, round((tp+tn)/(tp+fp+tn+fn)::DOUBLE,4) AS accuracy,
 round(tp/(tp+fp)::DOUBLE,4) AS precision, round(tp/(tp+fn)::DOUBLE,4) AS recall, round(2.0*tp/(2*tp+fp+fn)::DOUBLE,4) AS f1 FROM c""",
)
def _(spark, d):
    return ev.threshold_metrics(scored_loans(spark, d), 0.3)


@REG.query(
    "j2_class_report",
    CONF + """, m AS (SELECT tn/(tn+fn)::DOUBLE p0, tn/(tn+fp)::DOUBLE r0, 2.0*tn/(2*tn+fp+fn)::DOUBLE f0, tn+fp AS s0,
 tp/(tp+fp)::DOUBLE p1, tp/(tp+fn)::DOUBLE r1, 2.0*tp/(2*tp+fp+fn)::DOUBLE f1, tp+fn AS s1 FROM c)
SELECT '0' AS label, round(p0,4) AS precision, round(r0,4) AS recall, round(f0,4) AS f1, s0 AS support FROM m UNION ALL
SELECT '1', round(p1,4), round(r1,4), round(f1,4), s1 FROM m UNION ALL
SELECT 'macro avg', round((p0+p1)/2,4), round((r0+r1)/2,4), round((f0+f1)/2,4), s0+s1 FROM m UNION ALL
SELECT 'weighted avg', round((p0*s0+p1*s1)/(s0+s1),4), round((r0*s0+r1*s1)/(s0+s1),4), round((f0*s0+f1*s1)/(s0+s1),4), s0+s1 FROM m""",
)
def _(spark, d):
    return ev.class_report(scored_loans(spark, d), 0.3)


@REG.query(
    "j3_best_threshold",
    SWEEP + "SELECT round(t,4) AS threshold, 'f1' AS metric, round(f1,4) AS f1, round(precision,4) AS precision, round(recall,4) AS recall FROM m ORDER BY m.f1 DESC, t LIMIT 1",
)
def _(spark, d):
    return ev.best_threshold(scored_loans(spark, d))


@REG.query(
    "j4_threshold_sweep",
    SWEEP + "SELECT round(t,4) AS threshold, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM m",
)
def _(spark, d):
    return ev.threshold_sweep(scored_loans(spark, d))


@REG.query(
    "j5_roc_points",
    LADDER + "SELECT score, round(cn/tn,6) AS fpr, round(cp/tp,6) AS tpr FROM lad UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE",
)
def _(spark, d):
    return ev.roc_points(scored_loans(spark, d))


@REG.query(
    "j6_auc_gini",
    LADDER + ", a AS (SELECT sum(neg*(cp-pos*0.5::DOUBLE))/max(tp*tn) AS auc FROM lad) SELECT round(auc,6) AS auc, round(2*auc-1,6) AS gini FROM a",
)
def _(spark, d):
    return ev.auc_gini(scored_loans(spark, d))


@REG.query(
    "j7_pr_points",
    LADDER + "SELECT score, round(cp/(cp+cn),6) AS precision, round(cp/tp,6) AS recall FROM lad UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE",
)
def _(spark, d):
    return ev.pr_points(scored_loans(spark, d))


@REG.query("j8_average_precision", LADDER + "SELECT round(sum(pos/tp*cp/(cp+cn)),6) AS pr_auc FROM lad")
def _(spark, d):
    return ev.average_precision(scored_loans(spark, d))


@REG.query("j9_ks_statistic", LADDER + "SELECT round(max(abs(cp/tp-cn/tn)),4) AS ks_statistic FROM lad")
def _(spark, d):
    return ev.ks_statistic(scored_loans(spark, d)).select("ks_statistic")


@REG.query("j10_brier", W + " SELECT round(avg((p-y)*(p-y)),6) AS brier_score FROM scored")
def _(spark, d):
    return ev.brier(scored_loans(spark, d))


_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 41)]
_BINS = ",".join(
    f"({i},{a!r}::DOUBLE,{b!r}::DOUBLE,'{a:.2f}-{b:.2f}')" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))
)


@REG.query(
    "j11_score_distribution",
    W + f""", e(bin_index, lo, hi, bin) AS (VALUES {_BINS})
SELECT bin_index, bin, count(*) FILTER (y=0) AS good, count(*) FILTER (y=1) AS bad FROM scored JOIN e
 ON p>=lo AND (p<hi OR (bin_index=39 AND p<=hi)) GROUP BY 1,2""",
)
def _(spark, d):
    return ev.score_distribution(scored_loans(spark, d))


GAIN = W + """, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, key) AS rn, count(*) OVER () AS n, sum(y) OVER () AS np FROM scored),
 q AS (SELECT i, i/10.0::DOUBLE AS pct FROM range(0,11) t(i)),
 g AS (SELECT i, pct, coalesce(sum(y) FILTER (rn <= floor(n*pct)),0)/max(np)::DOUBLE AS gain FROM r, q GROUP BY 1,2)
"""


@REG.query(
    "j12_gain_chart",
    GAIN + "SELECT CAST(i*10 AS INTEGER) AS decile, round(gain*100,2) AS model, round(pct*100,2) AS baseline FROM g",
)
def _(spark, d):
    return ev.gain_lift(scored_loans(spark, d)).select("decile", "model", "baseline")


@REG.query(
    "j13_lift_table",
    GAIN + """SELECT CAST(i*10 AS INTEGER) AS decile, round(gain*100,2) AS model, round(pct*100,2) AS baseline,
 CASE WHEN pct>0 THEN round(gain/pct,4) ELSE 0 END AS lift FROM g""",
)
def _(spark, d):
    return ev.gain_lift(scored_loans(spark, d))


@REG.query(
    "j13_lift_curve",
    LADDER + "SELECT score, round((cp+cn)/(tp+tn),6) AS cum_pct, round(cp/tp,6) AS cum_gain, round((cp/tp)/((cp+cn)/(tp+tn)),4) AS lift FROM lad",
)
def _(spark, d):
    return ev.lift_curve(scored_loans(spark, d))


@REG.query(
    "j14_regression_metrics",
    """WITH e AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity*1500.0::DOUBLE AS f FROM lineitem),
 g AS (SELECT l_returnflag, avg(abs(a-f)) mae, avg((a-f)*(a-f)) mse, var_pop(a) v FROM e GROUP BY 1)
 SELECT l_returnflag, round(1-mse/v,4) AS r2, round(mae,4) AS mae, round(mse,4) AS mse, round(sqrt(mse),4) AS rmse FROM g""",
)
def _(spark, d):
    from loanforge.sources.readers import load_table

    li = load_table(spark, d, "lineitem").select(
        "l_returnflag", "l_extendedprice", (F.col("l_quantity") * F.lit(1500.0)).alias("pred")
    )
    return ev.regression_metrics(li, "l_extendedprice", "pred", ["l_returnflag"])


@REG.query(
    "j15_heteroscedasticity",
    W + """, x AS (SELECT p, y-p AS e, abs(y-p) AS r FROM scored),
 k AS (SELECT *, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS rp,
   rank() OVER (ORDER BY r)+(count(*) OVER (PARTITION BY r)-1)/2.0::DOUBLE AS rr FROM x),
 c AS (SELECT corr(rp, rr) AS rho FROM k),
 q AS (SELECT quantile_cont(p,[0.2,0.4,0.6,0.8]) AS q FROM scored),
 b AS (SELECT CASE WHEN p<=q[1] THEN 0 WHEN p<=q[2] THEN 1 WHEN p<=q[3] THEN 2 WHEN p<=q[4] THEN 3 ELSE 4 END AS bin, e FROM x, q),
 v AS (SELECT bin, var_samp(e) AS v FROM b GROUP BY 1),
 z AS (SELECT round(max(v)/min(v),3) AS vr FROM v WHERE v>0)
 SELECT round(rho,4) AS spearman_abs_resid_vs_score, vr AS variance_ratio,
  CASE WHEN abs(rho)>0.35 OR vr>4 THEN 'Potential heteroscedasticity' ELSE 'No strong signal' END AS risk_flag FROM c, z""",
)
def _(spark, d):
    return ev.heteroscedasticity(scored_loans(spark, d))


@REG.query(
    "j16_calibration",
    W + """, q AS (SELECT quantile_cont(p,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM scored),
 b AS (SELECT y, p, CAST(len(list_filter(q, lambda x: x < p)) AS INTEGER) AS bin FROM scored, q)
 SELECT bin, round(avg(y),6) AS actual_rate, round(avg(p),6) AS predicted_rate, count(*) AS n FROM b GROUP BY bin""",
)
def _(spark, d):
    return ev.calibration(scored_loans(spark, d))


def _temporal(freqs: list[str]) -> str:
    label = {
        "Monthly": "strftime(ts,'%Y-%m')",
        "Quarterly": "year(ts)||'Q'||quarter(ts)",
        "Half-yearly": "year(ts)||'H'||CASE WHEN month(ts)<=6 THEN 1 ELSE 2 END",
        "Yearly": "CAST(year(ts) AS VARCHAR)",
    }
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS freq, {label[f]} AS period, avg(y) AS a, avg(p) AS q, count(*) AS n FROM scored GROUP BY 2" for f in freqs
    )
    return W + f", t AS (SELECT *, a-q AS gap FROM ({parts})) "




def settle_sql(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DECIMAL(28,{digits + 4})),{digits})::DOUBLE"


_ROWS = f"SELECT freq, period, n, {settle_sql('a', 6)} AS actual_rate, {settle_sql('q', 6)} AS predicted_rate, {settle_sql('gap', 6)} AS gap, abs(gap)>0.05 AS flagged FROM t"
_STAB = """SELECT freq, count(*) AS n_periods_total, count(*) FILTER (abs(gap)>0.05) AS n_periods_flagged, round(avg(abs(gap)),6) AS mean_absolute_gap,
 arg_max(period, gap) FILTER (gap>0) AS max_underestimation_period, round(coalesce(max(gap) FILTER (gap>0),0),6) AS max_underestimation_gap,
 arg_min(period, gap) FILTER (gap<0) AS max_overestimation_period, round(coalesce(-min(gap) FILTER (gap<0),0),6) AS max_overestimation_gap FROM t GROUP BY freq"""


@REG.query("j17_temporal_actual_vs_predicted", _temporal(["Monthly"]) + _ROWS)
def _(spark, d):
    return ev.temporal_actual_vs_predicted(scored_loans(spark, d))


@REG.query("j18_temporal_stability", _temporal(["Quarterly"]) + _STAB)
def _(spark, d):
    return ev.temporal_stability(scored_loans(spark, d), ["Quarterly"])


@REG.query("j19_temporal_bundle", _temporal(["Monthly", "Quarterly", "Half-yearly", "Yearly"]) + _ROWS)
def _(spark, d):
    return ev.temporal_actual_vs_predicted(scored_loans(spark, d), ["Monthly", "Quarterly", "Half-yearly", "Yearly"])


METRICS_SQL = """
, gg AS (SELECT grp, p AS score, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM scored GROUP BY 1,2),
 ll AS (SELECT *, sum(pos) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(neg) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
   sum(pos) OVER (PARTITION BY grp) AS tp, sum(neg) OVER (PARTITION BY grp) AS tn FROM gg),
 lm AS (SELECT grp, sum(neg*(cp-pos*0.5::DOUBLE))/max(tp*tn) AS roc_auc, sum(pos/tp*cp/(cp+cn)) AS pr_auc, max(abs(cp/tp-cn/tn)) AS ks FROM ll GROUP BY grp),
 cf AS (SELECT grp, avg((p-y)*(p-y)) AS br, count(*) FILTER (y=1 AND p>=0.3::DOUBLE)::DOUBLE tp, count(*) FILTER (y=0 AND p>=0.3::DOUBLE)::DOUBLE fp,
   count(*) FILTER (y=0 AND p<0.3::DOUBLE)::DOUBLE tn, count(*) FILTER (y=1 AND p<0.3::DOUBLE)::DOUBLE fn FROM scored GROUP BY grp),
 mt AS (SELECT grp, 'accuracy' AS metric, round((tp+tn)/(tp+fp+tn+fn),4) AS value FROM cf UNION ALL
  SELECT grp,'precision', round(tp/(tp+fp),4) FROM cf UNION ALL SELECT grp,'recall', round(tp/(tp+fn),4) FROM cf UNION ALL
  SELECT grp,'f1', round(2*tp/(2*tp+fp+fn),4) FROM cf UNION ALL SELECT grp,'roc_auc', round(roc_auc,4) FROM lm UNION ALL
  SELECT grp,'pr_auc', round(pr_auc,4) FROM lm UNION ALL SELECT grp,'ks', round(ks,4) FROM lm UNION ALL
  SELECT grp,'gini', round(2*roc_auc-1,4) FROM lm UNION ALL SELECT grp,'brier_score', round(br,4) FROM cf)
"""
GATES_SQL = "(VALUES " + ",".join(f"('{m}','{o}',{v}::DOUBLE)" for m, o, v in ev.METRIC_GATES) + ") g(metric, operator, lim)"


@REG.query("j20_metric_table", W + METRICS_SQL + "SELECT * FROM mt")
def _(spark, d):
    return ev.metric_table(scored_loans(spark, d), 0.3, ["grp"])


@REG.query(
    "j20_metric_gates",
    W + METRICS_SQL + f"""SELECT grp, mt.metric, value, operator, lim AS "limit",
 CASE WHEN (operator='>=' AND value>=lim) OR (operator='<' AND value<lim) THEN 'PASS' ELSE 'FAIL' END AS status FROM mt JOIN {GATES_SQL} ON mt.metric=g.metric""",
)
def _(spark, d):
    return ev.metric_gates(ev.metric_table(scored_loans(spark, d), 0.3, ["grp"]))


_GROUPS = W + METRICS_SQL + """, gr AS (SELECT s.grp, count(*) AS n, round(avg(y),4) AS default_rate, round(avg(p),4) AS avg_predicted_pd, max(round(roc_auc,4)) AS auc
 FROM scored s JOIN lm ON lm.grp=s.grp GROUP BY s.grp HAVING count(*)>=10) """


@REG.query("m1_group_performance", _GROUPS + "SELECT grp AS \"group\", n AS count, default_rate, avg_predicted_pd, auc FROM gr")
def _(spark, d):
    return fair.group_performance(scored_loans(spark, d), "grp")


@REG.query(
    "m1_bias_check",
    _GROUPS + """, x AS (SELECT round(max(auc)-min(auc),4) AS auc_gap, max(auc) AS max_auc, min(auc) AS min_auc, count(auc) AS n_groups FROM gr)
 SELECT n_groups, max_auc, min_auc, auc_gap, CASE WHEN n_groups<2 THEN 'WARN' WHEN auc_gap<0.05 THEN 'PASS' WHEN auc_gap<0.10 THEN 'WARN' ELSE 'FAIL' END AS status FROM x""",
)
def _(spark, d):
    return fair.bias_check(scored_loans(spark, d), "grp")


@REG.query(
    "m2_disparate_impact",
    "WITH " + FEATURES + """, l AS (SELECT 'segment' AS feature, segment AS v, y FROM feats UNION ALL SELECT 'prio', prio, y FROM feats UNION ALL SELECT 'nation', nation, y FROM feats),
 r AS (SELECT feature, v, avg(y) AS rate FROM l WHERE v IS NOT NULL GROUP BY 1,2),
 x AS (SELECT feature, count(*) AS n_groups, round(min(rate),4) AS min_rate, round(max(rate),4) AS max_rate FROM r GROUP BY 1)
 SELECT feature, n_groups, min_rate, max_rate, CASE WHEN max_rate>0 THEN round(min_rate/max_rate,4) ELSE 1 END AS di_ratio,
  CASE WHEN max_rate>0 AND round(min_rate/max_rate,4)<0.80 THEN 'FAIL' ELSE 'PASS' END AS status FROM x WHERE n_groups BETWEEN 2 AND 20""",
)
def _(spark, d):
    return fair.disparate_impact(feature_table(spark, d), ["segment", "prio", "nation"])
