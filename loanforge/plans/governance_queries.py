"""Rule, verdict, inventory, explanation, run-log and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanforge.operators.profile import leakage_columns
from loanforge.operators import documents as dc
from loanforge.operators import evaluate as ev
from loanforge.operators import explain as xp
from loanforge.operators import rules as ru
from loanforge.operators.splits import fold_column
from loanforge.plans.data_queries import corr_sql, union
from loanforge.plans.evaluation_queries import METRICS_SQL
from loanforge.plans.fixtures import CATEGORICAL, FEATURES, NUMERIC, SCORED, feature_table, scored_loans
from loanforge.plans.feature_queries import woe_sql
from loanforge.plans.registry import Registry
from loanforge.session import scratch_path
from loanforge.sources import runlog
from loanforge.sources.readers import load_table, spread

REG = Registry()
W = "WITH " + SCORED


# ---- run log -------------------------------------------------------------

EVENTS = """ev AS (SELECT CAST(event_id AS VARCHAR) AS run_id, ts, event_type AS stage, props AS summary FROM events)"""


def events_log(spark, d):
    return load_table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("run_id"), "ts", F.col("event_type").alias("stage"), F.col("props").alias("summary")
    )


@REG.query("a8_run_event_append", "WITH " + EVENTS + " SELECT run_id, stage, CAST(json_extract(summary,'$.k') AS BIGINT) AS k FROM ev")
def _(spark, d):
    path = scratch_path(spark, "log")
    e = events_log(spark, d)
    runlog.append_events(e.where("stage in ('view', 'click')"), path)
    runlog.append_events(e.where("stage not in ('view', 'click')"), path)
    return runlog.parse_summary(runlog.read_events(spark, path), "k bigint").select("run_id", "stage", "k")


@REG.query("a9_latest_by_stage", "WITH " + EVENTS + " SELECT stage, arg_max(run_id, ts) AS run_id, arg_max(summary, ts) AS summary FROM ev GROUP BY stage")
def _(spark, d):
    return runlog.latest_by_stage(events_log(spark, d)).select("stage", "run_id", "summary")


@REG.query("a9_parsed_summary", "WITH " + EVENTS + " SELECT stage, count(*) AS n, CAST(sum(CAST(json_extract(summary,'$.k') AS BIGINT)) AS BIGINT) AS k FROM ev GROUP BY stage")
def _(spark, d):
    e = runlog.parse_summary(events_log(spark, d), "k bigint")
    return e.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@REG.query(
    "a10_activity_feed",
    """SELECT 'development' AS source, CAST(event_id AS VARCHAR) AS run_id, event_type AS stage FROM events
 UNION ALL SELECT 'validation', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders""",
)
def _(spark, d):
    o = load_table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("stage"),
        F.lit(None).cast("string").alias("summary"),
    )
    return runlog.activity_feed([("development", events_log(spark, d)), ("validation", o)]).select("source", "run_id", "stage")


# ---- explanation ---------------------------------------------------------

COEF = {"acctbal": -0.000125, "price": 0.000005, "late_count": 0.3, "has_card": -0.2}
_MEANS = ", mu AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in COEF) + " FROM feats)"
_CON = "WITH " + FEATURES + _MEANS + ", con AS (" + union(
    f"SELECT key, '{c}' AS feature, {c}::DOUBLE AS value, {b!r}::DOUBLE*(coalesce({c},m_{c})-m_{c}) AS c FROM feats, mu" for c, b in COEF.items()
) + ")"


@REG.query("k2_mean_abs_contribution", _CON + " SELECT feature, round(avg(abs(c)),6) AS mean_abs_contribution FROM con GROUP BY feature")
def _(spark, d):
    return xp.mean_abs_contribution(feature_table(spark, d), COEF)


_RANK = _CON + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY abs(c) DESC, feature) AS INTEGER) AS rank FROM con)"


@REG.query("k3_top_drivers", _RANK + " SELECT key, rank, feature, round(value,4) AS value, round(c,6) AS contribution FROM r WHERE rank<=3")
def _(spark, d):
    return xp.top_drivers(feature_table(spark, d), "key", COEF, n=3)


@REG.query(
    "k4_reason_codes",
    _RANK + """, t AS (SELECT key, string_agg(feature||CASE WHEN c>0 THEN ' increases' ELSE ' reduces' END||' default risk','; ' ORDER BY rank) AS reasons FROM r WHERE rank<=5 GROUP BY key)
 SELECT t.key, CASE WHEN p>=0.3::DOUBLE THEN 'HIGH RISK' ELSE 'LOW RISK' END AS decision, round(p,6) AS probability, reasons FROM t JOIN scored ON scored.key=t.key""",
)
def _(spark, d):
    f = feature_table(spark, d).join(scored_loans(spark, d).select("key", "p"), "key")
    return xp.reason_codes(f, "key", COEF, threshold=0.3)


# ---- rules ---------------------------------------------------------------


def group_metrics(spark, d):
    return ev.metric_table(scored_loans(spark, d), 0.3, ["grp"]).withColumnRenamed("grp", "entity")


def _rules_values(stage=None) -> str:
    rows = [r for r in ru.RULES if stage in (None, r.stage)]
    return "(VALUES " + ",".join(
        f"('{r.id}','{r.source}','{r.principle}','{r.stage}','{r.metric}','{r.operator}',{'NULL' if r.threshold is None else repr(r.threshold) + '::DOUBLE'},'{r.severity}')" for r in rows
    ) + ") rl(rule_id, source, principle, stage, metric, operator, threshold, severity)"


_FAIL = """CASE operator WHEN '>=' THEN value<threshold WHEN '<=' THEN value>threshold WHEN '==' THEN value<>threshold WHEN 'is_true' THEN value=0 WHEN 'is_false' THEN value<>0 WHEN 'is_present' THEN value IS NULL ELSE false END"""


def _flag_sql(stage, mt="mt") -> str:
    return f"""SELECT e.entity, rule_id, source, principle, stage, rl.metric, operator, threshold, severity, value, 'FLAG' AS status FROM (SELECT DISTINCT entity FROM {mt}) e
 CROSS JOIN {_rules_values(stage)} LEFT JOIN {mt} m ON m.entity=e.entity AND m.metric=rl.metric WHERE (value IS NOT NULL OR operator='is_present') AND {_FAIL}"""


_MT = METRICS_SQL.replace("mt AS (SELECT grp, 'accuracy'", "mt AS (SELECT grp AS entity, 'accuracy'")

_N1 = "WITH " + FEATURES + ", mt AS (SELECT 'loans' AS entity, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM feats UNION ALL SELECT 'loans','max_missing', greatest(" + ",".join(
    f"1-count({c})/count(*)::DOUBLE" for c in ("acctbal", "sparse", "late_count", "has_card", "prio")
) + """) FROM feats UNION ALL SELECT 'loans','duplicate_rate', ((SELECT count(*) FROM feats)-(SELECT count(*) FROM (SELECT DISTINCT * FROM feats)))/(SELECT count(*) FROM feats)::DOUBLE
 UNION ALL SELECT 'loans','id_columns', 1 UNION ALL SELECT 'loans','macro_columns', 0 UNION ALL SELECT 'loans','leakage_columns', """ + "+".join(
    f"CASE WHEN abs(corr({c}, y))>0.95 THEN 1 ELSE 0 END" for c in [*NUMERIC, "(1-y)"]
) + " FROM feats) "
_COLS = ["entity", "rule_id", "source", "principle", "stage", "metric", "operator", "threshold", "severity", "value", "status"]


@REG.query("n1_data_rules", _N1 + f"SELECT entity, rule_id, stage, severity, round(value,6) AS value FROM ({_flag_sql('data')})")
def _(spark, d):
    f = feature_table(spark, d)
    f = f.withColumn("settled", 1 - F.col("y"))  # known only once the outcome is
    leaks = [r["column"] for r in leakage_columns(f, [*NUMERIC, "settled"], "y").select("column").collect()]
    m = ru.data_metrics(f, "loans", ["key"], leaks)
    return ru.flags(m, "data").select("entity", "rule_id", "stage", "severity", F.round("value", 6).alias("value"))


_N2 = "WITH " + FEATURES + woe_sql(NUMERIC + CATEGORICAL) + ", r AS (" + corr_sql(NUMERIC) + """), mt AS (SELECT 'loans' AS entity, 'high_corr_pairs' AS metric, count(*) FILTER (abs(r)>0.9)::DOUBLE AS value FROM r
 UNION ALL SELECT 'loans','low_iv_columns', count(*) FILTER (round(iv,5)<0.02)::DOUBLE FROM iv UNION ALL SELECT 'loans','low_variance_columns', 0 UNION ALL SELECT 'loans','dpd_columns', 0 UNION ALL SELECT 'loans','unlogged_steps', 1) """


@REG.query("n2_feature_rules", _N2 + f"SELECT entity, rule_id, stage, severity, value FROM ({_flag_sql('feature')})")
def _(spark, d):
    from loanforge.operators.features import information_value, near_constant
    from loanforge.operators.profile import high_correlation

    f = feature_table(spark, d)
    parts = [
        ("high_corr_pairs", high_correlation(f, NUMERIC, 0.9).agg(F.count(F.lit(1)).cast("double").alias("value"))),
        ("low_iv_columns", information_value(f, NUMERIC, CATEGORICAL).agg(F.count_if(F.col("iv") < 0.02).cast("double").alias("value"))),
        ("low_variance_columns", near_constant(f, NUMERIC).agg(F.count_if("near_constant").cast("double").alias("value"))),
    ]
    m = None
    for name, p in parts:
        p = p.select(F.lit("loans").alias("entity"), F.lit(name).alias("metric"), "value")
        m = p if m is None else m.unionByName(p)
    fixed = [("loans", "dpd_columns", float(len(ru.named_like(f.columns, ru.DPD_WORDS)))), ("loans", "unlogged_steps", 1.0)]
    m = m.unionByName(spark.createDataFrame(fixed, "entity string, metric string, value double"))
    return ru.flags(m, "feature").select("entity", "rule_id", "stage", "severity", "value")


_FOLD = """, fo AS (SELECT *, CAST(('0x'||substr(md5(CAST(key AS VARCHAR)||'f42'),1,13))::BIGINT%5 AS INTEGER) AS fold FROM scored),
 fg AS (SELECT grp, fold, p AS s, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM fo GROUP BY 1,2,3),
 fl AS (SELECT *, sum(pos) OVER (PARTITION BY grp, fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(pos) OVER (PARTITION BY grp, fold) AS tp, sum(neg) OVER (PARTITION BY grp, fold) AS tn FROM fg),
 fa AS (SELECT grp, fold, sum(neg*(cp-pos*0.5::DOUBLE))/max(tp*tn) AS auc FROM fl GROUP BY 1,2),
 cv AS (SELECT grp, avg(auc) AS m, stddev_pop(auc) AS s FROM fa GROUP BY grp)"""


def fold_metrics(spark, d):
    """Mean and deviation of the score's AUC over five key-hash folds per group."""
    s = fold_column(scored_loans(spark, d), ["key"], 5)
    g = ev.score_ladder(s, by=["grp", "fold"]).groupBy("grp", "fold").agg(ev.auc_column().alias("auc"))
    return g.groupBy("grp").agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))


_N3 = W + METRICS_SQL.replace("mt AS (", "mx AS (") + _FOLD + """, im AS (SELECT grp, greatest(count(*) FILTER (y=0), count(*) FILTER (y=1))/least(count(*) FILTER (y=0), count(*) FILTER (y=1))::DOUBLE AS r FROM scored GROUP BY grp),
 mt AS (SELECT grp AS entity, 'cv_std' AS metric, s AS value FROM cv UNION ALL SELECT cv.grp, 'cv_test_gap', abs(m-roc_auc) FROM cv JOIN lm ON lm.grp=cv.grp UNION ALL SELECT grp,'cv_done',1 FROM cv
 UNION ALL SELECT grp,'model_named',1 FROM cv UNION ALL SELECT grp,'models_compared',0 FROM cv UNION ALL SELECT grp,'imbalance_unmitigated', r FROM im) """


@REG.query("n3_training_rules", _N3 + f"SELECT entity, rule_id, stage, severity, round(value,6) AS value FROM ({_flag_sql('training')})")
def _(spark, d):
    s = scored_loans(spark, d)
    n0, n1 = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    wide = (
        fold_metrics(spark, d)
        .join(ev.ladder_metrics(s, ["grp"]).select("grp", "roc_auc"), "grp")
        .join(s.groupBy("grp").agg((F.greatest(n0, n1) / F.least(n0, n1)).alias("imbalance_unmitigated")), "grp")
        .withColumns({"cv_test_gap": F.abs(F.col("cv_mean") - F.col("roc_auc")), "cv_done": F.lit(1), "model_named": F.lit(1), "models_compared": F.lit(0)})
    )
    m = ru.wide_to_metrics(wide, "grp", ["cv_std", "cv_test_gap", "cv_done", "model_named", "models_compared", "imbalance_unmitigated"])
    return ru.flags(m, "training").select("entity", "rule_id", "stage", "severity", F.round("value", 6).alias("value"))


@REG.query("n4_evaluation_rules", W + _MT + f"SELECT entity, rule_id, stage, severity, value FROM ({_flag_sql('evaluation')})")
def _(spark, d):
    return ru.flags(group_metrics(spark, d), "evaluation").select("entity", "rule_id", "stage", "severity", "value")


@REG.query(
    "n5_rule_evaluation",
    W + _MT + f"""SELECT e.entity, rule_id, stage, rl.metric, operator, threshold, value, CASE WHEN value IS NULL AND operator<>'is_present' THEN 'NOT_VERIFIABLE' WHEN {_FAIL} THEN 'FLAG' ELSE 'PASS' END AS status FROM (SELECT DISTINCT entity FROM mt) e CROSS JOIN {_rules_values()}
 LEFT JOIN mt m ON m.entity=e.entity AND m.metric=rl.metric""",
)
def _(spark, d):
    return ru.evaluate_rules(group_metrics(spark, d), ru.RULES).select("entity", "rule_id", "stage", "metric", "operator", "threshold", "value", "status")


_N_EVAL = sum(r.stage == "evaluation" for r in ru.RULES)


@REG.query(
    "n6_compliance_report",
    W + _MT + f""", f AS ({_flag_sql('evaluation')}), g AS (SELECT e.entity, count(*) FILTER (severity='high') AS h, count(*) FILTER (severity='medium') AS m, count(*) FILTER (severity='low') AS l, count(rule_id) AS n
  FROM (SELECT DISTINCT entity FROM mt UNION ALL SELECT 'UNFLAGGED') e LEFT JOIN f ON f.entity=e.entity GROUP BY 1)
 SELECT entity, h AS high_severity, m AS medium_severity, l AS low_severity, {_N_EVAL} AS total_rules, n AS rules_flagged, {_N_EVAL}-n AS rules_passed, round(greatest(({_N_EVAL}-n)/{_N_EVAL}.0::DOUBLE*100,0),1) AS compliance_score,
 CASE WHEN h>0 THEN 'FAIL' WHEN m>0 THEN 'WARN' ELSE 'PASS' END AS overall_status FROM g""",
)
def _(spark, d):
    m = group_metrics(spark, d)
    entities = m.select("entity").distinct().unionByName(spark.range(1).select(F.lit("UNFLAGGED").alias("entity")))
    return ru.compliance_report(ru.flags(m, "evaluation"), entities, _N_EVAL)


@REG.query(
    "n6_severity_rollup",
    W + _MT + f", f AS ({_flag_sql('evaluation')}) SELECT entity, stage, severity, count(*) AS n FROM f GROUP BY ROLLUP (entity, stage, severity) HAVING entity IS NOT NULL",
)
def _(spark, d):
    return ru.severity_rollup(ru.flags(group_metrics(spark, d), "evaluation"))


def inventory(spark, d):
    """One model per nation: estimator by key, size, imbalance, ladder metrics."""
    s = scored_loans(spark, d).join(
        load_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), "key"
    ).join(load_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("model_id")), "o_custkey")
    n0, n1 = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    size = s.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_samples"), (F.greatest(n0, n1) / F.least(n0, n1)).alias("class_imbalance_ratio"))
    lad = ev.ladder_metrics(s, ["model_id"]).select("model_id", "roc_auc")
    rec = ev.threshold_metrics(s, 0.2, ["model_id"]).select("model_id", "recall")
    k = F.col("model_id") % 4
    return size.join(lad, "model_id").join(rec, "model_id").withColumns(
        {
            "model_name": F.when(k == 0, "XGBoost").when(k == 1, "Random Forest").when(k == 2, "Logistic Regression").otherwise("Scorecard"),
            "explainability_done": F.col("model_id") % 2 == 0, "use_cv": F.col("model_id") % 3 == 0,
            "multiple_models_compared": F.col("model_id") % 5 == 0, "features_added": F.col("model_id"),
        }
    )


INV = W + """, si AS (SELECT s.*, c_nationkey AS model_id FROM scored s JOIN orders ON o_orderkey=key JOIN customer ON c_custkey=o_custkey),
 ig AS (SELECT model_id, p AS s, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM si GROUP BY 1,2),
 il AS (SELECT *, sum(pos) OVER (PARTITION BY model_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(pos) OVER (PARTITION BY model_id) AS tp, sum(neg) OVER (PARTITION BY model_id) AS tn FROM ig),
 ia AS (SELECT model_id, sum(neg*(cp-pos*0.5::DOUBLE))/max(tp*tn) AS roc_auc FROM il GROUP BY 1),
 ic AS (SELECT model_id, count(*) AS n_samples, greatest(count(*) FILTER (y=0), count(*) FILTER (y=1))/least(count(*) FILTER (y=0), count(*) FILTER (y=1))::DOUBLE AS imb, round(count(*) FILTER (y=1 AND p>=0.2::DOUBLE)/count(*) FILTER (y=1)::DOUBLE,4) AS recall FROM si GROUP BY 1),
 tier AS (SELECT ic.model_id, CASE ic.model_id%4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN n_samples>10000 THEN 3 WHEN n_samples>1000 THEN 2 ELSE 1 END + CASE WHEN imb>5 THEN 2 WHEN imb>2 THEN 1 ELSE 0 END
  + CASE WHEN roc_auc<0.7 THEN 3 WHEN roc_auc<0.8 THEN 1 ELSE 0 END + CASE WHEN recall<0.6 THEN 2 ELSE 0 END + CASE WHEN ic.model_id%2=0 THEN 0 ELSE 2 END + CASE WHEN ic.model_id%3=0 THEN 0 ELSE 1 END + CASE WHEN ic.model_id%5=0 THEN 0 ELSE 1 END
  + CASE WHEN ic.model_id>10 THEN 1 ELSE 0 END AS risk_score FROM ic JOIN ia ON ia.model_id=ic.model_id),
 tiers AS (SELECT model_id, risk_score, CASE WHEN risk_score>=10 THEN 1 WHEN risk_score>=6 THEN 2 ELSE 3 END AS tier FROM tier)"""


@REG.query("n7_risk_tier", INV + " SELECT * FROM tiers")
def _(spark, d):
    return ru.risk_tier(inventory(spark, d)).select("model_id", "risk_score", "tier")


_N8 = "WITH " + FEATURES + ", x AS (SELECT key, ts, y AS \"default\", acctbal, price, sparse, late_count, price_half AS interest_rate, price AS recovery_amount, segment FROM feats)" + """,
 m AS (SELECT count(*) AS n, greatest(1-count(acctbal)/count(*)::DOUBLE, 1-count(sparse)/count(*)::DOUBLE, 1-count(late_count)/count(*)::DOUBLE) AS mm,
  floor((epoch_us(max(ts))-epoch_us(min(ts)))/86400000000.0::DOUBLE)/365.25::DOUBLE AS span, least(count(*) FILTER ("default"=0), count(*) FILTER ("default"=1))/greatest(count(*) FILTER ("default"=0), count(*) FILTER ("default"=1))::DOUBLE AS ratio FROM x),
 du AS (SELECT sum(k-1)/sum(k)::DOUBLE AS dup FROM (SELECT count(*) AS k FROM x GROUP BY key, ts, "default", acctbal, price, sparse, late_count, interest_rate, recovery_amount, segment)), lk AS (SELECT 1+count(*) FILTER (abs(r)>0.95 AND c<>'recovery_amount') AS n FROM (""" + union(
    f"SELECT '{c}' AS c, corr({c},\"default\") AS r FROM x WHERE {c} IS NOT NULL" for c in ("key", "acctbal", "price", "sparse", "late_count", "interest_rate", "recovery_amount")
) + """)), r AS (SELECT '2.1' AS check_id, 'HIGH' AS severity, n::DOUBLE AS value, 'PASS' AS status FROM m
 UNION ALL SELECT '2.2','HIGH',round(mm,6), CASE WHEN mm>0.2 THEN 'FAIL' WHEN mm>0.1 THEN 'WARN' ELSE 'PASS' END FROM m UNION ALL SELECT '2.3','HIGH',1,'WARN' UNION ALL SELECT '2.4','MEDIUM',1,'PASS'
 UNION ALL SELECT '2.5','HIGH',round(span,6), CASE WHEN span>=5 THEN 'PASS' WHEN span>=3 THEN 'WARN' ELSE 'FAIL' END FROM m UNION ALL SELECT '2.8','HIGH',n::DOUBLE, CASE WHEN n>0 THEN 'FAIL' ELSE 'PASS' END FROM lk
 UNION ALL SELECT '2.9','LOW',round(dup,6), CASE WHEN dup>0.01 THEN 'FAIL' WHEN dup>0.001 THEN 'WARN' ELSE 'PASS' END FROM du UNION ALL SELECT '2.10','MEDIUM',round(ratio,6), CASE WHEN ratio<0.1 THEN 'FAIL' WHEN ratio<0.33 THEN 'WARN' ELSE 'PASS' END FROM m)"""


def validation_checks(spark, d):
    f = feature_table(spark, d).select(
        "key", "ts", F.col("y").alias("default"), "acctbal", "price", "sparse", "late_count", F.col("price_half").alias("interest_rate"),
        F.col("price").alias("recovery_amount"), "segment",
    )
    return ru.validation_data_checks(f, "default", "ts")


@REG.query("n8_validation_data_checks", _N8 + " SELECT check_id, 'Stage 2: Data Validation' AS stage, severity, value, status FROM r")
def _(spark, d):
    return validation_checks(spark, d)


# ---- documents -----------------------------------------------------------

# Heading and prose added to every document by its number, so that the rules have something to find.
PHRASES = [
    "Purpose and scope: the model covers the retail portfolio. The developer must document every assumption and limitation.",
    "The challenger model is a benchmark; rationale and justification are given. Calibration uses the through the cycle method.",
    "Staging follows SICR with a 30 DPD backstop and expected credit loss over the lifetime. Validation is required to review the scenario.",
    "Feature selection used information value and WOE binning. Model risk, data leakage and the default definition are addressed.",
]


def _phrase(i: int) -> str:
    return PHRASES[i].replace("'", "''")


def model_docs(spark, d):
    t = spread(load_table(spark, d, "documents").select("doc_id", "text", "source"))
    k = F.col("doc_id") % 4
    phrase = F.lit(PHRASES[3])
    for i in (2, 1, 0):
        phrase = F.when(k == i, F.lit(PHRASES[i])).otherwise(phrase)
    return t.select(
        "doc_id",
        "source",
        F.concat(
            F.lit("# Overview\n"), phrase, F.lit("\n\nMODEL PERFORMANCE\nROC-AUC: 0."), (70 + F.col("doc_id") % 25).cast("string"),
            F.lit(". Gini = 0."), (40 + F.col("doc_id") % 40).cast("string"), F.lit(" and recall 1.70.\n\n3.1 Detail\n"),
            F.regexp_replace("text", "\n", "\n\n"),
        ).alias("text"),
    )


DOCS = "docs AS (SELECT doc_id, source, '# Overview'||chr(10)||CASE doc_id%4 " + " ".join(f"WHEN {i} THEN '{_phrase(i)}'" for i in range(3)) + f" ELSE '{_phrase(3)}' END" + """
 ||chr(10)||chr(10)||'MODEL PERFORMANCE'||chr(10)||'ROC-AUC: 0.'||(70+doc_id%25)||'. Gini = 0.'||(40+doc_id%40)||' and recall 1.70.'||chr(10)||chr(10)||'3.1 Detail'||chr(10)||replace(text,chr(10),chr(10)||chr(10)) AS text FROM documents)"""
_HEAD = r"(?:Principle|Section|Appendix|Annex|Article|Chapter)\s+\d+|\d+\.\d*\s+\S|[A-Z][A-Z ,\-]{5,}\s*$|#{1,3}\s"
CHUNKS = "WITH " + DOCS + f""", se AS (SELECT doc_id, source, string_split(regexp_replace(text,'(?m)^({_HEAD})',chr(1)||'\\1','g'),chr(1)) AS parts FROM docs),
 ss AS (SELECT doc_id, source, unnest(list_filter(list_transform(parts, lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: length(x)>0)) AS s, generate_subscripts(list_filter(list_transform(parts, lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: length(x)>0),1) AS si FROM se),
 wi AS (SELECT doc_id, source, si, s, unnest(range(0, CASE WHEN length(s)<=600 THEN 1 ELSE CAST(ceil((length(s)-600)/500.0::DOUBLE) AS BIGINT)+1 END)) AS w FROM ss),
 ck AS (SELECT doc_id, source, si, w, substr(regexp_replace(split_part(s,chr(10),1),'^\\s+|\\s+$','','g'),1,120) AS section, regexp_replace(substr(s,w*500+1,600),'^\\s+|\\s+$','','g') AS chunk FROM wi),
 chunks AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY si, w)-1 AS INTEGER) AS chunk_index, section, chunk FROM ck WHERE length(chunk)>0)"""


@REG.query("o1_section_chunks", CHUNKS + " SELECT doc_id, chunk_index, section, length(chunk) AS n, md5(chunk) AS h FROM chunks")
def _(spark, d):
    c = dc.section_chunks(model_docs(spark, d))
    return c.select("doc_id", "chunk_index", "section", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


_UNIT = "{{'done': CAST([] AS VARCHAR[]), 'cur': '', 's': {s}, 'sep': {sep}, 'force': {force}}}"
_STRIP = "regexp_replace({0},'^\\s+|\\s+$','','g')"
PARAGRAPHS = "WITH " + DOCS + f""", pa AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,'\\r\\n|\\r',chr(10),'g'),'\\n{{3,}}',chr(10)||chr(10),'g'),chr(10)||chr(10)), lambda x: {_STRIP.format("x")}), lambda x: length(x)>0) AS ps FROM docs),
 un AS (SELECT doc_id, source, flatten(list_transform(ps, lambda p: CASE WHEN length(p)<=800 THEN [{_UNIT.format(s="p", sep="chr(10)||chr(10)", force="false")}]
  ELSE list_transform(string_split(regexp_replace(p,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)), lambda x, i: {_UNIT.format(s="x", sep="' '", force="i=1")}) END)) AS us FROM pa),
 pk AS (SELECT doc_id, source, list_reduce(us, lambda a, u: CASE WHEN NOT u.force AND length(a.cur)+length(u.s)+length(u.sep)<=800 THEN {{'done': a.done, 'cur': {_STRIP.format("a.cur||u.sep||u.s")}, 's': '', 'sep': '', 'force': false}}
  ELSE {{'done': CASE WHEN a.cur<>'' THEN list_append(a.done,a.cur) ELSE a.done END, 'cur': u.s, 's': '', 'sep': '', 'force': false}} END, {_UNIT.format(s="''", sep="''", force="false")}) AS r FROM un),
 cs AS (SELECT doc_id, source, CASE WHEN r.cur<>'' THEN list_append(r.done,r.cur) ELSE r.done END AS c FROM pk),
 chunks AS (SELECT doc_id, source, CAST(i-1 AS INTEGER) AS chunk_index, CASE WHEN i=1 THEN c[i] ELSE {_STRIP.format("right(c[i-1],150)||chr(10)||chr(10)||c[i]")} END AS chunk FROM cs, unnest(range(1, len(c)+1)) AS t(i))"""


@REG.query("o2_paragraph_chunks", PARAGRAPHS + " SELECT doc_id, chunk_index, length(chunk) AS n, md5(chunk) AS h FROM chunks")
def _(spark, d):
    c = dc.paragraph_chunks(model_docs(spark, d))
    return c.select("doc_id", "chunk_index", F.length("chunk").cast("bigint").alias("n"), F.md5("chunk").alias("h"))


_SCORE = PARAGRAPHS + ", lo AS (SELECT *, lower(chunk) AS t FROM chunks), sc AS (SELECT *, round(greatest(0,least(CASE WHEN regexp_matches(chunk,'(?i)" + dc.OBLIGATION + "') THEN 0.45::DOUBLE ELSE 0 END + least(0.1::DOUBLE*(" + "+".join(
    f"CASE WHEN regexp_matches(t,'\\b{k.replace('.', '[.]?')}\\b') THEN 1 ELSE 0 END" for k in dc.REGULATORY_KEYWORDS
) + "),0.55::DOUBLE) - CASE WHEN regexp_matches(chunk,'(?im)" + dc.NOISE + "') THEN 0.3::DOUBLE ELSE 0 END,1)),6) AS score FROM lo)"


@REG.query("o3_relevant_chunks", _SCORE + " SELECT doc_id, chunk_index, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM sc WHERE score>=0.45)")
def _(spark, d):
    s = dc.scored_chunks(dc.paragraph_chunks(model_docs(spark, d)))
    return dc.relevant_chunks(s).select("doc_id", "chunk_index", "score", "rank")


def _kw(r) -> str:
    hits = "+".join(f"CASE WHEN contains(t,'{k}') THEN 1 ELSE 0 END" for k in r.keywords)
    return f"SELECT doc_id, '{r.id}' AS rule_id, '{r.severity}' AS severity, {hits} AS n_hits, {len(r.keywords)} AS n_keywords FROM lw"


KWSQL = "WITH " + DOCS + ", lw AS (SELECT doc_id, lower(text) AS t FROM docs), k AS (" + union(_kw(r) for r in dc.KEYWORD_RULES) + "), kw AS (SELECT *, CASE WHEN n_hits>=2 THEN 'PASS' WHEN n_hits>0 THEN 'WARN' ELSE 'FAIL' END AS status FROM k)"


@REG.query("o4_keyword_rules", KWSQL + " SELECT * FROM kw")
def _(spark, d):
    return dc.keyword_matches(model_docs(spark, d)).select("doc_id", "rule_id", "severity", "n_hits", "n_keywords", "status")


def _quote(keywords) -> str:
    cond = " OR ".join(f"contains(x,'{k}')" for k in keywords)
    return f"substr(regexp_replace(list_filter(string_split(t,'.'), lambda x: {cond})[1],'^\\s+|\\s+$','','g'),1,200)"


@REG.query("o5_first_sentence", "WITH " + DOCS + ", lw AS (SELECT doc_id, lower(text) AS t FROM docs), q AS (SELECT doc_id, " + _quote(["scenario", "calibration", "scope"]) + " AS quote FROM lw) SELECT * FROM q WHERE quote IS NOT NULL")
def _(spark, d):
    return dc.quotes(model_docs(spark, d), ["scenario", "calibration", "scope"])


def _stated(ps) -> str:
    one = lambda p: f"list_filter(list_transform(regexp_extract_all(t,'{p}',1), lambda v: TRY_CAST(v AS DOUBLE)), lambda v: v BETWEEN 0.01 AND 1.0)[1]"
    return "round(coalesce(" + ",".join(one(p) for p in ps) + "),4)" if len(ps) > 1 else f"round({one(ps[0])},4)"


STATED = "WITH " + DOCS + ", lw AS (SELECT doc_id, lower(text) AS t FROM docs), sm AS (SELECT doc_id, " + ", ".join(f"{_stated(ps)} AS {m}" for m, ps in dc.METRIC_PATTERNS) + " FROM lw)"


@REG.query("o6_stated_metrics", STATED + " SELECT * FROM sm")
def _(spark, d):
    return dc.stated_metrics(model_docs(spark, d))


@REG.query(
    "o7_nearest_vectors",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS c, generate_subscripts(v,1) AS i FROM e), m AS (SELECT label, i, avg(c) AS c FROM x GROUP BY 1,2),
 q AS (SELECT label AS query, list(c ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT query, vec_id, list_cosine_similarity(v, c) AS s FROM e, q)
 SELECT query, vec_id, round(s,6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank<=8""",
)
def _(spark, d):
    e = load_table(spark, d, "embeddings")
    return dc.nearest(e, dc.centroids(e, "label"))


@REG.query("o8_chunk_table", CHUNKS + " SELECT doc_id||'::chunk_'||chunk_index AS chunk_id, source, section, length(chunk) AS n FROM chunks")
def _(spark, d):
    path = scratch_path(spark, "chunks")
    dc.build_chunk_table(model_docs(spark, d), path)
    return spark.read.parquet(path).select("chunk_id", "source", "section", F.length("chunk").alias("n"))


def _dcheck(c) -> str:
    cond = " OR ".join(f"contains(t,'{k}')" for k in c.keywords)
    return f"SELECT doc_id, '{c.id}' AS check_id, '{c.stage}' AS stage, '{c.severity}' AS severity, CASE WHEN {cond} THEN 'PASS' ELSE '{c.otherwise}' END AS status FROM lw"


DCHECK = "WITH " + DOCS + ", lw AS (SELECT doc_id, lower(text) AS t FROM docs), dk AS (" + union(_dcheck(c) for c in dc.DOCUMENT_CHECKS) + ")"


@REG.query("n9_document_checks", DCHECK + " SELECT * FROM dk")
def _(spark, d):
    return dc.document_checks(model_docs(spark, d)).select("doc_id", "check_id", "stage", "severity", "status")


@REG.query(
    "n10_verdict",
    DCHECK + """, g AS (SELECT doc_id, count(*) AS total, count(*) FILTER (status='PASS') AS pass, count(*) FILTER (status='WARN') AS warn, count(*) FILTER (status='FAIL') AS fail, count(*) FILTER (status='PENDING') AS pending,
 count(*) FILTER (status='FAIL' AND severity='HIGH') AS high_fails, count(*) FILTER (status='FAIL' AND severity='MEDIUM') AS medium_fails FROM dk GROUP BY 1)
 SELECT *, CASE WHEN high_fails=0 AND fail=0 AND pending=0 THEN 'PASS' WHEN high_fails<=2 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM g""",
)
def _(spark, d):
    return ru.verdict(dc.document_checks(model_docs(spark, d)), "doc_id")


@REG.query(
    "n10_stage_counts",
    DCHECK + " SELECT doc_id, stage, count(*) FILTER (status='PASS') AS pass, count(*) FILTER (status='WARN') AS warn, count(*) FILTER (status='FAIL') AS fail, count(*) FILTER (status='PENDING') AS pending, count(*) AS total FROM dk GROUP BY 1,2",
)
def _(spark, d):
    return ru.stage_counts(dc.document_checks(model_docs(spark, d)), "doc_id")


_TRV = "(VALUES " + ",".join(f"('{s}','{c}','{v}','{t}','{m}','{o}',{'NULL' if k is None else repr(k) + '::DOUBLE'})" for s, c, v, t, m, o, k in ru.TRACKER_RULES) + ") rl(stage, chk, severity, status, metric, operator, threshold)"
_TRACK = W + _MT + f""", tf AS (SELECT m.entity, stage, chk AS "check", severity, status, round(value,6) AS observed, threshold FROM mt m JOIN {_TRV} ON rl.metric=m.metric WHERE {_FAIL})"""


@REG.query("n11_findings_tracker", _TRACK + " SELECT * FROM tf")
def _(spark, d):
    return ru.findings_tracker(group_metrics(spark, d))


@REG.query(
    "n11_decision",
    _TRACK + """, en AS (SELECT grp AS entity, CASE WHEN count(*)>3000 THEN 1 WHEN count(*)>2950 THEN 2 ELSE 3 END AS tier FROM scored GROUP BY grp),
 g AS (SELECT en.entity, max(tier) AS tier, count(*) FILTER (severity='HIGH' AND status='FAIL') AS h, count(*) FILTER (severity='MEDIUM') AS m, count("check") AS t FROM en LEFT JOIN tf ON tf.entity=en.entity GROUP BY 1)
 SELECT entity, tier, h AS high_count, m AS medium_count, t AS total_count, greatest(t-h-m,0) AS low_count, CASE WHEN h=0 AND m<=2 THEN 'APPROVED' WHEN h<=2 THEN 'CONDITIONALLY APPROVED' ELSE 'REJECTED' END AS verdict,
 CASE tier WHEN 1 THEN 'Monthly' WHEN 2 THEN 'Quarterly' ELSE 'Semi-annually' END AS monitoring_frequency, CASE tier WHEN 1 THEN 'annual' WHEN 2 THEN '18-monthly' ELSE 'two-yearly' END AS revalidation FROM g""",
)
def _(spark, d):
    n = F.count(F.lit(1))
    en = scored_loans(spark, d).groupBy(F.col("grp").alias("entity")).agg(F.when(n > 3000, 1).when(n > 2950, 2).otherwise(3).alias("tier"))
    return ru.decision(ru.findings_tracker(group_metrics(spark, d)), en)


_RS = "rsrc AS (SELECT * FROM (VALUES " + ",".join(f"('{r.id}','{r.source}','{r.principle}')" for r in dc.KEYWORD_RULES) + ") t(rule_id, source, principle))"


@REG.query(
    "n13_framework_filter",
    KWSQL + ", " + _RS + """ SELECT doc_id, kw.rule_id, status FROM kw JOIN rsrc ON rsrc.rule_id=kw.rule_id WHERE contains(lower(source),'ifrs 9') OR contains(lower(principle),'ifrs 9') OR contains(lower(source),'ifrs9')
 OR contains(lower(source),'rbi') OR contains(lower(principle),'rbi') OR contains(lower(principle),'chapter iv')""",
)
def _(spark, d):
    m = dc.keyword_matches(model_docs(spark, d))
    src = F.create_map(*[F.lit(x) for r in dc.KEYWORD_RULES for x in (r.id, r.source)])
    pri = F.create_map(*[F.lit(x) for r in dc.KEYWORD_RULES for x in (r.id, r.principle)])
    keep = ru.matches_frameworks(F.element_at(src, F.col("rule_id")), F.element_at(pri, F.col("rule_id")), ["IFRS9", "RBI"])
    return m.where(keep).select("doc_id", "rule_id", "status")


_STG = "CASE event_type WHEN 'view' THEN 'data_validation' WHEN 'click' THEN 'conceptual_soundness' ELSE 'backtesting' END"
_STS = "CASE WHEN value<8 THEN 'In Progress' WHEN value<20 THEN 'Completed' ELSE 'Completed With Findings' END"


@REG.query(
    "n14_validation_status",
    f"""WITH e AS (SELECT user_id, {_STG} AS stage, ts, {_STS} AS status, CAST(json_extract(props,'$.k') AS BIGINT)%3 AS f FROM events),
 l AS (SELECT user_id, stage, arg_max(status, ts) AS s, arg_max(f, ts) AS f FROM e GROUP BY 1,2),
 w AS (SELECT user_id, coalesce(max(s) FILTER (stage='data_validation'),'Not Started') AS data_validation_status, coalesce(max(s) FILTER (stage='conceptual_soundness'),'Not Started') AS conceptual_soundness_status,
  coalesce(max(s) FILTER (stage='backtesting'),'Not Started') AS backtesting_status, CAST(coalesce(sum(f),0) AS BIGINT) AS findings_count FROM l GROUP BY 1)
 SELECT *, CASE WHEN data_validation_status LIKE 'Completed%' AND conceptual_soundness_status LIKE 'Completed%' AND backtesting_status LIKE 'Completed%' THEN CASE WHEN findings_count>0 THEN 'Validated With Findings' ELSE 'Validated' END ELSE 'Under Validation' END AS overall_status FROM w""",
)
def _(spark, d):
    e = load_table(spark, d, "events").select(
        "user_id", "ts",
        F.when(F.col("event_type") == "view", "data_validation").when(F.col("event_type") == "click", "conceptual_soundness").otherwise("backtesting").alias("stage"),
        F.when(F.col("value") < 8, "In Progress").when(F.col("value") < 20, "Completed").otherwise("Completed With Findings").alias("status"),
        (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("f"),
    )
    return ru.validation_status(e, "user_id", "stage", "ts", "status", "f")


@REG.query(
    "n15_inventory_merge",
    """WITH a AS (SELECT c_custkey AS id, c_name AS owner, CASE WHEN c_nationkey<12 THEN 'Unknown' ELSE c_mktsegment END AS purpose, 0 AS o FROM customer),
 b AS (SELECT o_custkey AS id, min('user') AS owner, min(o_orderpriority) AS purpose, 1 AS o FROM orders GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
 SELECT id, coalesce(arg_min(owner, o) FILTER (lower(owner) NOT IN ('unknown','user')), arg_min(owner, o)) AS owner, coalesce(arg_min(purpose, o) FILTER (lower(purpose) NOT IN ('unknown','user')), arg_min(purpose, o)) AS purpose, min(o) AS first_source FROM u GROUP BY id""",
)
def _(spark, d):
    c = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("owner"), F.when(F.col("c_nationkey") < 12, "Unknown").otherwise(F.col("c_mktsegment")).alias("purpose")
    )
    o = load_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("user").alias("owner"), F.min("o_orderpriority").alias("purpose"))
    return ru.merge_inventory([c, o], "id", ["owner", "purpose"])
