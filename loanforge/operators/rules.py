"""Regulatory rule checks over metric tables, verdicts, tiering, findings and inventory merge.

A check is data: ``(entity, metric, value)`` rows meet a small rule table. The
rules travel as literals inside one projection, so any number of entities is one
narrow pass after their metrics are grouped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.functions.expressions import row_repeats, safe_corr, with_totals


@dataclass(frozen=True)
class Rule:
    """A check that PASSES when ``metric operator threshold`` holds."""

    id: str
    source: str
    principle: str
    stage: str
    metric: str
    operator: str
    threshold: float | None
    severity: str


# Rules on numeric evidence, by stage.
RULES = [
    Rule("R01", "SS1/23", "3.2", "data", "max_missing", "<=", 0.20, "high"),
    Rule("R03", "SS1/23", "3.2", "data", "duplicate_rate", "<=", 0.05, "medium"),
    Rule("R04", "SS1/23", "3.2", "data", "id_columns", "<=", 0.0, "medium"),
    Rule("R05", "SS1/23", "3.3", "data", "n_rows", ">=", 500.0, "high"),
    Rule("MACRO_MISSING", "SS1/23 | IFRS 9", "Principle 1.3 | B5.5.49", "data", "macro_columns", ">=", 1.0, "high"),
    Rule("SS1_P3.5_TARGET_LEAKAGE", "SS1/23", "Principle 3.5", "data", "leakage_columns", "<=", 0.0, "high"),
    Rule("R06", "SS1/23", "3.3", "feature", "high_corr_pairs", "<=", 0.0, "medium"),
    Rule("R07", "SS1/23", "3.3", "feature", "low_variance_columns", "<=", 0.0, "low"),
    Rule("R08", "SS1/23", "3.4", "feature", "low_iv_columns", "<=", 0.0, "low"),
    Rule("IFRS9_5.5_DPD_MISSING", "IFRS 9", "Section 5.5", "feature", "dpd_columns", ">=", 1.0, "high"),
    Rule("SS1_P3.4_NO_DECISION_LOG", "SS1/23", "Principle 3.4", "feature", "unlogged_steps", "<=", 0.0, "medium"),
    Rule("R09", "SS1/23", "3.1", "training", "model_named", "is_true", None, "medium"),
    Rule("R10", "SS1/23", "3.3", "training", "models_compared", "is_true", None, "medium"),
    Rule("NO_CV", "SS1/23", "Principle 3.3", "training", "cv_done", "is_true", None, "high"),
    Rule("SS1_P3.3_CV_STABILITY", "SS1/23", "Principle 3.3", "training", "cv_std", "<=", 0.05, "medium"),
    Rule("SS1_P3.3_OVERFIT_GAP", "SS1/23", "Principle 3.3", "training", "cv_test_gap", "<=", 0.05, "medium"),
    Rule("SS1_P3.2_IMBALANCE_UNMITIGATED", "SS1/23", "Principle 3.2", "training", "imbalance_unmitigated", "<=", 10.0, "high"),
    Rule("SS1_P3.2_IMBALANCE_MITIGATED", "SS1/23", "Principle 3.2", "training", "imbalance_mitigated", "<=", 10.0, "low"),
    Rule("R13", "SS1/23", "4.1", "evaluation", "roc_auc", ">=", 0.70, "high"),
    Rule("R14", "SS1/23", "4.4", "evaluation", "recall", ">=", 0.60, "high"),
    Rule("R15", "SS1/23", "4.4", "evaluation", "precision", ">=", 0.40, "medium"),
    Rule("R16", "SS1/23", "4.4", "evaluation", "cv_test_gap", "<=", 0.10, "medium"),
    Rule("R18", "SS1/23", "5.1", "evaluation", "threshold", "==", 0.5, "medium"),
    Rule("R19", "SS1/23", "2.1", "evaluation", "residual_check_reported", "is_false", None, "medium"),
    Rule("R20", "SS1/23", "3.3", "evaluation", "pr_auc", ">=", 0.30, "medium"),
    Rule("R21", "IFRS 9", "5.5", "evaluation", "pd_output", "is_true", None, "high"),
    Rule("R22", "IFRS 9", "5.5.3", "evaluation", "staging_logic", "is_true", None, "high"),
    Rule("R24", "IFRS 9", "5.5.7", "evaluation", "sicr_flagged", "is_true", None, "high"),
    Rule("R25", "IFRS 9", "5.5.3", "evaluation", "ecl_estimated", "is_true", None, "high"),
    Rule("R26", "IFRS 7", "7.34", "evaluation", "concentration_analysis", "is_true", None, "medium"),
    Rule("R27", "IFRS 7", "7.36", "evaluation", "exposure_reported", "is_true", None, "medium"),
    Rule("R28", "IFRS 7", "7.37", "evaluation", "past_due_breakdown", "is_true", None, "medium"),
    Rule("IFRS9_B5.5_NO_PRAUC", "IFRS 9", "Appendix B5.5", "evaluation", "pr_auc", "is_present", None, "medium"),
    Rule("SS1_P3.3_NO_SENSITIVITY", "SS1/23", "Principle 3.3", "evaluation", "sensitivity_done", "is_present", None, "high"),
    Rule("NO_SHAP", "SS1/23", "Principle 3.5 | 4.2", "evaluation", "contributions_available", "is_present", None, "high"),
]
# Column-name parts.
MACRO_WORDS = ["gdp", "unemployment", "inflation", "interest", "cpi", "macro", "economic", "hpi", "house_price", "sentiment"]
VALIDATION_MACRO_WORDS = ["gdp", "unemployment", "hpi", "inflation", "rate", "macro", "cpi", "index", "interest", "house_price"]
DPD_WORDS = ["dpd", "days_past", "past_due", "overdue", "delinquent", "dq_"]
TARGET_WORDS = ["default", "bad", "charged_off", "write_off", "target", "label", "dpd_90", "is_bad"]
OUTCOME_WORDS = ["recovery", "loss_given", "write", "charged", "resolved", "post_default", "lgd", "ead_actual"]
FRAMEWORK_ALIASES = {
    "IFRS9": ["ifrs 9", "ifrs9"],
    "SS1/23": ["ss1/23"],
    "RBI": ["rbi", "chapter iv", "regulatory principles for model risk management"],
}
PLACEHOLDERS = ["", "unknown", "tbd", "n/a", "na", "none", "null", "not provided", "not specified", "user", "custom"]
OPERATORS = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<", "eq": "==", "ne": "!="}


def named_like(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def rule_holds(op: Column, value: Column, limit: Column) -> Column:
    """True when the check passes; unknown operators and missing comparisons pass."""
    o = op
    for a, b in OPERATORS.items():
        o = F.when(op == a, F.lit(b)).otherwise(o)
    test = (
        F.when(o == ">=", value >= limit)
        .when(o == "<=", value <= limit)
        .when(o == ">", value > limit)
        .when(o == "<", value < limit)
        .when(o == "==", value == limit)
        .when(o == "!=", value != limit)
        .when(o == "is_true", value != 0)
        .when(o == "is_false", value == 0)
        .when(o == "is_present", value.isNotNull())
    )
    return F.coalesce(test, F.lit(True))


def rule_structs(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("n"), F.lit(r.id).alias("rule_id"), F.lit(r.source).alias("source"), F.lit(r.principle).alias("principle"),
                F.lit(r.stage).alias("stage"), F.lit(r.metric).alias("metric"), F.lit(r.operator).alias("operator"),
                F.lit(r.threshold).cast("double").alias("threshold"), F.lit(r.severity).alias("severity"),
            )
            for i, r in enumerate(rules)
        ]
    )


def evaluate_rules(metrics: DataFrame, rules: Sequence[Rule], entity: str = "entity", not_verifiable: int | None = None) -> DataFrame:
    """Every rule of every entity with its value and PASS/FLAG status.

    Rules without a value are NOT_VERIFIABLE, except presence checks; all of
    them are kept, or ``not_verifiable`` per stage.
    """
    names = sorted({r.metric for r in rules})
    per = (
        metrics.where(F.col("metric").isin(names))
        .groupBy(entity)
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("double")))).alias("m"))
    )
    rows = per.select(entity, "m", F.explode(rule_structs(rules)).alias("r")).select(
        entity, "r.*", F.try_element_at("m", F.col("r.metric")).alias("value")
    )
    missing = F.col("value").isNull() & (F.col("operator") != "is_present")
    status = F.when(missing, "NOT_VERIFIABLE").when(rule_holds(F.col("operator"), F.col("value"), F.col("threshold")), "PASS").otherwise("FLAG")
    out = rows.withColumn("status", status)
    if not_verifiable is not None:
        w = Window.partitionBy(entity, "stage", "status").orderBy("n")  # at most the rule count per entity
        out = out.withColumn("k", F.row_number().over(w)).where((F.col("status") != "NOT_VERIFIABLE") | (F.col("k") <= not_verifiable)).drop("k")
    return out.withColumn("severity", F.when(F.col("status") == "NOT_VERIFIABLE", "medium").otherwise(F.col("severity"))).drop("n")


def flags(metrics: DataFrame, stage: str, entity: str = "entity", rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Flags raised for one stage."""
    return evaluate_rules(metrics, [r for r in rules if r.stage == stage], entity).where("status = 'FLAG'")


def wide_to_metrics(df: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    """Columns of a wide evidence table as ``(entity, metric, value)`` rows; nulls mean not reported."""
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.col(entity).alias("entity"), F.explode(items).alias("s")).select("entity", "s.*").where("value is not null")


def data_metrics(df: DataFrame, name: str, id_cols: Sequence[str], leakage_cols: Sequence[str]) -> DataFrame:
    """Evidence of the data rules for one table."""
    miss = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c__{c}") for c in df.columns])
    worst = F.greatest(*[1 - F.col(f"c__{c}") / F.col("n") for c in df.columns])
    dup = row_repeats(df, df.columns).select((F.col("repeats") / F.nullif("n_rows", F.lit(0))).alias("d"))
    wide = with_totals(miss.select(F.col("n").alias("n_rows"), worst.alias("max_missing")), dup)
    wide = wide.select(
        F.lit(name).alias("entity"), "n_rows", "max_missing", F.col("d").alias("duplicate_rate"),
        F.lit(len(id_cols)).alias("id_columns"), F.lit(len(named_like(df.columns, MACRO_WORDS))).alias("macro_columns"),
        F.lit(len(leakage_cols)).alias("leakage_columns"),
    )
    return wide_to_metrics(wide, "entity", ["n_rows", "max_missing", "duplicate_rate", "id_columns", "macro_columns", "leakage_columns"])


def severity_rollup(found: DataFrame, entity: str = "entity") -> DataFrame:
    """Flags per (stage, severity) with subtotals over stages and severities."""
    return (
        found.groupBy(entity, "stage", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup(entity, "stage", "severity")
        .agg(F.sum("n").alias("n"))
        .where(F.col(entity).isNotNull())
    )


def source_counts(found: DataFrame, entity: str = "entity") -> DataFrame:
    return found.groupBy(entity, "source").agg(F.count(F.lit(1)).alias("n"))


def compliance_report(found: DataFrame, entities: DataFrame, total_rules: int = len(RULES), entity: str = "entity") -> DataFrame:
    """Counts by severity, rules passed, score in percent and overall status of every entity.

    ``entities`` names all that were checked with ``total_rules`` rules, so those without a flag pass.
    """
    g = found.groupBy(entity).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_severity") for s in ("high", "medium", "low")], F.count(F.lit(1)).alias("rules_flagged")
    )
    counts = [c for c in g.columns if c != entity]
    g = entities.select(entity).distinct().join(g, entity, "left").fillna(0, counts)
    passed = F.lit(total_rules) - F.col("rules_flagged")
    return g.select(
        entity, "high_severity", "medium_severity", "low_severity", F.lit(total_rules).alias("total_rules"), "rules_flagged",
        passed.alias("rules_passed"),
        F.round(F.greatest(passed / F.lit(float(total_rules)) * 100, F.lit(0.0)), 1).alias("compliance_score"),
        F.when(F.col("high_severity") > 0, "FAIL").when(F.col("medium_severity") > 0, "WARN").otherwise("PASS").alias("overall_status"),
    )


def risk_tier(models: DataFrame) -> DataFrame:
    """Risk points and tier per model row of an inventory table.

    Reads model_name, n_samples, class_imbalance_ratio, roc_auc, recall,
    explainability_done, use_cv, multiple_models_compared, features_added.
    """
    m = F.col("model_name")
    points = {
        "complexity": F.when(m.isin("XGBoost", "LightGBM", "Neural Network"), 3)
        .when(m.isin("Random Forest", "Gradient Boosting"), 2)
        .when(m.isin("Logistic Regression", "Linear Regression", "Ridge"), 1)
        .otherwise(0),
        "materiality": F.when(F.col("n_samples") > 10000, 3).when(F.col("n_samples") > 1000, 2).when(F.col("n_samples") > 0, 1).otherwise(0),
        "data_quality": F.when(F.col("class_imbalance_ratio") > 5, 2).when(F.col("class_imbalance_ratio") > 2, 1).otherwise(0),
        "discrimination": F.when(F.col("roc_auc") < 0.70, 3).when(F.col("roc_auc") < 0.80, 1).otherwise(0),
        "recall_risk": F.when(F.col("recall") < 0.60, 2).otherwise(0),
        "explainability": F.when(F.coalesce(F.col("explainability_done"), F.lit(False)), 0).otherwise(2),
        "stability": F.when(F.coalesce(F.col("use_cv"), F.lit(False)), 0).otherwise(1),
        "challenger": F.when(F.coalesce(F.col("multiple_models_compared"), F.lit(False)), 0).otherwise(1),
        "feature_count": F.when(F.col("features_added") > 10, 1).otherwise(0),
    }
    scored = models.withColumns({f"pts_{k}": v for k, v in points.items()})
    total = sum((F.col(f"pts_{k}") for k in points), F.lit(0))
    tier = F.when(total >= 10, 1).when(total >= 6, 2).otherwise(3)
    return scored.withColumns({"risk_score": total, "tier": tier})


def monitoring_frequency(tier: Column) -> Column:
    return F.when(tier == 1, "Monthly").when(tier == 2, "Quarterly").otherwise("Semi-annually")


# ---- validation checks ---------------------------------------------------


def validation_data_checks(
    df: DataFrame, target: str, date_col: str | None, documented_definition: bool = False, documented_macro: bool = False
) -> DataFrame:
    """Data checks 2.1 to 2.5 and 2.8 to 2.10 of a validation data set with value and status."""
    cols = df.columns
    from loanforge.operators.profile import numeric_columns

    nums = [c for c in numeric_columns(df) if c != target]
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(c)).alias(f"c__{c}") for c in cols],
        *[safe_corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r__{c}") for c in nums],
        F.count_if(F.col(target) == 0).alias("n0"),
        F.count_if(F.col(target) == 1).alias("n1"),
        *([F.min(date_col).alias("d0"), F.max(date_col).alias("d1")] if date_col else []),
    )
    dup = row_repeats(df, cols).select((F.col("repeats") / F.nullif("n_rows", F.lit(0))).alias("dup"))
    b = with_totals(base, dup)
    worst = F.greatest(*[1 - F.col(f"c__{c}") / F.col("n") for c in cols])
    span = F.floor((F.unix_micros(F.col("d1").cast("timestamp")) - F.unix_micros(F.col("d0").cast("timestamp"))) / F.lit(86_400_000_000)) / F.lit(365.25) if date_col else F.lit(None).cast("double")
    leaked_names = set(named_like(cols, OUTCOME_WORDS))
    leaks = sum(
        (F.when(F.lit(c in leaked_names) | (F.abs(F.coalesce(F.nanvl(F.col(f"r__{c}"), F.lit(0.0)), F.lit(0.0))) > 0.95), 1).otherwise(0) for c in nums),
        F.lit(len([c for c in leaked_names if c not in nums])),
    )
    ratio = F.least("n0", "n1") / F.greatest("n0", "n1")
    has_target, has_macro = bool(named_like(cols, TARGET_WORDS)), bool(named_like(cols, VALIDATION_MACRO_WORDS))
    target_status = "PASS" if has_target and documented_definition else "WARN" if has_target else "FAIL"
    macro_status = "PASS" if has_macro else "WARN" if documented_macro else "FAIL"
    rows = [
        ("2.1", "HIGH", F.col("n").cast("double"), F.lit("PASS")),
        ("2.2", "HIGH", worst, F.when(worst > 0.20, "FAIL").when(worst > 0.10, "WARN").otherwise("PASS")),
        ("2.3", "HIGH", F.lit(float(len(named_like(cols, TARGET_WORDS)))), F.lit(target_status)),
        ("2.4", "MEDIUM", F.lit(float(len(named_like(cols, VALIDATION_MACRO_WORDS)))), F.lit(macro_status)),
        ("2.5", "HIGH", span, F.when(span.isNull(), "WARN").when(span >= 5, "PASS").when(span >= 3, "WARN").otherwise("FAIL")),
        ("2.8", "HIGH", leaks.cast("double"), F.when(leaks > 0, "FAIL").otherwise("PASS")),
        ("2.9", "LOW", F.col("dup"), F.when(F.col("dup") > 0.01, "FAIL").when(F.col("dup") > 0.001, "WARN").otherwise("PASS")),
        ("2.10", "MEDIUM", ratio, F.when(ratio < 0.1, "FAIL").when(ratio < 0.33, "WARN").otherwise("PASS")),
    ]
    items = [
        F.struct(F.lit(i).alias("check_id"), F.lit("Stage 2: Data Validation").alias("stage"), F.lit(s).alias("severity"), F.round(v, 6).alias("value"), t.alias("status"))
        for i, s, v, t in rows
    ]
    return b.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def stage_counts(findings: DataFrame, entity: str = "entity") -> DataFrame:
    """PASS / WARN / FAIL / PENDING counts per entity and stage."""
    return findings.groupBy(entity, "stage").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "PENDING")], F.count(F.lit(1)).alias("total")
    )


def verdict(findings: DataFrame, entity: str = "entity") -> DataFrame:
    """Counts and verdict: PASS without fails or open checks, CONDITIONAL up to two high fails, else FAIL."""
    sev = F.upper("severity")
    g = findings.groupBy(entity).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "PENDING")],
        F.count_if((F.col("status") == "FAIL") & (sev == "HIGH")).alias("high_fails"),
        F.count_if((F.col("status") == "FAIL") & (sev == "MEDIUM")).alias("medium_fails"),
    )
    clean = (F.col("high_fails") == 0) & (F.col("fail") == 0)
    return g.withColumn(
        "verdict",
        F.when(clean & (F.col("pending") == 0), "PASS").when(clean, "CONDITIONAL").when(F.col("high_fails") <= 2, "CONDITIONAL").otherwise("FAIL"),
    )


# Findings raised from stage evidence (stage, check, severity, status, metric, operator of the PASS side, limit).
TRACKER_RULES = [
    ("Stage 1", "1.2 Model Inventory", "HIGH", "FAIL", "inventory_registered", "is_true", None),
    ("Stage 1", "1.4 Independence", "HIGH", "FAIL", "independence_confirmed", "is_true", None),
    ("Stage 2", "2.2 Missing Data", "HIGH", "FAIL", "max_missing", "<=", 0.20),
    ("Stage 2", "2.9 Duplicates", "MEDIUM", "WARN", "duplicate_rate", "<=", 0.01),
    ("Stage 6", "7.1 Calibration", "HIGH", "FAIL", "doc_calibration", "is_true", None),
    ("Stage 6", "7.2 IFRS 9 Staging", "HIGH", "FAIL", "doc_staging", "is_true", None),
    ("Stage 2", "3.4 Limitations", "HIGH", "FAIL", "doc_limitations", "is_true", None),
    ("Stage 2", "3.3 Assumptions", "MEDIUM", "FAIL", "doc_assumptions", "is_true", None),
    ("Stage 2", "2.4b Forward-Looking Documentation (MDD)", "MEDIUM", "FAIL", "doc_macro", "is_true", None),
    ("Stage 3", "4.2 AUC Replication", "HIGH", "FAIL", "auc_gap", "<=", 0.05),
    ("Stage 4", "5.1 ROC-AUC", "HIGH", "FAIL", "roc_auc", ">=", 0.70),
    ("Stage 4", "5.2 Recall", "HIGH", "FAIL", "recall", ">=", 0.60),
    ("Stage 4", "5.3 Gini", "HIGH", "FAIL", "gini", ">=", 0.40),
    ("Stage 4", "5.4 Brier", "MEDIUM", "FAIL", "brier_score", "<=", 0.25),
    ("Stage 4", "5.B Benchmarking", "MEDIUM", "WARN", "benchmark_lag", "<=", 0.02),
    ("Stage 5", "6.1 Sensitivity", "MEDIUM", "WARN", "abs_pd_change_pct", "<=", 50.0),
    ("Stage 6", "8.2 Fair Lending", "HIGH", "FAIL", "bias_auc_gap", "<=", 0.10),
]


def findings_tracker(metrics: DataFrame, entity: str = "entity") -> DataFrame:
    """Findings of all stages from the evidence that is present."""
    rules = [Rule(check, sev, status, stage, m, op, lim, sev) for stage, check, sev, status, m, op, lim in TRACKER_RULES]
    hit = evaluate_rules(metrics, rules, entity).where("status = 'FLAG'")
    return hit.select(
        entity, "stage", F.col("rule_id").alias("check"), "severity", F.col("principle").alias("status"), F.round("value", 6).alias("observed"), "threshold"
    )


def decision(findings: DataFrame, entities: DataFrame, entity: str = "entity", tier: str = "tier") -> DataFrame:
    """Approval decision and monitoring cadence per entity, entities without findings included."""
    g = findings.groupBy(entity).agg(
        F.count_if((F.col("severity") == "HIGH") & (F.col("status") == "FAIL")).alias("h"),
        F.count_if(F.col("severity") == "MEDIUM").alias("m"),
        F.count(F.lit(1)).alias("t"),
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = entities.join(g, entity, "left").select(entity, tier, n(F.col("h")).alias("high_count"), n(F.col("m")).alias("medium_count"), n(F.col("t")).alias("total_count"))
    t = F.col(tier)
    return out.select(
        "*",
        F.greatest(F.col("total_count") - F.col("high_count") - F.col("medium_count"), F.lit(0)).alias("low_count"),
        F.when((F.col("high_count") == 0) & (F.col("medium_count") <= 2), "APPROVED")
        .when(F.col("high_count") <= 2, "CONDITIONALLY APPROVED")
        .otherwise("REJECTED")
        .alias("verdict"),
        monitoring_frequency(t).alias("monitoring_frequency"),
        F.when(t == 1, "annual").when(t == 2, "18-monthly").otherwise("two-yearly").alias("revalidation"),
    )


def matches_frameworks(source: Column, principle: Column, frameworks: Sequence[str]) -> Column:
    """True when source or principle names any selected framework; all rules match an empty selection."""
    if not frameworks:
        return F.lit(True)
    aliases = [a for f in frameworks for a in FRAMEWORK_ALIASES.get(f, [f.lower()])]
    out = F.lit(False)
    for a in aliases:
        out = out | F.lower(source).contains(a) | F.lower(principle).contains(a)
    return out


# ---- inventory -----------------------------------------------------------


def overall_status(data: Column, conceptual: Column, backtesting: Column, findings: Column) -> Column:
    parts = [F.coalesce(c, F.lit("Not Started")) for c in (data, conceptual, backtesting)]
    done = [c.isin("Completed", "Completed With Findings") for c in parts]
    all_done = done[0] & done[1] & done[2]
    return F.when(all_done & (F.coalesce(findings, F.lit(0)) > 0), "Validated With Findings").when(all_done, "Validated").otherwise("Under Validation")


def validation_status(events: DataFrame, model: str, stage: str, ts: str, status: str, findings: str) -> DataFrame:
    """Latest status per (model, stage), turned into one status row per model."""
    both = F.struct(F.col(status).alias("s"), F.col(findings).alias("f"))  # of one event, also where times are equal
    last = events.groupBy(model, stage).agg(F.max_by(both, F.struct(F.col(ts).alias("t"), both.alias("b"))).alias("e")).select(model, stage, "e.*")
    names = ["data_validation", "conceptual_soundness", "backtesting"]
    wide = last.groupBy(model).agg(
        *[F.max(F.when(F.col(stage) == n, F.col("s"))).alias(f"{n}_status") for n in names], F.sum("f").cast("bigint").alias("findings_count")
    )
    cols = [F.col(f"{n}_status") for n in names]
    return wide.select(
        model, *[F.coalesce(c, F.lit("Not Started")).alias(f"{n}_status") for n, c in zip(names, cols)],
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"), overall_status(*cols, F.col("findings_count")).alias("overall_status"),
    )


def real_value(c: Column) -> Column:
    """Trimmed text, null for placeholders."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(PLACEHOLDERS), t)


def merge_inventory(sources: Sequence[DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """Union of record sets, one row per key; each field takes the first real value in source order,
    else the first given value."""
    parts = [s.select(key, F.lit(i).alias("__o"), *[F.col(f).cast("string").alias(f) for f in fields]) for i, s in enumerate(sources)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    pick = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("__o")))
    given = lambda f: F.when(F.trim(F.col(f)) != "", F.trim(F.col(f)))
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.coalesce(pick(real_value(F.col(f))), pick(given(f))).alias(f) for f in fields], F.min("__o").alias("first_source")
    )


def importance_agreement(replicated: DataFrame, stated: DataFrame, top: int = 5) -> DataFrame:
    """Top-five overlap, same first feature and mean normalised difference of two importance tables.

    Tables hold ``(feature, importance)``, one row per model feature.
    """
    def ranked(df: DataFrame, tag: str) -> DataFrame:
        w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
        return df.select("feature", F.col("importance").alias(tag), F.row_number().over(w).alias(f"{tag}_rank"))

    both = ranked(replicated, "rep").join(ranked(stated, "sta"), "feature", "full")
    common = F.col("rep").isNotNull() & F.col("sta").isNotNull()
    w = Window.partitionBy(F.lit(0))
    norm = lambda c: F.when(common, F.col(c)) / F.sum(F.when(common, F.col(c))).over(w)
    s = both.withColumns({"d": F.abs(norm("rep") - norm("sta"))}).agg(
        F.count_if((F.col("rep_rank") <= top) & (F.col("sta_rank") <= top)).alias("overlap"),
        (F.count_if((F.col("rep_rank") == 1) & (F.col("sta_rank") == 1)) > 0).alias("same_first"),
        F.count_if(common).alias("n_common"),
        F.avg("d").alias("mad"),
    )
    mad = F.when(F.col("n_common") >= 3, F.col("mad")).otherwise(1.0)
    share = F.col("overlap") / F.lit(float(top))
    return s.select(
        "overlap", "same_first", F.round(mad, 6).alias("mean_difference"),
        F.when((share >= 0.8) & F.col("same_first") & (mad < 0.15), "PASS").when((share >= 0.6) & (mad < 0.25), "WARN").otherwise("FAIL").alias("status"),
    )


def replication_checks(replicated: DataFrame, reported: DataFrame, entity: str = "entity") -> DataFrame:
    """Checks R4.2 to R4.4 and R4.8: replicated against reported metrics per entity.

    Inputs are ``(entity, metric, value)``; a check without a reported value is WARN or SKIP.
    """
    names = ["roc_auc", "gini", "ks", "accuracy", "precision", "recall", "f1", "cv_mean_auc"]

    def wide(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(entity).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(f"{tag}_{n}") for n in names])

    w = wide(replicated, "a").join(wide(reported, "b"), entity, "left")
    d = {n: F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) for n in names}
    rel = {n: F.when(F.col(f"b_{n}") == 0, F.abs(F.col(f"a_{n}"))).otherwise(d[n] / F.abs(F.col(f"b_{n}"))) for n in ("accuracy", "precision", "recall", "f1")}
    ok_gk = F.coalesce(d["gini"] <= 0.05, F.lit(True)) & F.coalesce(d["ks"] <= 0.03, F.lit(True))
    any_rel = F.coalesce(*rel.values()).isNotNull()
    bad_rel = F.lit(False)
    for v in rel.values():
        bad_rel = bad_rel | F.coalesce(v > 0.05, F.lit(False))
    worst_rel = F.greatest(*rel.values())
    rows = [
        ("R4.2", "high", d["roc_auc"], F.when(d["roc_auc"].isNull(), "WARN").when(d["roc_auc"] <= 0.03, "PASS").when(d["roc_auc"] <= 0.06, "WARN").otherwise("FAIL")),
        ("R4.3", "high", F.greatest(d["gini"], d["ks"]), F.when(F.col("b_gini").isNull() & F.col("b_ks").isNull(), "WARN").when(ok_gk, "PASS").otherwise("FAIL")),
        ("R4.4", "medium", worst_rel, F.when(~any_rel, "WARN").when(bad_rel, "FAIL").otherwise("PASS")),
        ("R4.8", "medium", d["cv_mean_auc"], F.when(d["cv_mean_auc"].isNull(), "SKIP").when(d["cv_mean_auc"] <= 0.02, "PASS").when(d["cv_mean_auc"] <= 0.04, "WARN").otherwise("FAIL")),
    ]
    items = [F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), F.round(v, 6).alias("difference"), t.alias("status")) for i, s, v, t in rows]
    return w.select(entity, F.explode(F.array(*items)).alias("r")).select(entity, "r.*")


def stability_checks(seed_aucs: Sequence[float], ablation: Mapping[str, float]) -> list[tuple[str, str, float | None, str]]:
    """Checks R4.5 and R4.6 from a handful of refits: (id, severity, observed, status)."""
    drop = max(ablation.values(), default=None)
    out = [("R4.5", "medium", drop, "SKIP" if drop is None else "PASS" if drop < 0.05 else "FAIL")]
    if len(seed_aucs) >= 2:
        mean = sum(seed_aucs) / len(seed_aucs)
        std = round((sum((a - mean) ** 2 for a in seed_aucs) / len(seed_aucs)) ** 0.5, 4)
        out.append(("R4.6", "medium", std, "PASS" if std < 0.02 else "FAIL"))
    else:
        out.append(("R4.6", "medium", None, "WARN"))
    return out
