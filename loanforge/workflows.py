"""End-to-end jobs: profile a table, train and evaluate, stress a model, validate a portfolio.

Each returns named DataFrames; nothing runs until one of them is read, apart
from the small aggregates that learn plans.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanforge.functions.dates import FREQUENCIES
from loanforge.operators import evaluate as ev
from loanforge.operators import explain, fairness, joins, macro, models, profile, roles, rules, stress
from loanforge.operators.splits import split_stats, stratified_split


def profile_table(df: DataFrame, key: Sequence[str], target: str | None = None, as_of: dt.date | None = None) -> dict[str, DataFrame]:
    """Every profiling report of one table."""
    types = roles.detect_column_types(df)
    target = target or next(iter(roles.target_candidates(df, types)), None)
    num = [c for c in types["numeric"] if c in profile.numeric_columns(df) and c != target]
    cat = types["categorical"]
    out = {
        "column_types": roles.detected_types(df),
        "missingness": profile.missingness(df),
        "duplicates": profile.duplicate_rows(df),
        "dictionary": profile.data_dictionary(df, [*num, *cat]),
        "preview": profile.preview(df, key),
    }
    if num or cat:
        out["summary"] = profile.numeric_summary(df, num) if not cat else profile.categorical_summary(df, cat) if not num else profile.summary_statistics(df, num, cat)
    if num:
        out |= {"histograms": profile.histograms(df, num), "outliers": profile.iqr_outliers(df, num)}
    if len(num) > 1:
        out["correlation"] = profile.correlation_pairs(df, num)
    if types["datetime"]:
        native = [c for c in types["datetime"] if dict(df.dtypes)[c] != "string"]
        if native:
            out["dates"] = profile.date_integrity(df, native, as_of or dt.date.today())
    if target:
        out["classes"] = profile.class_distribution(df, target)
        if num and roles.task_type(df, target) == "binary":
            out["leakage"] = profile.leakage_columns(df, num, target)
    return out


def integrate_sources(
    base: DataFrame, tables: Mapping[str, DataFrame], specs: Sequence[joins.JoinSpec],
    series: DataFrame | None = None, names: Sequence[str] = (), date_col: str | None = None, lookback_days: int | None = 400,
) -> dict[str, DataFrame]:
    """Joined table with its step report, macro series attached on request, and the profile of the result."""
    table = joins.integrate(base, tables, specs)
    date_col = date_col or roles.pick_date_column(table.columns)
    if series is not None and date_col:
        table = macro.attach(table, date_col, series, names, lookback_days)
    out = {"table": table, "profile": profile.data_dictionary(table)}
    return out | {"report": joins.integration_report(base, tables, specs)} if specs else out


def evaluation_reports(scored: DataFrame, y: str = "y", p: str = "p", ts: str | None = None, threshold: float | None = None) -> dict[str, DataFrame]:
    """Curves, metrics, gates and stability over time of one scored table."""
    metrics = ev.metric_table(scored, threshold, y=y, p=p)
    out = {
        "metrics": metrics, "gates": ev.metric_gates(metrics), "threshold_sweep": ev.threshold_sweep(scored, y=y, p=p),
        "roc": ev.roc_points(scored, y, p), "pr": ev.pr_points(scored, y, p), "score_distribution": ev.score_distribution(scored, y=y, p=p),
        "calibration": ev.calibration(scored, y=y, p=p), "residuals": ev.heteroscedasticity(scored, y=y, p=p),
    }
    if ts:
        named = scored.select(F.col(ts).alias("ts"), F.col(y).alias("y"), F.col(p).alias("p"))
        out["periods"] = ev.temporal_actual_vs_predicted(named, FREQUENCIES)
        out["stability"] = ev.temporal_stability(named, FREQUENCIES)
    return out


def train_and_evaluate(
    df: DataFrame, cols: models.Roles, estimator: str = "Logistic Regression", params: Mapping | None = None, ts: str | None = None, seed: int = 42
) -> tuple[models.FittedModel, dict[str, DataFrame]]:
    """Split, fit on train, evaluate on test."""
    split = stratified_split(df, cols.target, cols.keys, seed=seed)
    model = models.fit_model(split.where("split = 'train'").drop("split"), cols, estimator, params, seed)
    keep = [*cols.keys, cols.target, *([ts] if ts else [])]
    scored = model.score(split.where("split = 'test'").drop("split"), keep)
    reports = evaluation_reports(scored, cols.target, "p", ts)
    reports["split"] = split_stats(split, cols.target)
    reports["importance"] = models.importance_table(df.sparkSession, model)
    return model, reports


def stress_suite(test: DataFrame, scorer: stress.Scorer, scored_splits: DataFrame | None = None, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scenarios and directional tests, plus stability and backtest where their tables are given."""
    out = {"scenarios": stress.macro_scenarios(test, scorer), "directional": stress.directional_tests(test, scorer)}
    if scored_splits is not None:
        out["psi"] = stress.psi_report(scored_splits)
    if scored is not None:
        out["backtest"] = stress.backtest(scored, FREQUENCIES)
        out["backtest_report"] = stress.backtest_report(scored, FREQUENCIES)
    return out


def validate_scores(scored: DataFrame, group: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Rule flags, compliance report, findings and group fairness of a scored table per group."""
    metrics = ev.metric_table(scored, threshold, [group]).withColumnRenamed(group, "entity")
    flags = rules.flags(metrics, "evaluation")
    return {
        "flags": flags, "report": rules.compliance_report(flags, metrics, sum(r.stage == "evaluation" for r in rules.RULES)), "findings": rules.findings_tracker(metrics),
        "groups": fairness.group_performance(scored, group), "bias": fairness.bias_check(scored, group),
    }


def explain_linear(df: DataFrame, key: str, coefficients: Mapping[str, float], p: str = "p") -> dict[str, DataFrame]:
    means = explain.column_means(df, list(coefficients))
    return {
        "global": explain.mean_abs_contribution(df, coefficients, means),
        "drivers": explain.top_drivers(df, key, coefficients, means),
        "reasons": explain.reason_codes(df, key, coefficients, p, means=means),
    }
