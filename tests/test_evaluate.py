"""Closed-form checks of the evaluation, stress and fairness measures."""

import math

import pytest
from pyspark.sql import functions as F

from loanforge.operators import evaluate as ev
from loanforge.operators import stress
from loanforge.operators.splits import key_hash, oot_window_size, stratified_split


@pytest.fixture(scope="module")
def six(spark):
    y, p = [0, 1, 0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8, 0.3, 0.7]
    d = ["2023-01-05", "2023-01-20", "2023-02-05", "2023-02-20", "2023-03-05", "2023-03-20"]
    return spark.createDataFrame(list(zip(range(6), y, p, d)), "key int, y int, p double, d string").withColumn("ts", F.to_timestamp_ntz("d"))


def test_perfect_separation(six):
    m = {r["metric"]: r["value"] for r in ev.metric_table(six, 0.5).collect()}
    assert m["roc_auc"] == m["pr_auc"] == m["ks"] == m["accuracy"] == m["f1"] == 1.0
    assert m["brier_score"] == pytest.approx(sum((a - b) ** 2 for a, b in zip([0, 1, 0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8, 0.3, 0.7])) / 6, abs=1e-4)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert ev.auc_gini(df).first()["auc"] == 0.875


def test_best_threshold_takes_lowest_tie(six):
    b = ev.best_threshold(six).first()
    assert (b["threshold"], b["f1"]) == (0.31, 1.0)


def test_zero_division_gives_zero(six):
    r = ev.threshold_metrics(six, 2.0).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_roc_and_pr_end_points(six):
    roc = [(r["fpr"], r["tpr"]) for r in ev.roc_points(six).collect()]
    assert (0.0, 0.0) in roc and (1.0, 1.0) in roc
    pr = [(r["recall"], r["precision"]) for r in ev.pr_points(six).collect()]
    assert (0.0, 1.0) in pr and (1.0, 0.5) in pr


def test_temporal_periods(six):
    rows = {(r["freq"], r["period"]): r for r in ev.temporal_actual_vs_predicted(six, ["Monthly", "Quarterly", "Half-yearly", "Yearly"]).collect()}
    assert rows[("Monthly", "2023-02")]["n"] == 2
    assert rows[("Quarterly", "2023Q1")]["actual_rate"] == 0.5
    assert ("Half-yearly", "2023H1") in rows and ("Yearly", "2023") in rows


def test_psi_of_equal_samples_is_zero(spark):
    rows = [(s, i / 100) for s in ("train", "test") for i in range(100)]
    df = spark.createDataFrame(rows, "split string, p double")
    assert stress.psi_report(df).first()["psi_total"] == 0.0


def test_psi_empty_bin_uses_floor(spark):
    df = spark.createDataFrame([("train", 0.0), ("train", 1.0), ("test", 0.0), ("test", 0.0)], "split string, p double")
    bins = {r["bin"]: r["psi"] for r in stress.psi_bins(df).collect()}
    assert bins[9] == pytest.approx((0.0001 - 0.5) * math.log(0.0001 / 0.5))


def test_percent_unemployment_is_shifted_by_points(spark):
    df = spark.createDataFrame([(5.0,), (7.0,)], "unemployment_rate double")
    score = lambda t: t.withColumn("p", F.col("unemployment_rate") / 100)
    r = stress.macro_scenarios(df, score, stress.SHOCKS[:3]).first()
    assert r["pd_change"] == pytest.approx(0.03)


def test_directional_skip_without_driver(spark):
    df = spark.createDataFrame([(0.02, 1.0)], "gdp_growth double, other double")
    rows = {r["id"]: r["status"] for r in stress.directional_tests(df, lambda t: t.withColumn("p", 0.5 - F.col("gdp_growth"))).collect()}
    assert rows == {"6.9a": "SKIP", "6.9b": "PASS", "6.9c": "SKIP"}


def test_split_shares_and_repeatability(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = stratified_split(df, "y", ["key"])
    n = {(r["split"], r["y"]): r["count"] for r in a.groupBy("split", "y").count().collect()}
    assert n[("test", 1)] == 30 and n[("val", 1)] == 30 and n[("test", 0)] == 270
    b = stratified_split(df.repartition(7), "y", ["key"])
    assert a.exceptAll(b).count() == 0
    assert df.select(key_hash(["key"], 1).alias("h")).where("h < 0 or h >= power(2, 52)").count() == 0


@pytest.mark.parametrize("n,size", [(0, 0), (1, 0), (150, 75), (1000, 150), (100_000, 15_000)])
def test_oot_window(n, size):
    assert oot_window_size(n) == size
