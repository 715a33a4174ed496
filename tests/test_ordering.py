"""Distributed order statistics agree with numpy at any bucket size, with ties and skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanforge.operators import evaluate as ev
from loanforge.operators.ordering import average_ranks, exact_quantiles, order_statistics, score_ladder, typed_order_statistic


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(2, 5, 4000), 3)
    p[rng.random(4000) < 0.35] = 0.2  # one score holds a third of all rows
    y = (rng.random(4000) < p).astype(int)
    g = np.where(rng.random(4000) < 0.4, "a", "b")
    rows = [(i, int(a), float(b), str(c)) for i, (a, b, c) in enumerate(zip(y, p, g))]
    df = spark.createDataFrame(rows, "key bigint, y int, p double, grp string").cache()
    return df, y, p, g


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float((np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg)))


@pytest.mark.parametrize("rows_per_bucket", [50, 700, 10_000])
@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ladder_any_partitioning(scores, rows_per_bucket, parts):
    df, y, p, _ = scores
    lad = score_ladder(df.repartition(parts), rows_per_bucket=rows_per_bucket).orderBy(F.desc("score")).collect()
    assert [r["score"] for r in lad] == sorted(set(p), reverse=True)
    assert [r["cum_pos"] for r in lad] == list(np.cumsum([r["pos"] for r in lad]))
    assert lad[-1]["cum_neg"] == lad[0]["tot_neg"] == int((y == 0).sum())


@pytest.mark.parametrize("rows_per_bucket", [60, 10_000])
def test_auc_by_group(scores, rows_per_bucket):
    df, y, p, g = scores
    lad = score_ladder(df, by=["grp"], rows_per_bucket=rows_per_bucket)
    got = {r["grp"]: r["auc"] for r in lad.groupBy("grp").agg(ev.auc_column().alias("auc")).collect()}
    for k in ("a", "b"):
        assert got[k] == pytest.approx(brute_auc(y[g == k], p[g == k]), abs=1e-12)


@pytest.mark.parametrize("direct,rows_per_bucket", [(10**9, None), (0, 10_000), (0, 90)])
def test_quantiles_match_numpy(scores, direct, rows_per_bucket):
    df, y, p, _ = scores
    q = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    x = df.withColumn("x", F.when(F.col("key") % 3 != 0, F.col("key") * F.col("p")))
    got = exact_quantiles(x, ["p", "x"], q, direct_values=direct, rows_per_bucket=rows_per_bucket)
    assert got["p"] == pytest.approx(list(np.quantile(p, q)), abs=1e-12)
    v = (np.arange(4000) * p)[np.arange(4000) % 3 != 0]
    assert got["x"] == pytest.approx(list(np.quantile(v, q)), rel=1e-12)


def test_order_statistics_of_ties(scores):
    df, _, p, _ = scores
    got = order_statistics(df, {"p": [0, 1000, 1500, 3999]}, rows_per_bucket=100)
    assert [got[("p", k)] for k in (0, 1000, 1500, 3999)] == list(np.sort(p)[[0, 1000, 1500, 3999]])


@pytest.mark.parametrize("rows_per_bucket", [64, 10_000])
def test_average_ranks(spark, scores, rows_per_bucket):
    df, _, p, _ = scores
    counts = df.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    got = {r["p"]: r["avg_rank"] for r in average_ranks(counts, "p", rows_per_bucket=rows_per_bucket).collect()}
    order = np.sort(p)
    for v in (0.2, float(order[0]), float(order[-1])):
        where = np.flatnonzero(order == v) + 1
        assert got[v] == where.mean()


def test_gain_chart_splits_ties_by_key(spark, scores):
    df, y, p, _ = scores
    order = sorted(range(4000), key=lambda i: (-p[i], i))
    cum = np.cumsum(y[order])
    rows = ev.gain_lift(df).orderBy("decile").collect()
    for r in rows[1:]:
        cut = int(4000 * (r["decile"] / 100))
        assert r["model"] == pytest.approx(round(cum[cut - 1] / y.sum() * 100, 2), abs=0.011)
    assert rows[0]["model"] == 0.0 and rows[-1]["model"] == 100.0


def test_gain_chart_keeps_the_type_of_the_key(spark):
    big = 2**53
    rows = [(big + i, 1 if i >= 5 else 0, 0.5) for i in range(10)]
    got = ev.gain_lift(spark.createDataFrame(rows, "key bigint, y int, p double")).orderBy("decile").collect()
    assert [r["model"] for r in got] == [0.0] * 6 + [20.0, 40.0, 60.0, 80.0, 100.0]
    text = spark.createDataFrame([(f"k{k % 97:03d}{k}", y, p) for k, y, p in rows], "key string, y int, p double")
    order = [y for _, y in sorted((f"k{k % 97:03d}{k}", y) for k, y, _ in rows)]
    got = ev.gain_lift(text).orderBy("decile").collect()
    assert [r["model"] for r in got] == [round(sum(order[:i]) / 5 * 100, 2) for i in range(11)]


def test_typed_order_statistic(spark):
    words = [f"w{(i * 7919) % 1000:04d}" for i in range(1000)] + ["w0500"] * 200 + [None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    order = sorted(w for w in words if w)
    for rank in (0, 499, 600, 1199):
        assert typed_order_statistic(df, "w", rank, rows_at_once=50, cuts=5) == order[rank]


def test_empty_and_single_class(spark):
    one = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.8)], "key int, y int, p double")
    assert ev.auc_gini(one).first()["auc"] is None
    none = one.where("y = 7")
    assert score_ladder(none).count() == 0
    assert exact_quantiles(none, ["p"], [0.5], direct_values=0)["p"] == [None]


def test_both_quantile_ways_agree_to_the_bit(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    q = [i / 7 for i in range(8)]
    small = exact_quantiles(o, ["o_totalprice"], q)
    assert small == exact_quantiles(o, ["o_totalprice"], q, direct_values=0, rows_per_bucket=100)
