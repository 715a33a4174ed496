"""Binning, weight of evidence, imputation and plan replay."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanforge.operators import features as fe
from loanforge.operators import prep
from loanforge.plans.fixtures import CATEGORICAL, NUMERIC, feature_table


def test_iv_of_two_by_two(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 50
    df = spark.createDataFrame(rows, "c string, y int")
    g = {"a": 10.5 / 61, "b": 50.5 / 61}
    b = {"a": 30.5 / 41, "b": 10.5 / 41}
    iv = sum((g[k] - b[k]) * math.log(g[k] / b[k]) for k in "ab")
    assert fe.information_value(df, [], ["c"]).first()["iv"] == pytest.approx(round(iv, 5))


def test_bucket_codes(spark):
    train = spark.createDataFrame([(float(i), "x" if i % 2 else "y") for i in range(100)], "v double, c string")
    specs = fe.fit_bucketers(train, ["v"], ["c"])
    other = spark.createDataFrame([(-5.0, "x"), (500.0, "z"), (None, None), (19.8, "y")], "v double, c string")
    got = [(r["v_bin"], r["c_bin"]) for r in fe.apply_bucketers(other, specs).collect()]
    assert got == [(0, 0), (4, -1), (-2, -1), (0, 1)]


def test_few_values_are_their_own_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    s = fe.fit_numeric_bucketers(df, ["v"])["v"]
    assert s.values == (1.0, 2.0)
    assert [r[0] for r in spark.createDataFrame([(2.0,), (3.0,)], "v double").select(s.code(F.col("v"))).collect()] == [1, -1]


def test_plan_ignores_other_splits(spark, sf):
    f = feature_table(spark, sf)
    train = f.where("key % 3 = 0")
    plan = fe.fit_features(train, NUMERIC, CATEGORICAL)
    again = fe.fit_features(train.union(f.where("false")), NUMERIC, CATEGORICAL)
    assert plan == again
    out = fe.apply_features(f, plan)
    assert out.count() == f.count()
    assert not set(plan.dropped(f.columns)) & set(out.columns)
    assert [c for c in plan.bins if f"{c}_bin" in out.columns] == list(plan.bins)
    assert ("price", "price_half") in [(a, b) for a, b, _ in plan.high_corr] and "price" not in out.columns


def test_hidden_columns_never_survive(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "dpd_90 int, orig_pd double, recovery_rate double, income double")
    assert fe.apply_features(df, fe.FeaturePlan()).columns == ["income"]


def test_domain_pairs_by_name():
    names = [i.name for i in fe.domain_pairs([], [], {}, ["ltv", "fico_score", "annual_income", "dti_pct"])]
    assert names == ["ltv_x_fico_score", "annual_income_x_dti_pct"]


def test_vif_of_independent_columns_is_one():
    assert fe.vif(np.eye(3)) == pytest.approx([1.0] * 3, abs=1e-5)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[rng.random((60, 3)) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    plan = prep.fit_knn(df, ["a", "b", "c"], ["a", "b", "c"], k=4)
    got = np.array([list(r)[1:] for r in prep.apply_knn(df, plan).orderBy("i").collect()], dtype=float)
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    for i, j in zip(*np.where(np.isnan(x))):
        d = []
        for m in range(60):
            both = ~np.isnan(z[i]) & ~np.isnan(z[m])
            if not np.isnan(z[m, j]) and both.any():
                d.append((3 / both.sum() * ((z[i] - z[m])[both] ** 2).sum(), m))
        near = [m for _, m in sorted(d)[:4]]
        want = z[near, j].mean() * np.nanstd(x, 0)[j] + np.nanmean(x, 0)[j] if near else np.nanmean(x, 0)[j]
        assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_chained_recovers_a_linear_column(spark):
    rows = [(float(i), float(i % 7), 2.0 * i + 3.0 * (i % 7) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    plan = prep.fit_chained(df, ["a", "b", "c"], ["c"], rounds=3)
    out = prep.apply_chained(df, plan).collect()
    assert max(abs(r["c"] - (2 * r["a"] + 3 * r["b"])) for r in out) < 0.05


def test_imputation_is_learned_on_train_only(spark, sf):
    f = feature_table(spark, sf)
    plan = prep.fit_imputation(f.where("key % 2 = 0"), NUMERIC, CATEGORICAL, method="median")
    out = prep.apply_imputation(f, plan)
    assert out.where("acctbal is null or prio is null or has_card is null or late_count is null").count() == 0
    assert out.where("sparse is null").count() > 0 and plan.treatments["sparse"] == "review_flag"


def test_yeo_johnson_lowers_skew(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in rng.exponential(2.0, 800) - 0.5], "x double")
    r = prep.recommend_transforms(df, ["x"])["x"]
    assert r["transform"] == "yeo_johnson" and abs(r["post_skew"]) < 0.3


def test_prep_plan_outputs(spark, sf):
    f = feature_table(spark, sf)
    plan = prep.fit_prep(f, NUMERIC, CATEGORICAL, ["opted_in"], ["ts"], {"price": "log1p"})
    out = prep.apply_prep(f, plan, ["key"])
    assert out.columns == ["key", *plan.output_columns()]
    assert "sparse" not in out.columns and "ts_dayofweek" in out.columns and "nation_ord" in out.columns
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert sum(nulls) == 0
    m = out.agg(F.avg("price"), F.stddev_pop("price")).first()
    assert m[0] == pytest.approx(0, abs=1e-6) and m[1] == pytest.approx(1, abs=1e-6)


def test_constant_columns_do_not_break_correlations(spark):
    from loanforge.operators import profile

    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 5.0), (1.0, 4.0, 5.5)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 1.0}
    assert profile.leakage_columns(df, ["a", "b"], "c").count() == 1


def chained_by_rows(x, targets, rounds, alpha=1e-3):
    """The same regressions on the rows themselves."""
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = (x - mean) / sd
    seen = ~np.isnan(z)
    f = np.where(seen, z, 0.0)
    for _ in range(rounds):
        for t in targets:
            others = [c for c in range(x.shape[1]) if c != t]
            a = np.column_stack([np.ones(len(f)), f[:, others]])
            on = seen[:, t]
            beta = np.linalg.solve(a[on].T @ a[on] + alpha * np.eye(a.shape[1]), a[on].T @ f[on, t])
            f[~on, t] = a[~on] @ beta
    return f * sd + mean


def test_chained_moments_equal_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([1e6 + base[:, 0], base[:, 1] * 50, base.sum(1) + rng.normal(size=400) * 0.3, base[:, 0] - base[:, 1] + rng.normal(size=400)])
    gone = rng.random(x.shape) < 0.25
    gone[:, 1] = False
    gone[0] = [True, False, True, True]
    x[gone] = np.nan
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double")
    want = chained_by_rows(x, [0, 2, 3], 6)
    for cells in (4_000_000, 50):  # on the driver; as a distributed table
        plan = prep.fit_chained(df, names, ["a", "c", "d"], rounds=6, tolerance=0.0, local_cells=cells)
        got = np.array([r[1:] for r in prep.apply_chained(df, plan).orderBy("i").collect()], float)
        assert np.abs((got - want) / np.nanstd(x, 0)).max() < 1e-6
    one_scan = prep.fit_chained.__globals__["pattern_moments"](df, names)._jdf.queryExecution().executedPlan().toString()
    assert one_scan.count("Scan") + one_scan.count("LocalTableScan") <= 2


def test_yeo_johnson_powers_of_greatest_likelihood(spark):
    rng = np.random.default_rng(5)
    cols = {
        "right": rng.exponential(2.0, 600), "left": -rng.exponential(2.0, 600), "far": np.exp(rng.normal(8, 2, 600)), "both": rng.standard_t(3, 600) * 10,
        "counts": rng.integers(0, 4, 600).astype(float), "same": np.full(600, 7.0), "steep": 1 - rng.pareto(8, 600) ** 0.1,
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())] + [(None,) * len(cols)], ", ".join(f"{c} double" for c in cols))
    lam = prep.fit_yeo_johnson_all(df, list(cols))

    def likelihood(x, m):
        with np.errstate(all="ignore"):
            up = np.log1p(x) if abs(m) < 1e-12 else ((x + 1) ** m - 1) / m
            down = -np.log1p(-x) if abs(m - 2) < 1e-12 else -((1 - x) ** (2 - m) - 1) / (2 - m)
            return -len(x) / 2 * np.log(np.where(x >= 0, up, down).var()) + (m - 1) * (np.sign(x) * np.log1p(abs(x))).sum()

    assert lam["same"] == 1.0
    for c, x in cols.items():
        if c != "same":
            best = likelihood(x, lam[c])
            assert best >= max(likelihood(x, m) for m in np.linspace(lam[c] - 6, lam[c] + 6, 241)) - 1e-9
            h = 1e-4
            slope = (likelihood(x, lam[c] + h) - likelihood(x, lam[c] - h)) / (2 * h)
            bend = (likelihood(x, lam[c] + h) + likelihood(x, lam[c] - h) - 2 * best) / h**2
            assert abs(slope / bend) < 1e-5
