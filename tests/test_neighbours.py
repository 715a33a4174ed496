"""Nearest donors in cells are those of all pairs, with ties, repeated points, rare patterns of gaps and few donors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanforge.operators import neighbours as nb
from loanforge.operators import prep


def brute(q, donors, t, k):
    own = donors[~np.isnan(donors[:, t])]
    with np.errstate(invalid="ignore"):
        both = ~np.isnan(q) & ~np.isnan(own)
        d2 = np.where(both, np.square(q - own), 0.0).sum(axis=1) * len(q) / np.maximum(both.sum(axis=1), 1)
    found = sorted((a, v) for a, v, n in zip(d2, own[:, t], both.sum(axis=1)) if n)
    return found[:k]


def table(spark, x, name):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{name}{i} double" for i in range(x.shape[1]))).repartition(3)


@pytest.mark.parametrize("shape", ["smooth", "grid"])
@pytest.mark.parametrize("needs,groups", [(16, 64), (2, 2)])
def test_cells_give_the_neighbours_of_all_pairs(spark, monkeypatch, shape, needs, groups):
    for name, value in (("DONORS_PER_CELL", 60), ("SAMPLE_PER_CELL", 20), ("QUERIES_PER_BLOCK", 25), ("MAX_NEEDS", needs), ("MAX_GROUPS", groups)):
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(4)
    donors, q = rng.normal(size=(1500, 4)), rng.normal(size=(120, 4))
    if shape == "grid":  # many equal points and equal distances; one point holds a fifth of the donors
        donors, q = np.round(donors * 1.5), np.round(q * 1.5)
        donors[:300, :3] = 1.0
    donors[rng.random(donors.shape) < 0.25] = np.nan
    q[rng.random(q.shape) < 0.4] = np.nan
    q = np.unique(np.where(np.isnan(q), np.inf, q), axis=0)
    q[np.isinf(q)] = np.nan
    found = nb.nearest_by_vector(table(spark, q, "q"), table(spark, donors, "d"), 4, [0, 2], 5).collect()
    got = {(tuple(np.nan_to_num(r["w"], nan=9e9)), r["t"]): [(p["d"], p["v"]) for p in r["near"]] for r in found}
    assert len(got) == len(found)
    for row in q:
        for t in (0, 2):
            if np.isnan(row[t]) and not np.isnan(row).all():
                want = brute(row, donors, t, 5)
                assert np.array(got[(tuple(np.nan_to_num(row, nan=9e9)), t)]) == pytest.approx(np.array(want), abs=1e-12)


def test_small_boxes_within_a_cell_change_nothing():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(5000, 2)), rng.normal(size=(300, 2)) * 2
    x[:2000] = np.round(x[:2000])
    v = np.round(rng.normal(size=5000), 1)
    dist, value = nb.nearest_donors(q, x, v, 5)
    for i, r in enumerate(q):
        want = sorted(zip(np.square(r - x).sum(axis=1), v))[:5]
        assert np.array([dist[i], value[i]]).T == pytest.approx(np.array(want), abs=1e-12)


def test_fewer_donors_than_neighbours(spark):
    donors = table(spark, np.array([[1.0, 2.0], [np.nan, 5.0]]), "d")
    got = nb.nearest_by_vector(table(spark, np.array([[np.nan, 3.0]]), "q"), donors, 2, [0], 5).collect()
    assert [(p["d"], p["v"]) for p in got[0]["near"]] == [(2.0, 1.0)]


def test_a_query_meets_few_cells(spark, monkeypatch):
    """With 100 cells of donors and 200 queries not every pair of them meets."""
    monkeypatch.setattr(nb, "DONORS_PER_CELL", 200)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(20_000, 3)))], "i int, a double, b double, c double")
    df = df.withColumn("a", F.when(F.col("i") % 100 != 0, F.col("a")))
    seen = spark.sparkContext.accumulator(0)
    whole = nb.nearest_donors

    def counting(q, x, v, k, bound=None):
        seen.add(len(q) * len(x))
        return whole(q, x, v, k, bound)

    monkeypatch.setattr(nb, "nearest_donors", counting)
    plan = prep.fit_knn(df, ["a", "b", "c"], ["a"])
    out = prep.apply_knn(df, plan)
    assert out.where("a is null").count() == 0 and out.count() == 20_000
    assert 0 < seen.value < 200 * 19_800 / 5
