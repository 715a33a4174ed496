"""Regression and multiclass models: closed forms, plain metrics, save and reload."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanforge.operators import models, tasks
from loanforge.operators.models import Roles


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        x, z, g = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.choice("uvw")
        amount = 100 + 20 * x - 5 * z + {"u": 0, "v": 10, "w": -10}[g] + rnd.gauss(0, 2)
        score = [0.0, 1.5 * x + (g == "v"), -1.5 * x + z]
        kind = max(range(3), key=lambda k: score[k] + rnd.gumbel() if hasattr(rnd, "gumbel") else score[k] - math.log(-math.log(rnd.random())))
        rows.append((i, x, z, g, amount, ["low", "mid", "top"][kind] if i % 97 else None))
    return spark.createDataFrame(rows, "key int, x double, z double, g string, amount double, kind string").cache()


def test_regression(spark, frame, tmp_path):
    roles = Roles("amount", ("key",), ("x", "z"), ("g",))
    train, test = frame.where("key % 3 > 0"), frame.where("key % 3 = 0")
    m = tasks.fit_task_model(train, roles, "regression")
    out = m.score(test)
    assert out.columns == ["key", "amount", "prediction"]
    met = {r["metric"]: r["value"] for r in tasks.regression_table(out, "amount").collect()}
    got = np.array([(r.amount, r.prediction) for r in out.collect()])
    e = got[:, 0] - got[:, 1]
    assert met["r2"] == pytest.approx(1 - (e**2).mean() / got[:, 0].var(), abs=1e-4) and met["r2"] > 0.95
    m.save(str(tmp_path / "r"))
    again = models.load_model(spark, str(tmp_path / "r"))
    assert again.task == "regression"
    assert again.score(test).exceptAll(out).count() == 0


def test_multiclass(spark, frame, tmp_path):
    roles = Roles("kind", ("key",), ("x", "z"), ("g",))
    m = tasks.fit_task_model(frame.where("key % 3 > 0"), roles, "multiclass")
    out = m.score(frame.where("key % 3 = 0"))
    rows = out.collect()
    assert m.classes == ("low", "mid", "top")
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.prediction == max(r.probabilities, key=r.probabilities.get) for r in rows)
    met = {r["metric"]: r["value"] for r in tasks.multiclass_metrics(out, "kind").collect()}
    known = [r for r in rows if r.kind is not None]
    assert met["accuracy"] == pytest.approx(sum(r.kind == r.prediction for r in known) / len(known), abs=1e-6) and met["accuracy"] > 0.5
    f1, auc = [], []
    for c in m.classes:
        hit, said, true = (sum(f(r) for r in known) for f in (lambda r: r.kind == r.prediction == c, lambda r: r.prediction == c, lambda r: r.kind == c))
        f1.append(2 * hit / (said + true))
        pos, neg = ([r.probabilities[c] for r in known if (r.kind == c) == side] for side in (True, False))
        auc.append(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert met["macro_f1"] == pytest.approx(np.mean(f1), abs=1e-6)
    assert met["roc_auc_ovr"] == pytest.approx(np.mean(auc), abs=1e-5)
    assert met["log_loss"] == pytest.approx(np.mean([-math.log(r.probabilities[r.kind]) for r in known]), abs=1e-6)
    m.save(str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    same = {r.key: r.probabilities["top"] for r in again.score(frame.where("key % 3 = 0")).collect()}
    assert same == pytest.approx({r.key: r.probabilities["top"] for r in rows})


def test_multiclass_minimises_the_weighted_loss(frame):
    """Against plain gradient descent on the same prepared rows."""
    roles = Roles("kind", ("key",), ("x", "z"))
    m = tasks.fit_task_model(frame, roles, "multiclass", params={"regParam": 0.0, "maxIter": 500, "tol": 1e-12})
    rows = m.prepared(frame.where("kind is not null"), ["kind"]).collect()
    x = np.array([[1.0, r["f_x"], r["f_z"]] for r in rows])
    y = np.array([m.classes.index(r["__keep_kind"]) for r in rows])
    w = len(y) / (3 * np.bincount(y))[y]
    b = np.zeros((3, 3))
    for _ in range(4000):
        p = np.exp(x @ b)
        p /= p.sum(1, keepdims=True)
        b -= 1.0 * x.T @ (w[:, None] * (p - np.eye(3)[y])) / w.sum()
    p = np.exp(x @ b)
    p /= p.sum(1, keepdims=True)
    got = {r.key: r.probabilities for r in m.score(frame.where("kind is not null"), ["key"]).collect()}
    keys = [r["key"] for r in frame.where("kind is not null").select("key").collect()]
    mine = np.array([[got[k][c] for c in m.classes] for k in sorted(keys)])
    order = np.argsort([r[0] for r in frame.where("kind is not null").select("key").collect()])
    assert np.abs(mine - p[order]).max() < 1e-3


def test_comparisons_and_refusals(frame):
    reg = tasks.compare_task_models(frame, Roles("amount", ("key",), ("x", "z"), ("g",)), "regression", ["Linear Regression", "Decision Tree Regressor"]).collect()
    assert {r.model for r in reg} == {"Linear Regression", "Decision Tree Regressor"} and {r.metric for r in reg} == {"r2", "mae", "mse", "rmse"}
    many = frame.withColumn("t", F.col("key").cast("string"))
    with pytest.raises(ValueError, match="classes"):
        tasks.fit_task_model(many, Roles("t", ("key",), ("x",)), "multiclass")
    with pytest.raises(ValueError, match="unknown task"):
        tasks.fit_task_model(many, Roles("t", ("key",), ("x",)), "ranking")
