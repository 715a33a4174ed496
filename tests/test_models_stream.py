"""Model fit, persistence, replication loops and streaming results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanforge.operators import explain as xp
from loanforge.operators import models as md
from loanforge.plans.fixtures import CATEGORICAL, NUMERIC, feature_table, scored_loans
from loanforge.sources import runlog
from loanforge.streaming import monitor as mon

ROLES = md.Roles("y", ("key",), ("acctbal", "price", "late_count"), ("segment",), ("opted_in",), ("ts",))


@pytest.fixture(scope="module")
def table(spark, sf):
    return feature_table(spark, sf).cache()


def test_fit_score_save_load(spark, table, tmp_path):
    train, val, test = md.three_way(table, ROLES)
    assert train.count() + val.count() + test.count() == table.count()
    m = md.fit_model(train, ROLES)
    s = m.score(test)
    assert s.where("p is null or p < 0 or p > 1").count() == 0 and md.exact_auc(s, "y") > 0.55
    m.save(str(tmp_path / "m"))
    again = md.load_model(spark, str(tmp_path / "m")).score(test)
    assert s.join(again.withColumnRenamed("p", "q"), "key").where("abs(p - q) > 1e-12").count() == 0
    imp = md.importances(m)
    assert sum(v for _, v in imp) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown estimator"):
        md.fit_model(train, ROLES, "nope")


def test_test_rows_do_not_change_the_model(table):
    train, _, test = md.three_way(table, ROLES)
    a = md.fit_model(train, ROLES)
    assert a.plan == md.fit_model(train, ROLES).plan


def test_refit_with_feature_plan(table):
    r = md.replicate(table, md.Roles("y", ("key",), tuple(NUMERIC), tuple(CATEGORICAL)))
    assert r.scored.count() == r.test.count() and md.exact_auc(r.scored, "y") > 0.5
    assert any(c.endswith("_woe") for c in r.model.columns)


def test_a_stored_model_keeps_its_feature_plan(spark, table, tmp_path):
    r = md.replicate(table, md.Roles("y", ("key",), tuple(NUMERIC), tuple(CATEGORICAL)))
    assert r.model.features is not None and md.revived(md.plain(r.model.features)) == r.model.features
    r.model.save(str(tmp_path / "m"))
    again = md.load_model(spark, str(tmp_path / "m"))
    assert again.features == r.model.features
    assert again.score(r.test).exceptAll(r.model.score(r.test)).count() == 0


def test_loops(table):
    small = md.Roles("y", ("key",), ("acctbal", "price"))
    aucs = md.cross_validate(table, small, folds=3)
    assert len(aucs) == 3 and 0.5 < md.cv_summary(aucs)[0] <= 1
    assert set(md.ablation(table, small)) == {"acctbal", "price"}
    found = md.random_search(table, small, draws=2, folds=2)
    assert len(found) == 2 and found[0][1] >= found[1][1]


def test_contributions_sum_to_score_gap(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (2, 4.0, None)], "key int, a double, b double")
    d = xp.top_drivers(df, "key", {"a": 1.5, "b": -0.1})
    got = {(r["key"], r["feature"]): r["contribution"] for r in d.collect()}
    assert got == {(1, "a"): -1.5, (1, "b"): 0.0, (2, "a"): 1.5, (2, "b"): 0.0}


def test_stream_monitor_equals_batch(spark, sf, tmp_path):
    s = mon.event_time(scored_loans(spark, sf), ["ts"]).select("key", "ts", "y", "p")
    src = str(tmp_path / "in")
    s.repartition(4).write.parquet(src)
    ref = mon.fit_reference(s)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(src)
    mon.start_monitor(stream, ref, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = mon.latest_windows(spark, str(tmp_path / "out"))
    want = mon.monitor_report(mon.window_counts(s, ref), ref)
    assert got.count() == want.count()
    pairs = got.alias("g").join(want.alias("w"), ["window_start", "n", "status", "trigger"])
    assert pairs.count() == want.count()
    assert pairs.where("abs(g.psi - w.psi) > 2e-6 or abs(g.actual_dr - w.actual_dr) > 2e-6 or abs(g.gap - w.gap) > 2e-4").count() == 0


def test_stream_scoring_equals_batch(spark, table, tmp_path):
    roles = md.Roles("y", ("key",), ("acctbal", "price"))
    m = md.fit_model(table, roles)
    rows = table.select("key", "y", "acctbal", "price")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    mon.start_scoring(stream, m.score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(m.score(rows)).count() == 0 and got.count() == rows.count()


def test_event_stream_drops_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", t, "fit", "a"), ("1", t, "fit", "a"), ("2", t + dt.timedelta(hours=2), "fit", "b"), ("3", t, "score", "c")]
    e = spark.createDataFrame(rows, runlog.EVENT_SCHEMA)
    src = str(tmp_path / "in")
    e.limit(2).coalesce(1).write.mode("append").parquet(src)
    e.where("run_id <> '1'").coalesce(1).write.mode("append").parquet(src)
    stream = mon.event_time(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src), ["ts"])
    mon.start_run_events(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["stage"]: r["run_id"] for r in mon.current_versions(spark, str(tmp_path / "out")).collect()}
    assert got == {"fit": "2", "score": "3"}
