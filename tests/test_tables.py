"""Sources, sinks, roles, joins, macro alignment, exposure and the run log."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from loanforge.functions import finance as fin
from loanforge.operators import exposure as ex
from loanforge.operators import joins, keys, macro, profile, roles
from loanforge.operators.splits import finalize_xy
from loanforge.sources import readers, runlog, writers


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("id,amount,flag,name\n1,2.5,true,a\n2,NA,false,\n3,,true,null\n")
    df = readers.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "name": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, True, "a"), (2, None, False, None), (3, None, True, None)]
    out = str(tmp_path / "t")
    assert writers.replace_table(spark, str(p), out) == 3
    p.write_text("id,amount,flag,name\n9,1.0,true,z\n")
    assert writers.replace_table(spark, str(p), out) == 1
    for fmt in ("csv", "json", "parquet"):
        writers.export(df, str(tmp_path / fmt), fmt)
        assert len(list((tmp_path / fmt).glob("part-*"))) >= 1
    with pytest.raises(ValueError):
        writers.export(df, out, "xlsx")


def test_unknown_table(spark, sf):
    with pytest.raises(ValueError, match="unknown table"):
        readers.load_named(spark, sf, "nope")


def test_roles_of_a_loan_table(spark):
    rows = [(f"L{i}", i * 1.5, "Yes" if i % 2 else "No", f"{i % 28 + 1}/{i % 12 + 1}/2020", str(i * 3), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "loan_id string, income double, opted string, opened string, score string, has_card int")
    assert roles.detect_column_types(df) == {
        "numeric": ["income", "score"], "categorical": [], "datetime": ["opened"], "boolean": ["opted", "has_card"], "id": ["loan_id"],
    }


def test_dates_parse_month_or_day_first(spark):
    df = spark.createDataFrame([("12/31/2020",), ("30/01/2020",), ("2020-02-03",), ("x-y",)], "s string")
    us = [r[0] for r in df.select(roles.parse_date(F.col("s"))).collect()]
    eu = [r[0] for r in df.select(roles.parse_date(F.col("s"), True)).collect()]
    assert us == [dt.date(2020, 12, 31), None, dt.date(2020, 2, 3), None]
    assert eu == [None, dt.date(2020, 1, 30), dt.date(2020, 2, 3), None]


def test_auto_date_column_is_never_a_default_date():
    assert roles.pick_date_column(["default_date", "loan_date"]) == "loan_date"
    assert roles.pick_date_column(["default_date"]) is None


def test_leakage_columns_and_duplicates(spark):
    df = spark.createDataFrame([(1, 30, 5, 0.1, 0, 0), (1, 30, 5, 0.1, 0, 0), (2, 40, 6, 0.2, 95, 1)], "id int, age int, income int, origpd double, dpd int, default int")
    clean, dropped = finalize_xy(df, ["id"], "default")
    assert clean.columns == ["age", "income", "default"] and clean.count() == 2
    assert dropped["late_origin"] == ["origpd", "dpd"]
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_join_suffix_fan_out_and_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (7, "z"), (None, "n")], "k int, v string")
    spec = joins.JoinSpec("r", "k", "k")
    out = joins.join_step(left, right, spec)
    assert out.columns == ["k", "v", "v_r"] and out.count() == 4
    r = joins.join_report(left, right, spec).first()
    assert (r["rows_before"], r["rows_after"], r["unmatched_left"], r["orphan_right"], r["duplicate_right_keys"], r["fan_out"]) == (3, 4, 2, 1, 2, True)
    with pytest.raises(ValueError, match="unknown table"):
        joins.integrate(left, {}, [spec])
    with pytest.raises(ValueError, match="not in the data"):
        joins.join_step(left, right, joins.JoinSpec("r", "zz", "k"))


def test_key_shortlist(spark):
    t = {"a": spark.createDataFrame([(1, 5), (2, 5)], "id int, g int"), "b": spark.createDataFrame([(1,), (1,)], "a_id int")}
    assert keys.primary_keys(t) == {"a": [("id", 2)], "b": []}
    pk, fk = keys.relationships(t)
    assert [(r["fk_table"], r["fk_column"], r["pk_column"], r["cardinality"]) for r in fk.collect()] == [("b", "a_id", "id", "1:many")]
    assert pk.first()["confidence"] == 0.99


def test_links_of_all_kinds_against_plain_sets(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    t = {
        "k": spark.createDataFrame([(i, float(i) / 2, f"c{i}", str(i), day(i), i % 2 == 0) for i in range(1, 61)], "id int, half double, code string, digits string, day date, even boolean"),
        "f": spark.createDataFrame([(i % 70, float(i % 9), f"c{i % 50}" if i % 3 else None, str(i % 100), day(i % 80), f"{day(i % 40)}", i + 1000, "zz") for i in range(300)], "a bigint, b double, c string, d string, e date, g string, far int, other string"),
        "none": spark.createDataFrame([], "x int, y string"),
    }
    found = keys.sketches(t)
    keyed = {n: [c for c, _ in v] for n, v in keys.primary_keys(t).items() if v}
    assert keyed["k"] == ["id", "half", "code", "digits", "day"]
    sets = {(n, c): {str(v) for v in (r[c] for r in df.collect()) if v is not None} for n, df in t.items() for c in df.columns}
    want = {(n, c, m, k): len(a & sets[m, k]) / len(a) for (n, c), a in sets.items() for m, ks in keyed.items() for k in ks if n != m and a & sets[m, k]}
    got = {tuple(r)[:4]: r["overlap"] for r in keys.foreign_key_scores(t, keyed).collect()}
    assert got == pytest.approx(want)
    pairs = {(s.table, s.column, k.table, k.column) for s, k in keys.candidate_pairs(found, keyed)}
    assert set(want) <= pairs and not any("far" in p and "id" in p or "other" in p for p in pairs)


def test_as_of_never_looks_ahead(spark):
    s = spark.createDataFrame([("gdp", dt.date(2020, 1, 15), 1.0), ("gdp", dt.date(2020, 4, 1), 2.0)], "series string, obs_date date, value double")
    d = spark.createDataFrame([(1, dt.date(2020, 1, 20)), (2, dt.date(2020, 2, 1)), (3, dt.date(2020, 4, 30)), (4, None)], "id int, d date")
    got = {r["id"]: r["macro_gdp"] for r in macro.attach_one(d, "d", s, "gdp").collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None}


def test_balance_end_points(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    L = lambda x: F.lit(float(x))
    assert v(fin.balance_after_payments(L(1000), L(0.01), L(12), L(0))) == pytest.approx(1000)
    assert v(fin.balance_after_payments(L(1000), L(0.01), L(12), L(12))) == pytest.approx(0, abs=1e-9)
    assert v(fin.balance_after_payments(L(1000), L(0.0), L(10), L(4))) == pytest.approx(600)
    assert v(fin.outstanding_balance(L(100), L(0.1), L(2))) == pytest.approx(121)
    with pytest.raises(ValueError):
        fin.ead_stages(L(1), L(0), L(0), L(1), "weekly")


@pytest.mark.parametrize("rates,scale", [([5.0, 7.0, 0.0], 0.01), ([0.05, 0.07], 1.0), ([0.5, 3.0], 0.01), ([0.2, 1.5], 1.0), ([], 1.0)])
def test_rate_unit_from_the_median(spark, rates, scale):
    df = spark.createDataFrame([(r,) for r in rates], "r double")
    assert ex.rate_scale(df, "r") == scale


def test_ead_source_and_staging(spark):
    df = spark.createDataFrame([(900.0, 1000.0, 6.0, 1.0, 5.0)], "outstanding_balance double, loan_amount double, interest_rate double, years_elapsed double, term_years double")
    assert ex.resolve_ead(df)[1]["mode"] == "outstanding_balance"
    est = ex.ead_summary(df, "estimate").first()
    q = 1.06**5
    assert est["mean"] == pytest.approx(round(1000 * (q - 1.06) / (q - 1), 2))
    with pytest.raises(ValueError, match="term"):
        ex.ead_summary(df.drop("term_years", "outstanding_balance"), "estimate")
    t = spark.createDataFrame([(0.02, 0.02, 0), (0.02, 0.01, 0), (0.05, 0.05, 30), (0.01, 0.01, 90), (0.06, 0.05, None)], "pd double, orig_pd double, dpd int")
    assert [r["ifrs9_stage"] for r in ex.with_stage(t).collect()] == [1, 2, 2, 3, 1]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("1", t, "fit", '{"auc": 0.7}'), ("2", t + dt.timedelta(hours=1), "fit", "not json")], runlog.EVENT_SCHEMA)
    runlog.append_events(e, path)
    runlog.append_events(spark.createDataFrame([(str(uuid.uuid4()), t, "score", None)], runlog.EVENT_SCHEMA), path)
    log = runlog.read_events(spark, path)
    assert log.count() == 3
    assert {r["stage"]: r["run_id"] for r in runlog.latest_by_stage(log).collect()}["fit"] == "2"
    parsed = {r["run_id"]: r["auc"] for r in runlog.parse_summary(log.where("stage = 'fit'"), "auc double").collect()}
    assert parsed == {"1": 0.7, "2": None}
    assert runlog.find_event(log, "1").count() == 1
    assert [r["run_id"] for r in runlog.activity_feed([("x", log.where("stage = 'fit'"))]).collect()] == ["2", "1"]


def test_sixty_classes_are_cut_exactly(spark):
    from loanforge.operators import splits

    df = spark.range(6000).selectExpr("id AS key", "CAST(id % 60 AS INT) AS y", "id * 2 AS __other")
    parts = splits.stratified_split(df, "y", ["key"]).groupBy("y", "split").count().collect()
    assert {(r["split"], r["count"]) for r in parts} == {("test", 15), ("val", 15), ("train", 70)} and len(parts) == 180
    few = df.where("y < 20")
    literal = splits.stratified_split(few, "y", ["key"])
    counts = few.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    table = splits._cut_by_table(few, "y", splits.key_hash(["key"], 42), counts, [0.15, 0.3], ["test", "val", "train"], "split", [0.15, 0.15])
    assert literal.exceptAll(table).count() == 0 and literal.count() == table.count()
    folds = splits.fold_column(df, ["key"], 5, name="fold", y="y").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds} == {20} and len(folds) == 300
    weights = splits.with_class_weights(df.unionByName(df.where("y = 0")), "y").groupBy("y").agg(F.max("weight").alias("w")).collect()
    assert {round(r["w"], 6) for r in weights if r["y"]} == {round(6100 / 6000, 6)} and [round(r["w"], 6) for r in weights if r["y"] == 0] == [round(6100 / 12000, 6)]


def test_one_hot_names_stay_apart(spark):
    from loanforge.operators import prep

    df = spark.createDataFrame([("A-1",), ("A_1",), ("B",)], "c string")
    out = prep.one_hot(df, {"c": ["A-1", "A_1", "B"]})
    assert len(set(out.columns)) == 4 and "c_B" in out.columns
    assert [tuple(r)[1:] for r in out.collect()] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_integration_report_equals_the_joins(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (9, "d")], "k int, v string")
    tables = {
        "r": spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 10, "z"), (7, 12, "w")], "k int, g int, v string"),
        "s": spark.createDataFrame([(10, "p"), (10, "q"), (11, "p"), (99, "p")], "g int, v string"),
        "t": spark.createDataFrame([("p", 1), ("x", 2), ("x", 3)], "v string, n int"),
    }
    specs = [joins.JoinSpec("r", "k", "k"), joins.JoinSpec("s", "g", "g", "inner"), joins.JoinSpec("t", "v_r", "v"), joins.JoinSpec("t", "v", "v")]
    want, acc = [], base
    for i, s in enumerate(specs):
        want.append(joins.join_report(acc, tables[s.right_table], s).withColumn("step", F.lit(i + 1)).first())
        acc = joins.join_step(acc, tables[s.right_table], s)
    got = joins.integration_report(base, tables, specs).orderBy("step").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with pytest.raises(ValueError, match="not in the data"):
        joins.integration_report(base, tables, [joins.JoinSpec("r", "zz", "k")])
