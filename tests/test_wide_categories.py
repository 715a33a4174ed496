"""Columns of thousands of categories through every plan: codes by join, no list in the plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanforge.operators import codes, models, prep
from loanforge.operators import features as fe
from loanforge.streaming import monitor

N = 5000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = []
    for i in range(20_000):
        c = f"c{rnd.randint(0, N - 1):04d}" if i % 3 else "hot"
        if i % 101 == 0:
            c = None
        x = rnd.gauss(0, 1)
        risk = 1 / (1 + math.exp(-(x + (1.5 if c == "hot" else -0.5))))
        out.append((i, c, ["a", "b", "c"][i % 3], x, rnd.random(), int(rnd.random() < risk)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key int, wide string, slim string, x double, z double, y int").cache()


def test_codes_are_places_in_sorted_order(spark, rows, frame):
    specs = fe.fit_bucketers(frame, ["x"], ["wide", "slim"])
    assert specs["wide"].table is not None and specs["slim"].table is None
    order = {k: i for i, k in enumerate(sorted({r[1] or fe.MISSING_LABEL for r in rows}))}
    out = fe.apply_bucketers(frame, specs)
    assert out.columns == [*frame.columns, "x_bin", "wide_bin", "slim_bin"]
    assert all(r.wide_bin == order[r.wide or fe.MISSING_LABEL] for r in out.select("wide", "wide_bin").collect())
    new = spark.createDataFrame([("never seen",), (None,), ("hot",)], "wide string").withColumns({"x": F.lit(0.0), "slim": F.lit("a")})
    assert [r.wide_bin for r in fe.apply_bucketers(new, specs).collect()] == [-1, order[fe.MISSING_LABEL], order["hot"]]
    listed = {r["category"]: r["position"] for r in fe.bucketer_table(frame, specs).where("feature = 'wide'").collect()}
    assert listed == order


def test_weights_and_information_value(rows, frame):
    woe, iv = fe.fit_woe(frame, ["x"], ["wide", "slim"])
    cells = {}
    for _, c, _, _, _, y in rows:
        cells.setdefault(c or fe.MISSING_LABEL, [0, 0])[y] += 1
    good, bad, k = sum(v[0] for v in cells.values()), sum(v[1] for v in cells.values()), len(cells)
    share = {c: ((g + 0.5) / (good + 0.5 * k), (b + 0.5) / (bad + 0.5 * k)) for c, (g, b) in cells.items()}
    assert iv["wide"] == pytest.approx(sum((g - b) * math.log(g / b) for g, b in share.values()), abs=1e-5)
    t = woe.specs["wide"].table
    assert "hot" in {h[0] for h in t.hot}
    got = t.attach(frame).select("wide", woe.column("wide").alias("w")).collect()
    assert all(r.w == pytest.approx(math.log(share[r.wide or fe.MISSING_LABEL][0] / share[r.wide or fe.MISSING_LABEL][1])) for r in got[::50])


def test_prep_encodes(spark, rows, frame):
    cats = prep.fit_categories(frame, ["wide", "slim"])
    order = {k: i for i, k in enumerate(sorted({r[1] or "Unknown" for r in rows}))}
    out = prep.ordinal(frame, cats).select("wide", "wide_ord").collect()
    assert all(r.wide_ord == order[r.wide or "Unknown"] for r in out)
    hot = prep.one_hot(frame.limit(50), cats)
    assert {"wide_onehot", "slim_a", "slim_b", "slim_c"} <= set(hot.columns)
    for r in hot.select("wide", "wide_onehot").collect():
        assert (r.wide_onehot.size, list(r.wide_onehot.indices)) == (len(order), [order[r.wide or "Unknown"]])
    odd = spark.createDataFrame([("nowhere", "a")], "wide string, slim string")
    assert prep.one_hot(odd, cats).first().wide_onehot.numNonzeros() == 0


def test_one_hot_names_never_come_twice():
    for names in (["A-1", "A_1", "A_1_0"], ["A_1_0", "A-1", "A_1", "A 1", "A_1_1"], ["x"] * 1):
        assert len(set(prep.one_hot_names("c", names))) == len(names)


def test_model_with_a_wide_column(spark, frame, tmp_path):
    train, rest = frame.where("key % 4 > 0"), frame.where("key % 4 = 0")
    plan = fe.fit_features(train, ["x", "z"], ["wide", "slim"])
    assert "wide" in plan.woe_cols and plan.frequencies["wide"] == {}
    made = fe.apply_features(rest, plan)
    assert {"wide_woe", "wide_freq"} <= set(made.columns) and not any(c.startswith("__") for c in made.columns)
    roles = models.Roles("y", ("key",), ("x", "z"), ("wide", "slim"))
    fitted = models.fit_model(train, roles, feature_plan=plan)
    want = {r["key"]: r["p"] for r in fitted.score(rest).collect()}
    assert len(want) == rest.count()
    fitted.save(str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    assert {r["key"]: r["p"] for r in again.score(rest).collect()} == pytest.approx(want)
    rest.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rest.schema).parquet(str(tmp_path / "in"))
    monitor.start_scoring(stream, again.score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["key"]: r["p"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(want)


def test_plan_limits_are_arguments(frame):
    many = frame.withColumns({f"n{i}": F.col("x") * i + F.rand(i) for i in range(1, 8)})
    names = ["x", "z", *[f"n{i}" for i in range(1, 8)]]
    plan = fe.fit_features(many, names, ["slim"])
    assert set(plan.bins) == set(names)
    few = fe.fit_features(many, names, ["slim"], binned=2, woe_features=3, interactions=1, interaction_pool=4)
    assert len(few.bins) == 2 and len(few.woe_cols) <= 3 and len(few.interactions) <= 1


def test_numbered_over_many_ranges(spark):
    df = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("v")).repartition(9)
    assert [r["n"] for r in codes.numbered(df, "v", "n").orderBy("v").collect()] == list(range(5000))
    assert codes.numbered(df.limit(0), "v", "n").count() == 0
