"""Shocks, macro scenarios, population stability, backtest and directional tests.

A scorer is any function ``DataFrame -> DataFrame`` that adds the probability
column; it is applied once to a frame that already holds every shocked variant,
so all scenarios cost one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanforge.functions.expressions import bin_left_closed, settle, status_above
from loanforge.operators.evaluate import temporal_groups
from loanforge.operators.profile import numeric_columns

Scorer = Callable[[DataFrame], DataFrame]

# Shocks of the macro scenarios (id, scenario, driver, kind, size) and pass limits.
# ``relative`` scales a driver by 1 + size, ``points`` adds percentage points, ``multiple`` scales the resulting PD.
SHOCKS = [
    ("6.2a", "Adverse Scenario", "gdp", "relative", -0.02),
    ("6.2a", "Adverse Scenario", "unemployment", "points", 0.03),
    ("6.2a", "Adverse Scenario", "house_price", "relative", -0.10),
    ("6.2b", "Severe Scenario", "gdp", "relative", -0.05),
    ("6.2b", "Severe Scenario", "unemployment", "points", 0.06),
    ("6.2b", "Severe Scenario", "house_price", "relative", -0.25),
    ("6.2c", "COVID-style Shock", "income", "relative", -0.25),
    ("6.2c", "COVID-style Shock", "pd", "multiple", 2.5),
]
DRIVER_WORDS = {
    "gdp": ["gdp"],
    "unemployment": ["unemploy", "jobless"],
    "house_price": ["house_price", "hpi", "home_price", "home_value", "property_price", "collateral_value"],
    "income": ["income", "salary", "wage", "earnings"],
}
DIRECTIONAL_TESTS = [
    {"id": "6.9a", "driver": "Unemployment", "words": ["unemploy", "jobless"], "factor": 1.10},
    {"id": "6.9b", "driver": "GDP", "words": ["gdp"], "factor": 0.90},
    {"id": "6.9c", "driver": "Credit score", "words": ["credit_score", "creditscore", "fico", "bureau_score"], "factor": 0.90},
]
PSI_WARN, PSI_FAIL = 0.10, 0.25
GAP_WARN, GAP_FAIL, GAP_FLAG = 0.03, 0.06, 0.05
NOISE_FLOOR = 1e-4
PSI_FLOOR = 0.0001


def find_driver(columns: Sequence[str], words: Sequence[str]) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def driver_columns(df: DataFrame) -> dict[str, str | None]:
    nums = numeric_columns(df)
    return {k: find_driver(nums, v) for k, v in DRIVER_WORDS.items()}


def score_variants(df: DataFrame, variants: Sequence[tuple[str, Mapping[str, object]]], scorer: Scorer, p: str = "p") -> DataFrame:
    """Mean PD per variant; a variant maps column names to their shocked Column."""
    touched = list(dict.fromkeys(c for _, m in variants for c in m))
    items = [
        F.struct(F.lit(name).alias("__v"), *[(m.get(c, F.col(c))).cast("double").alias(c) for c in touched]) for name, m in variants
    ]
    wide = df.withColumn("__s", F.explode(F.array(*items))).select(
        *[c for c in df.columns if c not in touched and c != p], "__s.*"
    )
    return scorer(wide).groupBy(F.col("__v").alias("variant")).agg(F.avg(p).alias("mean_pd"))


def _against_base(means: DataFrame, multiplier: Mapping[str, float] | None = None) -> DataFrame:
    """Pair each variant row with the mean PD of the unshocked variant."""
    w = Window.partitionBy(F.lit(0))  # one row per variant
    base = F.max(F.when(F.col("variant") == "base", F.col("mean_pd"))).over(w)
    k = F.lit(1.0)
    for v, m in (multiplier or {}).items():
        k = F.when(F.col("variant") == v, F.lit(float(m))).otherwise(k)
    shocked = F.least(F.greatest(F.col("mean_pd") * k, F.lit(0.0)), F.lit(1.0)) if multiplier else F.col("mean_pd")
    out = means.withColumns({"base_pd": base, "shock_pd": shocked})
    return out.where("variant <> 'base'").withColumn("pd_change", F.col("shock_pd") - F.col("base_pd"))


def _report(df: DataFrame, name: str = "variant") -> DataFrame:
    pct = F.when(F.col("base_pd") > 0, F.col("pd_change") / F.col("base_pd") * 100).otherwise(0.0)
    return df.select(
        F.col("variant").alias(name), *[F.round(c, 6).alias(c) for c in ("base_pd", "shock_pd", "pd_change")], F.round(pct, 4).alias("pd_change_pct")
    )


def feature_shocks(df: DataFrame, shocks: Sequence[tuple[str, str, float]], scorer: Scorer) -> DataFrame:
    """Mean PD change when one feature is scaled; shocks are (feature, increase|decrease, percent)."""
    variants: list[tuple[str, Mapping[str, object]]] = [("base", {})]
    for f, direction, pct in shocks:
        if f not in df.columns:
            raise ValueError(f"unknown feature {f!r}")
        k = 1 + pct / 100 if direction == "increase" else 1 - pct / 100
        variants.append((f"{f} {direction} {pct:g}%", {f: F.col(f) * F.lit(k)}))
    return _report(_against_base(score_variants(df, variants, scorer)), "shock")


def macro_scenarios(
    df: DataFrame, scorer: Scorer, shocks: Sequence[tuple[str, str, str, str, float]] = SHOCKS, fraction_limit: float = 1.5
) -> DataFrame:
    """Every scenario of a shock table in one pass: drivers found by name are shifted, then rescored.

    A percentage-point shift adds the points themselves to a fractional rate and
    a hundred times as much to a rate in percent; the unit is read off the maximum.
    """
    found = driver_columns(df)
    in_points = sorted({found[driver] for _, _, driver, kind, _ in shocks if kind == "points" and found.get(driver)})
    tops = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in in_points]).first() if in_points else {}
    variants: dict[str, dict[str, object]] = {"base": {}}
    multiples: dict[str, float] = {}
    for _, scenario, driver, kind, size in shocks:
        moved = variants.setdefault(scenario, {})
        multiples.setdefault(scenario, 1.0)
        column = found.get(driver)
        if kind == "multiple":
            multiples[scenario] *= size
        elif column and kind == "relative":
            moved[column] = moved.get(column, F.col(column)) * F.lit(1 + size)
        elif column and kind == "points":
            percent = tops[column] is not None and tops[column] > fraction_limit
            moved[column] = moved.get(column, F.col(column)) + F.lit(size * (100.0 if percent else 1.0))
    return _report(_against_base(score_variants(df, list(variants.items()), scorer), multiples), "scenario")


def directional_tests(df: DataFrame, scorer: Scorer, tests: Sequence[Mapping] = DIRECTIONAL_TESTS) -> DataFrame:
    """Sign of the mean PD change for a 10% driver shock; SKIP when no column matches."""
    nums = numeric_columns(df)
    found = {t["id"]: find_driver(nums, t["words"]) for t in tests}
    variants: list[tuple[str, Mapping[str, object]]] = [("base", {})]
    variants += [(t["id"], {found[t["id"]]: F.col(found[t["id"]]) * F.lit(t["factor"])}) for t in tests if found[t["id"]]]
    rows = _against_base(score_variants(df, variants, scorer))
    names = df.sparkSession.createDataFrame([(t["id"], t["driver"], found[t["id"]]) for t in tests], "id string, driver string, column string")
    delta = F.col("pd_change")
    status = F.when(F.col("column").isNull(), "SKIP").when(F.abs(delta) < NOISE_FLOOR, "WARN").when(delta > 0, "PASS").otherwise("FAIL")
    return names.join(rows, names["id"] == rows["variant"], "left").select(
        "id", "driver", "column", status.alias("status"), F.round("base_pd", 6).alias("base_pd"), F.round("shock_pd", 6).alias("new_pd"), F.round(delta, 6).alias("delta")
    )


def psi_bins(scored: DataFrame, split: str = "split", expected: str = "train", actual: str = "test", p: str = "p", bins: int = 10) -> DataFrame:
    """Share of both samples and stability term per equal-width bin over their joint range."""
    both = scored.where(F.col(split).isin(expected, actual) & F.col(p).isNotNull())
    r = both.agg(F.min(p).cast("double").alias("lo"), F.max(p).cast("double").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    counts = both.groupBy(bin_left_closed(F.col(p).cast("double"), F.lit(lo), F.lit(hi), bins).alias("bin")).agg(
        F.count_if(F.col(split) == expected).alias("e"), F.count_if(F.col(split) == actual).alias("a")
    )
    frame = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    w = Window.partitionBy(F.lit(0))  # ``bins`` rows
    share = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.col(c) / F.sum(c).over(w))
    full = frame.join(counts, "bin", "left").select("bin", share("e").alias("e"), share("a").alias("a"))
    return full.select("bin", F.col("e").alias("train_pct"), F.col("a").alias("test_pct"), ((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def psi_report(scored: DataFrame, **kw) -> DataFrame:
    t = psi_bins(scored, **kw).agg(F.sum("psi").alias("psi"))
    return t.select(F.round("psi", 6).alias("psi_total"), status_above(F.col("psi"), PSI_WARN, PSI_FAIL).alias("status"))


def backtest(scored: DataFrame, freqs: Sequence[str], ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """Realised against predicted rate per period; all frequencies share one shuffle."""
    g = temporal_groups(scored, freqs, ts, y, p)
    return g.select(
        "freq",
        "period",
        settle(F.col("actual_rate"), 6).alias("actual_dr"),
        settle(F.col("predicted_rate"), 6).alias("avg_pred_pd"),
        settle(F.abs("gap"), 6).alias("gap"),
        (F.abs("gap") > GAP_FLAG).alias("flagged"),
    )


def backtest_report(scored: DataFrame, freqs: Sequence[str], ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    g = temporal_groups(scored, freqs, ts, y, p).groupBy("freq").agg(
        F.avg(F.abs("gap")).alias("m"), F.max(F.abs("gap")).alias("x"), F.count_if(F.abs("gap") > GAP_FLAG).alias("flagged_periods")
    )
    return g.select(
        "freq", F.round("m", 6).alias("mean_gap"), F.round("x", 6).alias("max_gap"), "flagged_periods",
        status_above(F.col("m"), GAP_WARN, GAP_FAIL).alias("status"),
    )
