"""Evaluation of scored tables ``(key, y, p[, ts, grp])``.

Curve measures read the score ladder, so they are exact with ties and need no
global sort of raw rows. Everything else is one conditional aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.functions.dates import period_label
from loanforge.functions.expressions import bin_right_closed, safe_div, settle, with_totals
from loanforge.operators.ordering import (
    typed_order_statistic,
    average_ranks,
    exact_quantiles,
    feature_aucs,
    order_statistics,
    score_ladder,
)

# Decision thresholds swept by every threshold report.
THRESHOLDS = [float(t) for t in np.linspace(0.01, 0.99, 99)]
# Metric gates (metric, operator, limit).
METRIC_GATES = [
    ("roc_auc", ">=", 0.70),
    ("gini", ">=", 0.40),
    ("recall", ">=", 0.60),
    ("precision", ">=", 0.50),
    ("f1", ">=", 0.55),
    ("brier_score", "<", 0.25),
    ("pr_auc", ">=", 0.30),
    ("ks", ">=", 0.30),
]


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
    }


def confusion(scored: DataFrame, threshold: float, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    hit = F.col(p) >= F.lit(float(threshold))
    pos = F.col(y) == 1
    return scored.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(~pos & ~hit).alias("tn"),
        F.count_if(pos & ~hit).alias("fn"),
    )


def threshold_metrics(scored: DataFrame, threshold: float, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """accuracy, precision, recall, F1 and the confusion cells at one threshold."""
    c = confusion(scored, threshold, by, y, p)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    m = _prf(tp, fp, fn)
    return c.select(
        *by,
        F.lit(float(threshold)).alias("threshold"),
        "tp", "fp", "tn", "fn",
        F.round(safe_div(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        *[F.round(v, 4).alias(k) for k, v in m.items()],
    )


def class_report(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """precision, recall, F1, support per class plus macro and weighted means."""
    c = confusion(scored, threshold, (), y, p)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    one, zero = _prf(tp, fp, fn), _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    rows = []
    for name, pick in (
        ("0", lambda k: zero[k]),
        ("1", lambda k: one[k]),
        ("macro avg", lambda k: (zero[k] + one[k]) / 2.0),
        ("weighted avg", lambda k: safe_div(zero[k] * s0 + one[k] * s1, s0 + s1)),
    ):
        support = {"0": s0, "1": s1}.get(name, s0 + s1)
        rows.append(
            F.struct(
                F.lit(name).alias("label"),
                *[F.round(pick(k), 4).alias(k) for k in ("precision", "recall", "f1")],
                support.cast("bigint").alias("support"),
            )
        )
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grid_counts(scored: DataFrame, grid: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """``(i, t, tp, fp, fn)`` per grid threshold.

    Each score is placed on the grid by binary search; one partial aggregate of
    ``len(grid) + 1`` rows replaces one pass per threshold.
    """
    placed = Bucketizer(
        splits=[-math.inf, *grid, math.inf], inputCol="__p", outputCol="__i", handleInvalid="skip"
    ).transform(scored.select(F.col(p).cast("double").alias("__p"), F.col(y).cast("int").alias("__y")))
    cells = placed.groupBy(F.col("__i").cast("int").alias("i")).agg(
        F.sum("__y").cast("bigint").alias("pos"), F.sum(1 - F.col("__y")).cast("bigint").alias("neg")
    )
    whole = cells.agg(F.collect_list(F.struct("i", "pos", "neg")).alias("c"))  # len(grid)+1 structs

    def total(field: str, cond) -> Column:
        return F.aggregate(
            F.filter(F.col("c"), cond), F.lit(0).cast("bigint"), lambda a, x: a + x[field]
        )

    points = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)]))
    return whole.select("c", points.alias("g")).select(
        F.col("g.i").alias("i"),
        F.col("g.t").alias("t"),
        total("pos", lambda x: x["i"] >= F.col("g.i")).alias("tp"),
        total("neg", lambda x: x["i"] >= F.col("g.i")).alias("fp"),
        total("pos", lambda x: x["i"] < F.col("g.i")).alias("fn"),
    )


def threshold_sweep(scored: DataFrame, grid: Sequence[float] = THRESHOLDS, y: str = "y", p: str = "p") -> DataFrame:
    """precision, recall, F1 for every grid threshold."""
    m = _prf(*(F.col(x).cast("double") for x in ("tp", "fp", "fn")))
    return grid_counts(scored, grid, y, p).select(
        F.round("t", 4).alias("threshold"), *[F.round(v, 6).alias(k) for k, v in m.items()]
    )


def best_threshold(scored: DataFrame, grid: Sequence[float] = THRESHOLDS, y: str = "y", p: str = "p") -> DataFrame:
    """Grid threshold of highest F1, the lowest one on ties."""
    m = _prf(*(F.col(x).cast("double") for x in ("tp", "fp", "fn")))
    rows = grid_counts(scored, grid, y, p).select("i", "t", *[v.alias(k) for k, v in m.items()])
    best = rows.agg(F.max_by(F.struct("t", "precision", "recall", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select(
        F.round("b.t", 4).alias("threshold"),
        F.lit("f1").alias("metric"),
        *[F.round(f"b.{k}", 4).alias(k) for k in ("f1", "precision", "recall")],
    )


def roc_points(scored: DataFrame, y: str = "y", p: str = "p", ladder: DataFrame | None = None) -> DataFrame:
    """fpr and tpr per distinct score, from (0, 0)."""
    lad = ladder if ladder is not None else score_ladder(scored, y, p)
    pts = lad.select(
        "score",
        F.round(F.col("cum_neg") / F.col("tot_neg"), 6).alias("fpr"),
        F.round(F.col("cum_pos") / F.col("tot_pos"), 6).alias("tpr"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(pts)


def pr_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """precision and recall per distinct score, ending at recall 0, precision 1."""
    pts = score_ladder(scored, y, p).select(
        "score",
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(F.col("cum_pos") / F.col("tot_pos"), 6).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return pts.unionByName(end)


def auc_column() -> Column:
    """Rank AUC over ladder rows of one group, ties counted half; null for a single class."""
    won = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") * F.lit(0.5)))
    pairs = F.first("tot_pos").cast("double") * F.first("tot_neg")
    return F.when(pairs > 0, won / pairs)


def average_precision_column() -> Column:
    step = F.col("pos").cast("double") / F.col("tot_pos")
    return F.sum(step * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))


def ks_column() -> Column:
    return F.max(F.abs(F.col("cum_pos") / F.col("tot_pos") - F.col("cum_neg") / F.col("tot_neg")))


def auc_gini(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    lad = score_ladder(scored, y, p, by)
    return lad.groupBy(*by).agg(auc_column().alias("auc")).select(
        *by, F.round("auc", 6).alias("auc"), F.round(2 * F.col("auc") - 1, 6).alias("gini")
    )


def ladder_metrics(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AUC, Gini, average precision and KS from one ladder."""
    lad = score_ladder(scored, y, p, by)
    return lad.groupBy(*by).agg(
        auc_column().alias("roc_auc"), average_precision_column().alias("pr_auc"), ks_column().alias("ks")
    ).withColumn("gini", 2 * F.col("roc_auc") - 1)


def average_precision(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return score_ladder(scored, y, p, by).groupBy(*by).agg(F.round(average_precision_column(), 6).alias("pr_auc"))


def ks_statistic(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Largest gap of the class score distributions and its asymptotic p-value."""
    g = score_ladder(scored, y, p, by).groupBy(*by).agg(
        ks_column().alias("d"), F.first("tot_pos").cast("double").alias("np"), F.first("tot_neg").cast("double").alias("nn")
    )
    lam = F.sqrt(F.col("np") * F.col("nn") / (F.col("np") + F.col("nn"))) * F.col("d")
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return g.select(
        *by,
        F.round("d", 4).alias("ks_statistic"),
        F.round(F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))), 4).alias("ks_pvalue"),
    )


def brier(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    gap = F.col(p) - F.col(y)
    return scored.groupBy(*by).agg(F.round(F.avg(gap * gap), 6).alias("brier_score"))


def score_distribution(scored: DataFrame, n_bins: int = 40, y: str = "y", p: str = "p") -> DataFrame:
    """Good and bad counts per equal-width score bin on 0..1; empty bins omitted."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]
    labels = F.array(*[F.lit(f"{a:.2f}-{b:.2f}") for a, b in zip(edges, edges[1:])])
    placed = Bucketizer(splits=edges, inputCol="__p", outputCol="__i", handleInvalid="skip").transform(
        scored.where(F.col(p).between(0.0, 1.0)).select(F.col(p).cast("double").alias("__p"), F.col(y).alias("__y"))
    )
    return (
        placed.groupBy(F.col("__i").cast("int").alias("i"))
        .agg(F.count_if(F.col("__y") == 0).alias("good"), F.count_if(F.col("__y") == 1).alias("bad"))
        .select(F.col("i").alias("bin_index"), F.element_at(labels, F.col("i") + 1).alias("bin"), "good", "bad")
    )


def gain_lift(scored: DataFrame, key: str = "key", n_deciles: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative gain and lift at each decile of rows, ordered by score descending then key.

    The ladder locates the tied score that each cut falls into; only rows of
    those scores (at most ``n_deciles + 1``) are ranked by key.
    """
    lad = score_ladder(scored, y, p).withColumn("cum_n", F.col("cum_pos") + F.col("cum_neg"))
    kind = dict(scored.dtypes)[key]
    widest = F.max(F.greatest(F.col(key), -F.col(key))) if kind == "bigint" else F.lit(None)
    total = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"), widest.alias("widest")
    ).first()
    n, n_pos = total["n"], total["pos"] or 0
    cutoffs = [int(n * (i / n_deciles)) for i in range(n_deciles + 1)]
    inside = F.lit(False)
    for c in sorted(set(cutoffs)):
        inside = inside | ((F.col("cum_n") >= c) & (F.col("cum_n") - F.col("pos") - F.col("neg") < c))
    rungs = lad.where(inside).select("score", "pos", "neg", "cum_pos", "cum_n").collect()  # <= n_deciles + 1 rows
    exact = {0: 0}
    partial = []
    for c in cutoffs:
        for r in rungs:
            before = r["cum_n"] - r["pos"] - r["neg"]
            if before < c <= r["cum_n"]:
                exact[c] = r["cum_pos"] - r["pos"]
                if c == r["cum_n"]:
                    exact[c] = r["cum_pos"]
                elif r["pos"]:
                    partial.append((c, r["score"], c - before))
    numeric = kind in ("tinyint", "smallint", "int", "float", "double") or (kind == "bigint" and (total["widest"] or 0) < 2**53)
    if partial and not numeric:  # a double can't hold every such key: ranked in its own type
        for c, s, m in partial:
            same = scored.where((F.col(p) == s) & F.col(y).isNotNull())
            last = typed_order_statistic(same, key, m - 1)
            exact[c] += same.where((F.col(y) == 1) & (F.col(key) <= F.lit(last))).count()
    elif partial:
        tied = scored.where(F.col(p).isin([s for _, s, _ in partial])).select(
            F.col(y).alias("__y"), F.col(p).alias("__p"),
            *[F.when(F.col(p) == s, F.col(key)).alias(f"k{i}") for i, (_, s, _) in enumerate(partial)],
        )
        spots = order_statistics(tied, {f"k{i}": [m - 1] for i, (_, _, m) in enumerate(partial)})
        counts = tied.agg(
            *[
                F.count_if((F.col("__y") == 1) & (F.col(f"k{i}") <= F.lit(spots[(f"k{i}", m - 1)]))).alias(f"c{i}")
                for i, (_, _, m) in enumerate(partial)
            ]
        ).first()
        for i, (c, _, _) in enumerate(partial):
            exact[c] += counts[f"c{i}"]
    rows = []
    for i, c in enumerate(cutoffs):
        pct = i / n_deciles
        gain = exact[c] / n_pos if n_pos else 0.0
        rows.append((int(pct * 100), round(gain * 100, 2), round(pct * 100, 2), round(gain / pct, 4) if pct else 0.0))
    return scored.sparkSession.createDataFrame(rows, "decile int, model double, baseline double, lift double")


def lift_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Gain and lift at every distinct score."""
    share = (F.col("cum_pos") + F.col("cum_neg")) / (F.col("tot_pos") + F.col("tot_neg"))
    gain = F.col("cum_pos") / F.col("tot_pos")
    return score_ladder(scored, y, p).select(
        "score", F.round(share, 6).alias("cum_pct"), F.round(gain, 6).alias("cum_gain"), F.round(gain / share, 4).alias("lift")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE, MSE, RMSE in one aggregate."""
    ok = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(actual) - F.col(predicted)
    g = ok.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(F.col(actual)).alias("v")
    )
    return g.select(
        *by,
        F.round(1 - F.col("mse") / F.col("v"), 4).alias("r2"),
        F.round("mae", 4).alias("mae"),
        F.round("mse", 4).alias("mse"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
    )


def quantile_edges(df: DataFrame, col: str, n_bins: int) -> list[float]:
    """Distinct quantile edges of a column, lowest to highest."""
    q = exact_quantiles(df, [col], [i / n_bins for i in range(n_bins + 1)])[col]
    return sorted({v for v in q if v is not None})


def heteroscedasticity(scored: DataFrame, n_bins: int = 5, y: str = "y", p: str = "p") -> DataFrame:
    """Spearman of |residual| with the score and residual variance ratio over quantile bins."""
    pairs = (
        scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("r", F.abs(F.col("y") - F.col("p")))
    )
    rp = average_ranks(pairs.select("p", "n"), "p").select("p", F.col("avg_rank").alias("rp"), "tot_n")
    rr = average_ranks(pairs.select("r", "n"), "r").select("r", F.col("avg_rank").alias("rr"))
    mid = (F.col("tot_n") + 1) / 2.0
    a, b = F.col("rp") - mid, F.col("rr") - mid
    rho = pairs.join(rp, "p").join(rr, "r").agg(
        (F.sum(F.col("n") * a * b) / F.sqrt(F.sum(F.col("n") * a * a) * F.sum(F.col("n") * b * b))).alias("rho"),
        F.sum("n").alias("n"),
    )
    edges = quantile_edges(scored, p, n_bins)
    bins = (
        scored.groupBy(bin_right_closed(F.col(p), edges).alias("bin"))
        .agg(F.var_samp(F.col(y) - F.col(p)).alias("v"))
        .agg(
            F.count_if(F.col("v") > 0).alias("k"),
            F.max(F.when(F.col("v") > 0, F.col("v"))).alias("hi"),
            F.min(F.when(F.col("v") > 0, F.col("v"))).alias("lo"),
        )
        .select(F.when(F.col("k") > 1, F.round(F.col("hi") / F.col("lo"), 3)).alias("variance_ratio"))
    )
    enough = F.col("n") >= max(n_bins * 5, 20)
    flag = (F.abs(F.coalesce("rho", F.lit(0.0))) > 0.35) | (F.coalesce("variance_ratio", F.lit(0.0)) > 4)
    return with_totals(rho, bins).select(
        F.when(enough, F.round("rho", 4)).alias("spearman_abs_resid_vs_score"),
        F.when(enough, F.col("variance_ratio")).alias("variance_ratio"),
        F.when(~enough, "Not enough data").when(flag, "Potential heteroscedasticity").otherwise("No strong signal").alias("risk_flag"),
    )


def calibration(scored: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Actual rate against mean prediction per quantile bin of the score."""
    edges = quantile_edges(scored, p, n_bins)
    return (
        scored.where(F.col(p).isNotNull())
        .groupBy(bin_right_closed(F.col(p), edges).alias("bin"))
        .agg(
            F.round(F.avg(F.col(y)), 6).alias("actual_rate"),
            F.round(F.avg(F.col(p)), 6).alias("predicted_rate"),
            F.count(F.col(y)).alias("n"),
        )
    )


def temporal_groups(
    scored: DataFrame, freqs: Sequence[str] = ("Monthly",), ts: str = "ts", y: str = "y", p: str = "p"
) -> DataFrame:
    """Actual and predicted rate, gap and n per (freq, period) in one shuffle for all frequencies.

    Rows are first reduced to months, the finest period, so the fan-out over
    frequencies happens on month totals and not on loans.
    """
    months = (
        scored.where(F.col(ts).isNotNull())
        .groupBy(F.trunc(F.col(ts), "month").alias("m"))
        .agg(F.sum(F.col(y)).cast("double").alias("sy"), F.sum(F.col(p)).alias("sp"), F.count(F.col(y)).alias("n"))
    )
    spec = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), period_label(F.col("m"), f).alias("period")) for f in freqs]))
    return (
        months.select("sy", "sp", "n", spec.alias("s"))
        .groupBy("s.freq", "s.period")
        .agg(
            (F.sum("sy") / F.sum("n")).alias("actual_rate"),
            (F.sum("sp") / F.sum("n")).alias("predicted_rate"),
            F.sum("n").alias("n"),
        )
        .withColumn("gap", F.col("actual_rate") - F.col("predicted_rate"))
    )


def temporal_actual_vs_predicted(
    scored: DataFrame, freqs: Sequence[str] = ("Monthly",), ts: str = "ts", gap_threshold: float = 0.05
) -> DataFrame:
    g = temporal_groups(scored, freqs, ts)
    return g.select(
        "freq", "period", "n",
        *[settle(F.col(c), 6).alias(c) for c in ("actual_rate", "predicted_rate", "gap")],
        (F.abs("gap") > gap_threshold).alias("flagged"),
    )


def temporal_stability(
    scored: DataFrame, freqs: Sequence[str] = ("Monthly",), ts: str = "ts", gap_threshold: float = 0.05
) -> DataFrame:
    """Periods, flagged periods, mean gap and worst under/over-estimate per frequency."""
    g = temporal_groups(scored, freqs, ts)
    under, over = F.col("gap") > 0, F.col("gap") < 0
    worst = lambda cond, sign: F.max_by(F.when(cond, F.col("period")), F.when(cond, sign * F.col("gap")))
    return g.groupBy("freq").agg(
        F.count(F.lit(1)).alias("n_periods_total"),
        F.count_if(F.abs("gap") > gap_threshold).alias("n_periods_flagged"),
        F.round(F.avg(F.abs("gap")), 6).alias("mean_absolute_gap"),
        worst(under, 1).alias("max_underestimation_period"),
        F.round(F.coalesce(F.max(F.when(under, F.col("gap"))), F.lit(0.0)), 6).alias("max_underestimation_gap"),
        worst(over, -1).alias("max_overestimation_period"),
        F.round(F.coalesce(F.max(F.when(over, -F.col("gap"))), F.lit(0.0)), 6).alias("max_overestimation_gap"),
    )


def metric_table(scored: DataFrame, threshold: float | None = None, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Long ``(*by, metric, value)`` table of the full binary metric suite.

    ``threshold=None`` picks the grid threshold of highest F1.
    """
    if threshold is None:
        threshold = best_threshold(scored, THRESHOLDS, y, p).first()["threshold"]
    t = threshold_metrics(scored, threshold, by, y, p).select(*by, "accuracy", "precision", "recall", "f1")
    lad = ladder_metrics(scored, by, y, p)
    b = brier(scored, by, y, p)
    wide = t.join(lad, list(by)).join(b, list(by)) if by else with_totals(with_totals(t, lad), b)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "ks", "gini", "brier_score"]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 4).alias("value")) for m in names]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.*")


def metric_gates(metrics: DataFrame, gates: Sequence[tuple[str, str, float]] = METRIC_GATES) -> DataFrame:
    """PASS/FAIL of each reported metric against its gate."""
    op = F.create_map(*[F.lit(x) for g in gates for x in (g[0], g[1])])
    lim = F.create_map(*[F.lit(x) for g in gates for x in (g[0], float(g[2]))])
    ok = F.when(F.col("operator") == ">=", F.col("value") >= F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return (
        metrics.withColumns({"operator": F.try_element_at(op, F.col("metric")), "limit": F.try_element_at(lim, F.col("metric"))})
        .where("operator is not null and value is not null")
        .withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))
    )


def univariate_gini(df: DataFrame, numeric_cols: Sequence[str], y: str = "y") -> DataFrame:
    """|2*AUC - 1| per numeric column with nulls at the column median, strongest first by value."""
    medians = exact_quantiles(df, numeric_cols, [0.5])
    filled = df.select(
        F.col(y), *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0] if medians[c][0] is not None else 0.0)).alias(c) for c in numeric_cols]
    )
    rows = list(feature_aucs(filled, list(numeric_cols), y).items())
    return df.sparkSession.createDataFrame(rows, "feature string, auc double").select(
        "feature", F.round(F.abs(2 * F.col("auc") - 1), 4).alias("gini")
    )


def side_by_side(a: Mapping[str, DataFrame], margin: float = 0.02) -> DataFrame:
    """Champion against challengers: metrics side by side, WARN when AUC trails by more than ``margin``."""
    champion = next(iter(a))
    long = None
    for name, m in a.items():
        part = m.select(F.lit(name).alias("model"), "metric", "value")
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy("metric").pivot("model", list(a)).agg(F.first("value"))
    out = None
    for name in list(a)[1:]:
        part = wide.where(F.col("metric").isin("roc_auc", "gini", "recall")).select(
            F.lit(name).alias("challenger"),
            "metric",
            F.col(champion).alias("champion_value"),
            F.col(name).alias("challenger_value"),
            F.round(F.col(name) - F.col(champion), 4).alias("delta"),
            F.when((F.col("metric") == "roc_auc") & (F.col(champion) < F.col(name) - margin), "WARN")
            .otherwise("PASS")
            .alias("status"),
        )
        out = part if out is None else out.unionByName(part)
    return out
