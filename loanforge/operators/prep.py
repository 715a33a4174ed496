"""Missing-value treatment, imputation, scaling, encoding: learned on train, applied as projections."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.functions.dates import date_parts
from loanforge.functions.expressions import bin_right_closed, corrected_skew
from loanforge.operators.chained import ChainedPlan, apply_chained, fit_chained
from loanforge.operators.codes import CodeTable, attach_all, detach_all, fit_code_table, split_wide, wide_columns
from loanforge.operators.features import EPS, woe_cells
from loanforge.operators.neighbours import nearest_by_vector
from loanforge.operators.ordering import exact_quantiles
from loanforge.operators.profile import (
    categorical_analysis,
    correlation_values,
    numeric_analysis,
    value_counts,
)
from loanforge.operators.roles import parse_date, two_valued
from loanforge.session import cut_lineage

REVIEW_ABOVE = 0.40
STRONG_CORR = 0.30
REDUNDANT_CORR = 0.60
# Words read as true and false.
TRUE_WORDS = ["yes", "y", "true", "t", "1"]
FALSE_WORDS = ["no", "n", "false", "f", "0"]


# ---- treatment proposals -------------------------------------------------


def missing_treatments(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()
) -> dict[str, dict]:
    """Treatment per column that has nulls, from data shape alone.

    review_flag above 40% missing (unless in ``keep``) or all null, else
    unknown_category, zero_fill (two values, or a structural zero) or statistical.
    """
    cols = [*numeric, *categorical]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs.append(F.count(c).alias(f"n__{c}"))
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [
            F.min(x).alias(f"lo__{c}"),
            F.count_if(F.abs(x - F.round(x)) > 1e-8).alias(f"frac__{c}"),
            F.count_if(x == 0).alias(f"zero__{c}"),
            corrected_skew(x).alias(f"skew__{c}"),
        ]
    r = df.agg(*aggs).first()
    n = r["n"]
    out: dict[str, dict] = {}
    open_numeric = []
    for c in cols:
        miss = 1 - r[f"n__{c}"] / n if n else 0.0
        if miss <= 0:
            continue
        if (miss > REVIEW_ABOVE and c not in keep) or r[f"n__{c}"] == 0:
            out[c] = {"treatment": "review_flag"}
        elif c in categorical:
            out[c] = {"treatment": "unknown_category"}
        else:
            out[c] = {"treatment": "statistical"}
            open_numeric.append(c)
        out[c]["missing_pct"] = miss
    binary = two_valued(df, open_numeric)
    counts = [
        c for c in open_numeric
        if c not in binary and r[f"lo__{c}"] >= 0 and r[f"frac__{c}"] == 0 and r[f"zero__{c}"] > 0
        and (r[f"skew__{c}"] or 0.0) > 1.0 and r[f"n__{c}"] > 3
    ]
    top = {}
    if counts:
        top = {x["feature"]: x["hi"] for x in value_counts(df, counts).groupBy("feature").agg(F.max("n").alias("hi")).collect()}
    for c in open_numeric:
        if c in binary or (c in counts and r[f"zero__{c}"] == top[c]):
            out[c]["treatment"] = "zero_fill"
    return out


def treatment_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    t = missing_treatments(df, numeric, categorical)
    rows = [(c, v["treatment"], round(v["missing_pct"], 4)) for c, v in t.items()]
    return df.sparkSession.createDataFrame(rows, "column string, treatment string, missing_pct double")


def imputation_strategy(df: DataFrame, statistical: Sequence[str], numeric: Sequence[str]) -> dict:
    """One joint method (mice, knn, median) from correlation strength and missing share, whatever the row count."""
    cols = list(statistical)
    n = df.count()
    if not cols:
        return {"method": "median", "n_rows": n, "missing_pct": 0.0, "n_strong": 0, "max_corr": {}}
    r = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    miss = 1 - sum(r[c] for c in cols) / (n * len(cols)) if n else 0.0
    predictors = [c for c in numeric if c not in cols]
    others = predictors or cols
    corr = correlation_values(df, list(dict.fromkeys([*cols, *others])))
    best = {c: round(max([abs(corr[(c, o)]) for o in others if o != c and corr.get((c, o)) is not None] or [0.0]), 4) for c in cols}
    strong = sum(v >= STRONG_CORR for v in best.values())
    method = ("mice" if miss > 0.15 else "knn") if strong else "median"
    if method != "median" and not predictors:
        method = "median"
    return {"method": method, "n_rows": n, "missing_pct": round(miss, 4), "n_strong": strong, "max_corr": best}


def strategy_table(df: DataFrame, statistical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    s = imputation_strategy(df, statistical, numeric)
    rows = [(c, v, s["method"], s["n_strong"], s["missing_pct"], s["n_rows"]) for c, v in s["max_corr"].items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, max_corr double, method string, n_strong int, missing_pct double, n_rows bigint"
    )


# ---- imputation ----------------------------------------------------------


def constant_fills(df: DataFrame, treatments: Mapping[str, str]) -> DataFrame:
    """"Unknown" for unknown_category columns and 0 for zero_fill columns."""
    types = dict(df.dtypes)
    new = {}
    for c, t in treatments.items():
        if t == "unknown_category":
            new[c] = F.coalesce(F.col(c), F.lit("Unknown"))
        elif t == "zero_fill":
            new[c] = F.coalesce(F.col(c), F.lit(0).cast(types[c]))
    return df.withColumns(new) if new else df


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    q = exact_quantiles(train, cols, [0.5])
    return {c: q[c][0] if q[c][0] is not None else 0.0 for c in cols}


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()})


@dataclass(frozen=True)
class KnnPlan:
    """Standardising constants and the train table whose rows are the donors."""

    cols: tuple[str, ...]
    targets: tuple[str, ...]
    mean: dict[str, float]
    sd: dict[str, float]
    donors: DataFrame
    k: int = 5

    def standardised(self, df: DataFrame) -> Column:
        """Standardised columns as one array, NaN where missing."""
        z = [(F.col(c).cast("double") - self.mean[c]) / self.sd[c] for c in self.cols]
        return F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in z])


def fit_knn(train: DataFrame, cols: Sequence[str], targets: Sequence[str], k: int = 5) -> KnnPlan:
    """Every train row is a donor; the donors stay where they are."""
    s = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}"))]).first()
    mean = {c: float(s[f"m__{c}"] or 0.0) for c in cols}
    sd = {c: float(s[f"s__{c}"] or 1.0) or 1.0 for c in cols}
    return KnnPlan(tuple(cols), tuple(targets), mean, sd, train.select(*cols), k)


def apply_knn(df: DataFrame, plan: KnnPlan) -> DataFrame:
    """Fill the null targets with the mean of the nearest donors, of equally near ones those of smallest value.

    Different value vectors with a gap are searched once each, against the cells
    of donors that can hold a nearest one. No side is collected or bounded in size.
    """
    targets, k = plan.targets, plan.k
    gap = F.lit(False)
    for t in targets:
        gap = gap | F.col(t).isNull()
    places = range(len(plan.cols))
    vectors = df.where(gap).select(plan.standardised(df).alias("q")).distinct().select(*[F.col("q")[i].alias(f"q{i}") for i in places])
    donors = plan.donors.select(*[plan.standardised(plan.donors)[i].alias(f"d{i}") for i in places])
    found = nearest_by_vector(vectors, donors, len(plan.cols), [plan.cols.index(t) for t in targets], k)
    mean = F.when(F.size("near") > 0, F.aggregate("near", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("near")).otherwise(F.lit(0.0))
    wide = found.groupBy("w").agg(*[F.max(F.when(F.col("t") == plan.cols.index(t), mean)).alias(f"__z_{t}") for t in targets])
    typed = df.select(*[F.col(c).cast("double").alias(c) if c in plan.cols else F.col(c) for c in df.columns])
    joined = typed.withColumn("__q", plan.standardised(typed)).join(wide.withColumnRenamed("w", "__w"), gap & (F.col("__q") == F.col("__w")), "left")
    fill = {t: F.coalesce(F.col(t), F.coalesce(F.col(f"__z_{t}"), F.lit(0.0)) * plan.sd[t] + plan.mean[t]) for t in targets}
    return joined.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class ImputationPlan:
    """Treatment per column and the learned joint imputer of the statistical block."""

    treatments: dict[str, str]
    method: str
    medians: dict[str, float] = field(default_factory=dict)
    chain: ChainedPlan | None = None
    knn: KnnPlan | None = None


def fit_imputation(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], treatments: Mapping[str, str] | None = None, method: str | None = None
) -> ImputationPlan:
    """Propose (or take confirmed) treatments, choose one joint method, learn it on train only.

    The joint imputer sees all numeric columns kept, zero fills done first.
    """
    t = dict(treatments) if treatments is not None else {c: v["treatment"] for c, v in missing_treatments(train, numeric, categorical).items()}
    block = [c for c in numeric if t.get(c) == "statistical"]
    if not block:
        return ImputationPlan(t, "median")
    kept = [c for c in numeric if t.get(c) != "review_flag"]
    filled = constant_fills(train, t)
    how = method or imputation_strategy(filled, block, kept)["method"]
    if how == "mice":
        return ImputationPlan(t, how, chain=fit_chained(filled, kept, block))
    if how == "knn":
        return ImputationPlan(t, how, knn=fit_knn(filled, kept, block))
    return ImputationPlan(t, "median", fit_medians(filled, block))


def apply_imputation(df: DataFrame, plan: ImputationPlan) -> DataFrame:
    """Apply a learned imputation to any split; review columns are left as they are."""
    out = constant_fills(df, plan.treatments)
    if plan.chain is not None:
        return apply_chained(out, plan.chain)
    if plan.knn is not None:
        return apply_knn(out, plan.knn)
    return fill_constants(out, plan.medians) if plan.medians else out


# ---- transforms ----------------------------------------------------------


def fit_winsor(train: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    q = exact_quantiles(train, cols, [low, high])
    return {c: (q[c][0], q[c][1]) for c in cols if q[c][0] is not None}


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def winsorize(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), *b) for c, b in bounds.items()})


def fit_standard(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; a zero deviation scales by one."""
    r = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}"))]).first()
    return {c: (float(r[f"m__{c}"] or 0.0), float(r[f"s__{c}"] or 0.0) or 1.0) for c in cols}


def fit_robust(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range."""
    q = exact_quantiles(train, cols, [0.25, 0.5, 0.75])
    return {c: (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in cols if q[c][1] is not None}


def scale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in params.items()})


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    near = lambda v: F.abs(lam - v) < 1e-12
    up = F.when(near(0.0), F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(near(2.0), -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, up).otherwise(down)


def _power_parts(x: Column, lam: float) -> tuple[Column, Column, Column]:
    """The transform of ``x`` and its first two derivatives by the power."""
    u = F.log1p(F.abs(x))

    def g(m: float) -> tuple[Column, Column, Column]:
        # (exp(m u) - 1) / m and its derivatives by m; near 0 by their series.
        if abs(m) < 1e-3:
            return (
                u + u**2 * (m / 2) + u**3 * (m**2 / 6) + u**4 * (m**3 / 24),
                u**2 / 2 + u**3 * (m / 3) + u**4 * (m**2 / 8) + u**5 * (m**3 / 30),
                u**3 / 3 + u**4 * (m / 4) + u**5 * (m**2 / 10),
            )
        e = F.exp(u * m)
        return (e - 1) / m, (e * (u * m - 1) + 1) / m**2, (e * (u**2 * m**2 - u * (2 * m) + 2) - 2) / m**3

    up, down = g(lam), g(2 - lam)
    return tuple(F.when(x >= 0, a).otherwise(sign * b) for a, b, sign in zip(up, down, (-1, 1, -1)))


def fit_yeo_johnson_all(train: DataFrame, cols: Sequence[str], tolerance: float = 1e-9, rounds: int = 100) -> dict[str, float]:
    """Powers of maximum likelihood of all columns at once: every round is one aggregate and one Newton step per column.

    A step that leaves the interval known to hold the maximum is replaced by halving it, and the
    interval is widened until the slope changes sign, so there are no bounds. Constant or empty
    columns and columns whose likelihood has no maximum keep 1.
    """
    lam = dict.fromkeys(cols, 1.0)
    ends: dict[str, list[float | None]] = {c: [None, None] for c in cols}
    open_ = list(cols)
    for _ in range(rounds):
        if not open_:
            break
        aggs = []
        for i, c in enumerate(open_):
            x = F.col(c).cast("double")
            p, d, dd = _power_parts(x, lam[c])
            aggs += [
                F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}"), F.var_pop(p).alias(f"v{i}"),
                F.covar_pop(p, d).alias(f"a{i}"), F.var_pop(d).alias(f"b{i}"), F.covar_pop(p, dd).alias(f"c{i}"),
            ]
        r = train.agg(*aggs).first()
        left = []
        for i, c in enumerate(open_):
            n, j, v, a, b, cc = (r[f"{k}{i}"] for k in "njvabc")
            if not n or v is None or (v == 0 and lam[c] == 1.0):
                lam[c] = 1.0
                continue
            now, (lo, hi) = lam[c], ends[c]
            known = all(math.isfinite(q) for q in (v, a, b, cc)) and v > 0
            if not known:  # too far out: back towards 1
                side = now > 1
            else:
                slope = j - n * a / v
                bend = -n * ((b + cc) / v - 2 * (a / v) ** 2)
                side = slope < 0
            ends[c] = [lo, now] if side else [now, hi]
            lo, hi = ends[c]
            new = now - slope / bend if known and bend < 0 else None
            if new is None or (lo is not None and new <= lo) or (hi is not None and new >= hi):
                new = (lo + hi) / 2 if lo is not None and hi is not None else (now + 2 * (abs(now - 1) + 1) if hi is None else now - 2 * (abs(now - 1) + 1))
            if known and (slope == 0 or abs(new - now) < tolerance):
                lam[c] = now if slope == 0 else new
                continue
            if abs(new) > 1e4:  # the likelihood rises for ever
                lam[c] = 1.0
                continue
            lam[c] = new
            left.append(c)
        open_ = left
    return lam


def fit_yeo_johnson(train: DataFrame, col: str) -> float:
    return fit_yeo_johnson_all(train, [col])[col]


def recommend_transforms(df: DataFrame, cols: Sequence[str], family: str = "linear") -> dict[str, dict]:
    """none, log1p or yeo_johnson per column, kept only when |skew| falls by 30%."""
    r = df.agg(
        *[
            y
            for c in cols
            for y in (
                F.count(c).alias(f"n__{c}"), corrected_skew(F.col(c).cast("double")).alias(f"s__{c}"),
                F.min(F.col(c).cast("double")).alias(f"lo__{c}"),
            )
        ]
    ).first()
    out: dict[str, dict] = {}
    trial: dict[str, tuple[str, Column]] = {}
    power: list[str] = []
    for c in cols:
        n, s = r[f"n__{c}"], r[f"s__{c}"] or 0.0
        if n < 10:
            out[c] = {"transform": "none", "skew": 0.0, "post_skew": None, "reason": "too_few_values"}
        elif abs(s) < 0.5:
            out[c] = {"transform": "none", "skew": s, "post_skew": None, "reason": "symmetric"}
        elif abs(s) < 1.0:
            out[c] = {"transform": "none", "skew": s, "post_skew": None, "reason": "mild_skew"}
        elif r[f"lo__{c}"] > 0:
            trial[c] = ("log1p", F.log1p(F.col(c).cast("double")))
        else:
            power.append(c)
    lam = fit_yeo_johnson_all(df, power) if power else {}
    trial.update({c: ("yeo_johnson", yeo_johnson(F.col(c).cast("double"), x)) for c, x in lam.items()})
    if trial:
        post = df.agg(*[corrected_skew(x).alias(c) for c, (_, x) in trial.items()]).first()
        for c, (name, _) in trial.items():
            s, t = r[f"s__{c}"], post[c] or 0.0
            works = 1 - abs(t) / abs(s) >= 0.30
            out[c] = {"transform": name if works else "none", "skew": s, "post_skew": t, "reason": "skewed" if works else "ineffective"}
    for c in cols:
        out[c]["default_on"] = out[c]["transform"] != "none" and family != "tree"
    return {c: out[c] for c in cols}


def transform_table(df: DataFrame, cols: Sequence[str], family: str = "linear") -> DataFrame:
    rec = recommend_transforms(df, cols, family)
    rows = [
        (c, v["transform"], round(v["skew"], 4), None if v["post_skew"] is None else round(v["post_skew"], 4), v["reason"], v["default_on"])
        for c, v in rec.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, transform string, skew double, post_transform_skew double, reason string, default_on boolean"
    )


Categories = Sequence[str] | CodeTable


def fit_categories(train: DataFrame, cols: Sequence[str], fill: str = "Unknown") -> dict[str, Categories]:
    """Sorted train categories per column, nulls as ``fill``; a code table for columns with many."""
    cols = list(cols)
    wide = wide_columns(train, cols)
    out: dict[str, Categories] = {c: fit_code_table(train, c, fill)[0] if c in wide else [] for c in cols}
    narrow = [c for c in cols if c not in wide]
    if narrow:
        filled = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) for c in narrow])
        for r in value_counts(filled, narrow).select("feature", "value").collect():  # short lists
            out[r["feature"]].append(r["value"])
    return {c: v if isinstance(v, CodeTable) else sorted(v) for c, v in out.items()}


def slug(value: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in value)


def one_hot_names(column: str, categories: Sequence[str]) -> list[str]:
    """A column name per category; categories that read alike get their position as well, and no name comes twice."""
    names = [f"{column}_{slug(k)}" for k in categories]
    often = Counter(names)
    used = {n for n in names if often[n] == 1}
    out = []
    for i, n in enumerate(names):
        if often[n] > 1:
            n = f"{n}_{i}"
            while n in used:
                n += "_"
            used.add(n)
        out.append(n)
    return out


def _code_vector(df: DataFrame, tables: Sequence[CodeTable]) -> DataFrame:
    """``<column>_onehot``: a sparse vector with a 1 at the code of each attached table; all zeros when unseen."""
    for t in tables:
        code, out = f"__code_{t.column}", f"{t.column}_onehot"
        codes = df.sparkSession.range(t.size + 1).select(F.col("id").cast("double").alias(code))
        model = OneHotEncoder(inputCol=code, outputCol=out, dropLast=True).fit(codes)
        df = model.transform(df.withColumn(code, t.value("code", t.size).cast("double"))).drop(code)
    return df


def one_hot(df: DataFrame, categories: Mapping[str, Categories], fill: str = "Unknown") -> DataFrame:
    """0/1 column per train category; unseen values give all zeros. A column with many categories becomes one sparse vector."""
    new = {}
    narrow, tables = split_wide(list(categories), categories)
    for c in narrow:
        v = F.coalesce(F.col(c).cast("string"), F.lit(fill))
        for k, n in zip(categories[c], one_hot_names(c, categories[c])):
            new[n] = (v == F.lit(k)).cast("double")
    df = df.withColumns(new)
    return detach_all(_code_vector(attach_all(df, tables), tables), tables)


def _position(c: str, cats: Categories, fill: str = "Unknown") -> Column:
    if isinstance(cats, CodeTable):
        return cats.value("code", -1).cast("int")
    if not cats:
        return F.lit(-1)
    codes = F.create_map(*[x for i, k in enumerate(cats) for x in (F.lit(k), F.lit(i))])
    return F.coalesce(F.try_element_at(codes, F.coalesce(F.col(c).cast("string"), F.lit(fill))), F.lit(-1))


def ordinal(df: DataFrame, categories: Mapping[str, Categories], fill: str = "Unknown", suffix: str = "_ord") -> DataFrame:
    """Position among sorted train categories, -1 when unseen."""
    _, tables = split_wide(list(categories), categories)
    return detach_all(attach_all(df, tables).withColumns({c + suffix: _position(c, cats, fill) for c, cats in categories.items()}), tables)


def boolean_to_number(c: Column) -> Column:
    """yes/no words to 1/0, else a number, else 0."""
    s = F.lower(F.trim(c.cast("string")))
    return (
        F.when(s.isin(TRUE_WORDS), 1.0).when(s.isin(FALSE_WORDS), 0.0).otherwise(F.coalesce(s.try_cast("double"), F.lit(0.0)))
    )


# ---- reports -------------------------------------------------------------


def preprocessing_report(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], boolean: Sequence[str] = (), datetime: Sequence[str] = ()
) -> DataFrame:
    """Per-column decisions: treatment, scaler, encoder, suggested transform."""
    spark = df.sparkSession
    treat = missing_treatments(df, numeric, categorical)
    rec = recommend_transforms(df, numeric)
    t = spark.createDataFrame([(c, v["treatment"]) for c, v in treat.items()] or [("", "")], "column string, treatment string")
    s = spark.createDataFrame([(c, v["transform"]) for c, v in rec.items()] or [("", "")], "column string, suggested string")
    num = numeric_analysis(df, numeric, {c: v["transform"] for c, v in rec.items()}).select(
        "column", F.lit("numeric").alias("type"), F.col("scaler").alias("action"), "safety_net_imputer"
    )
    out = num.join(s, "column", "left")
    if categorical:
        cat = categorical_analysis(df, categorical).select("column", F.lit("categorical").alias("type"), F.col("encoding").alias("action"))
        out = out.unionByName(cat, allowMissingColumns=True)
    fixed = [(c, "boolean", "cast_0_1") for c in boolean] + [(c, "datetime", "date_parts") for c in datetime]
    if fixed:
        out = out.unionByName(spark.createDataFrame(fixed, "column string, type string, action string"), allowMissingColumns=True)
    return out.join(t, "column", "left")


def iv_label(iv: Column) -> Column:
    return (
        F.when(iv < 0.02, "Not useful").when(iv < 0.10, "Weak").when(iv < 0.30, "Medium").when(iv < 0.50, "Strong")
        .otherwise("Suspiciously high (check for leakage)")
    )


def quick_iv(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y", n_bins: int = 5) -> DataFrame:
    """IV on non-null rows: quantile bins, or the top categories plus Other; +0.5 per cell.

    ``iv`` is null when fewer than two bins or one class is seen.
    """
    cols = [*numeric, *categorical]
    edges = exact_quantiles(df, numeric, [i / n_bins for i in range(n_bins + 1)]) if numeric else {}
    bins: dict[str, Column] = {}
    for c in numeric:
        e = sorted({v for v in edges[c] if v is not None})
        bins[c] = bin_right_closed(F.col(c).cast("double"), e).cast("string")
    if categorical:
        w = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
        top = value_counts(df, categorical).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n_bins).collect()
        for c in categorical:
            names = [r["value"] for r in top if r["feature"] == c]
            v = F.col(c).cast("string")
            bins[c] = F.when(v.isin(names), v).when(v.isNotNull(), "Other")
    cells = woe_cells(df, bins, y).where("bucket is not null")
    w = Window.partitionBy("feature")
    k = F.count(F.lit(1)).over(w)
    g = (F.col("good") + EPS) / (F.sum("good").over(w) + EPS * k)
    b = (F.col("bad") + EPS) / (F.sum("bad").over(w) + EPS * k)
    part = cells.select("feature", "good", "bad", ((b - g) * F.log(b / g)).alias("iv"))
    s = part.groupBy("feature").agg(
        F.sum("iv").alias("iv"), F.count(F.lit(1)).alias("k"), F.sum("good").alias("g"), F.sum("bad").alias("b")
    )
    ok = (F.col("k") >= 2) & (F.col("g") > 0) & (F.col("b") > 0)
    return s.where(F.col("feature").isin(cols)).select(
        F.col("feature").alias("column"), F.when(ok, F.round("iv", 4)).alias("iv"), (F.col("g") + F.col("b")).alias("rows_available")
    )


def drop_impact(
    df: DataFrame, cols: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), y: str = "y", min_rows: int = 30
) -> DataFrame:
    """Quick IV, strongest correlated partner, rows available and a drop verdict per column."""
    spark = df.sparkSession
    num = [c for c in cols if c in numeric]
    n = df.count()
    iv = quick_iv(df, num, [c for c in cols if c in categorical], y)
    partners = []
    if num:
        corr = correlation_values(df, list(numeric))
        both = df.agg(
            *[F.count_if(F.col(c).isNotNull() & F.col(o).isNotNull()).alias(f"{c}~{o}") for c in num for o in numeric if o != c]
        ).first().asDict()
        for c in num:
            seen = [(o, corr[(c, o)]) for o in numeric if o != c and corr[(c, o)] is not None and both[f"{c}~{o}"] >= min_rows]
            o, r = max(seen, key=lambda t: abs(t[1]), default=(None, 0.0))
            partners.append((c, o if abs(r) >= REDUNDANT_CORR else None, round(r, 3) if o and abs(r) >= REDUNDANT_CORR else None))
    for c in cols:
        if c not in num:
            partners.append((c, None, None))
    p = spark.createDataFrame(partners, "column string, redundant_col string, redundant_corr double")
    v = F.when(F.col("rows_available") >= min_rows, F.col("iv"))
    return p.join(iv.withColumn("iv", v), "column", "left").select(
        "column",
        "iv",
        F.when(F.col("iv").isNotNull(), iv_label(F.col("iv"))).alias("iv_label"),
        "redundant_col",
        "redundant_corr",
        "rows_available",
        F.round(F.col("rows_available") / F.lit(float(n)), 6).alias("rows_available_pct"),
        F.when(F.col("iv").isNull(), "neutral")
        .when(F.col("iv") < 0.10, "safe")
        .when(F.col("iv") < 0.30, "caution")
        .otherwise("risk")
        .alias("verdict_tone"),
    )


# ---- routed plan ---------------------------------------------------------


@dataclass(frozen=True)
class Branch:
    """One numeric branch: fill, clip, power, scale; each part optional."""

    fill: float | None = None
    bounds: tuple[float, float] | None = None
    power: str | None = None
    lam: float = 1.0
    inner: tuple[float, float] | None = None
    center: float = 0.0
    width: float = 1.0


@dataclass(frozen=True)
class PrepPlan:
    """Everything learned on train; :func:`apply_prep` turns it into one projection, and a join for each column with many categories."""

    numeric: dict[str, Branch] = field(default_factory=dict)
    onehot: dict[str, list[str]] = field(default_factory=dict)
    ordinal: dict[str, Categories] = field(default_factory=dict)
    boolean: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()

    def output_columns(self) -> list[str]:
        out = list(self.numeric)
        out += [n for c, cats in self.onehot.items() for n in one_hot_names(c, cats)]
        out += [f"{c}_ord" for c in self.ordinal]
        out += list(self.boolean)
        for c in self.datetime:
            out += list(date_parts(F.lit(None).cast("date"), c))
        return out


def _branch_column(x: Column, b: Branch, upto: str = "scale") -> Column:
    x = x.cast("double")
    if b.fill is not None:
        x = F.coalesce(x, F.lit(b.fill))
    if b.bounds:
        x = clip(x, *b.bounds)
    if b.power == "log1p":
        x = log1p_clipped(x)
    elif b.power == "yeo_johnson":
        x = yeo_johnson(x, b.lam)
        if b.inner:
            x = (x - b.inner[0]) / b.inner[1]
    return x if upto == "power" else (x - F.lit(b.center)) / F.lit(b.width)


def fit_prep(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    boolean: Sequence[str] = (),
    datetime: Sequence[str] = (),
    transform_choices: Mapping[str, str] | None = None,
    kept_unimputed: Sequence[str] = (),
) -> PrepPlan:
    """Route each column to its branch and learn its constants on train in a few wide aggregates.

    counts: 0, clip 0-99%, standard; log: median, clip 1-99%, log1p, standard;
    power: median, Yeo-Johnson, standard; outlier-heavy: median, clip, robust;
    kept-null: clip, standard; the rest: median, clip, standard. Columns flagged
    for review are left out.
    """
    choices = transform_choices or {}
    treat = {c: v["treatment"] for c, v in missing_treatments(train, numeric, categorical).items()}
    use = [c for c in numeric if treat.get(c) != "review_flag" or c in kept_unimputed]
    q = exact_quantiles(train, use, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99]) if use else {}
    far = {r["column"]: r["scaler"] for r in numeric_analysis(train, use).collect()} if use else {}
    branches: dict[str, Branch] = {}
    robust = []
    for c in use:
        if q[c][3] is None:
            continue
        if c in kept_unimputed:
            branches[c] = Branch(None, (q[c][1], q[c][5]))
        elif treat.get(c) == "zero_fill":
            # bounds are learned after the zero fill, as the branch applies them
            z = exact_quantiles(train.select(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)), [c], [0.0, 0.99])[c]
            branches[c] = Branch(0.0, (z[0], z[1]))
        elif choices.get(c) == "yeo_johnson":
            branches[c] = Branch(q[c][3], None, "yeo_johnson")
        else:
            branches[c] = Branch(q[c][3], None, choices.get(c) if choices.get(c) == "log1p" else None)
            if far.get(c) == "robust" and branches[c].power is None:
                robust.append(c)
    power = [c for c, b in branches.items() if b.power == "yeo_johnson"]
    if power:
        lam = fit_yeo_johnson_all(train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(branches[c].fill)).alias(c) for c in power]), power)
        branches.update({c: replace(branches[c], lam=lam[c]) for c in power})
    # clip bounds after the median fill, for the branches that fill with the median
    late = [c for c, b in branches.items() if b.bounds is None and b.power != "yeo_johnson"]
    if late:
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(branches[c].fill)).alias(c) for c in late])
        q2 = exact_quantiles(filled, late, [0.01, 0.99])
        for c in late:
            branches[c] = Branch(branches[c].fill, (q2[c][0], q2[c][1]), branches[c].power)
    if branches:
        staged = train.select(*[_branch_column(F.col(c), b, "power").alias(c) for c, b in branches.items()])
        std = fit_standard(staged, [c for c in branches if c not in robust])
        rob = fit_robust(staged, robust) if robust else {}
        for c, b in list(branches.items()):
            center, width = rob.get(c) or std[c]
            branches[c] = Branch(b.fill, b.bounds, b.power, b.lam, b.inner, center, width)
    cats = [c for c in categorical if treat.get(c) != "review_flag"]
    lists = fit_categories(train, cats) if cats else {}
    return PrepPlan(
        branches,
        {c: v for c, v in lists.items() if not isinstance(v, CodeTable) and len([k for k in v if k != "Unknown"]) <= 8},
        {c: v for c, v in lists.items() if isinstance(v, CodeTable) or len([k for k in v if k != "Unknown"]) > 8},
        tuple(boolean),
        tuple(datetime),
    )


def apply_prep(df: DataFrame, plan: PrepPlan, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus all prepared features, over any split or stream."""
    df = attach_all(df, split_wide(list(plan.ordinal), plan.ordinal)[1])
    out = [F.col(c) for c in keep]
    out += [_branch_column(F.col(c), b).alias(c) for c, b in plan.numeric.items()]
    for c, cats in plan.onehot.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
        out += [(v == F.lit(k)).cast("double").alias(n) for k, n in zip(cats, one_hot_names(c, cats))]
    out += [_position(c, cats).cast("double").alias(f"{c}_ord") for c, cats in plan.ordinal.items()]
    out += [boolean_to_number(F.col(c)).alias(c) for c in plan.boolean]
    types = dict(df.dtypes)
    for c in plan.datetime:
        d = parse_date(F.col(c)) if types[c] == "string" else F.col(c)
        out += [v.cast("double").alias(k) for k, v in date_parts(d, c).items()]
    return df.select(*out)

