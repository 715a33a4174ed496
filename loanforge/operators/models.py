"""Model fit, scoring, comparison and replication on MLlib.

A fitted model is a frozen feature plan, a frozen preparation plan and an MLlib
pipeline; scoring any table or stream is one projection plus ``transform``.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanforge.functions.expressions import safe_corr, with_totals
from loanforge.operators import evaluate as ev
from loanforge.operators import features as fe
from loanforge.operators import prep
from loanforge.operators.codes import CodeTable
from loanforge.operators.features import binned_mutual_information
from loanforge.operators.ordering import exact_quantiles
from loanforge.operators.profile import correlation_values
from loanforge.operators.splits import finalize_xy, fold_column, oot_split, split_stats, stratified_split, with_class_weights

LINEAR = {"Logistic Regression"}
# Boosted trees of MLlib stand in for external boosting libraries under their own names.
ESTIMATORS = {
    "Logistic Regression": lambda p, seed: LogisticRegression(**({"maxIter": 50, "regParam": 0.01} | p)),
    "Random Forest": lambda p, seed: RandomForestClassifier(**({"numTrees": 50, "maxDepth": 6, "seed": seed} | p)),
    "Decision Tree": lambda p, seed: DecisionTreeClassifier(**({"maxDepth": 5, "seed": seed} | p)),
    "Gradient Boosting": lambda p, seed: GBTClassifier(**({"maxIter": 30, "maxDepth": 4, "seed": seed} | p)),
}
# Light settings for comparisons, and the random-search space.
LIGHT = {
    "Logistic Regression": {"maxIter": 25},
    "Random Forest": {"numTrees": 20, "maxDepth": 5},
    "Decision Tree": {"maxDepth": 5},
    "Gradient Boosting": {"maxIter": 10, "maxDepth": 3},
}
SEARCH_SPACE = {
    "Logistic Regression": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "Random Forest": {"numTrees": [20, 50, 100], "maxDepth": [4, 6, 8]},
    "Decision Tree": {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5, 20]},
    "Gradient Boosting": {"maxIter": [10, 20, 40], "maxDepth": [3, 4, 5]},
}


@dataclass(frozen=True)
class Roles:
    """Columns of a modelling table by use."""

    target: str
    keys: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()

    def without(self, feature: str) -> "Roles":
        drop = lambda cols: tuple(c for c in cols if c != feature)
        return Roles(self.target, self.keys, drop(self.numeric), drop(self.categorical), drop(self.boolean), drop(self.datetime))

    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.boolean, *self.datetime]


@dataclass
class FittedModel:
    name: str
    roles: Roles
    plan: prep.PrepPlan
    pipeline: PipelineModel
    columns: list[str]
    features: fe.FeaturePlan | None = None
    info: dict = field(default_factory=dict)
    task: str = "binary"
    classes: tuple[str, ...] = ()

    def prepared(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        # kept columns travel under a prefix, out of reach of the plans
        df = df.withColumns({f"__keep_{c}": F.col(c) for c in keep})
        if self.features is not None:
            df = fe.apply_features(df, self.features)
        out = prep.apply_prep(df, self.plan, [f"__keep_{c}" for c in keep])
        names = [c for c in out.columns if not c.startswith("__keep_")]
        return out.select(*[f"__keep_{c}" for c in keep], *[F.col(c).alias(f"f_{c}") for c in names])

    def score(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` columns (default key and target) and the probability ``p`` of class 1; of other tasks the
        ``prediction``, for several classes with their ``probabilities``."""
        keep = list(keep if keep is not None else [*self.roles.keys, self.roles.target])
        out = self.pipeline.transform(self.prepared(df, keep))
        kept = [F.col(f"__keep_{c}").alias(c) for c in keep]
        if self.task == "regression":
            return out.select(*kept, "prediction")
        if self.task == "multiclass":
            names = F.array(*map(F.lit, self.classes))
            return out.select(*kept, names[F.col("prediction").cast("int")].alias("prediction"), F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))
        return out.select(*kept, vector_to_array("probability")[1].alias("p"))

    def with_score(self, df: DataFrame) -> DataFrame:
        """The whole table plus ``p``."""
        return self.score(df, df.columns)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        tables: list[DataFrame] = []
        meta = {"name": self.name, "roles": asdict(self.roles), "plan": plain(self.plan, tables), "columns": self.columns, "features": plain(self.features, tables), "task": self.task, "classes": list(self.classes)}
        for i, t in enumerate(tables):
            t.write.mode("overwrite").parquet(f"{path}/codes/{i}")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")


#: What a stored plan is made of.
PLAN_PARTS = {c.__name__: c for c in (fe.FeaturePlan, fe.Bucketer, fe.Interaction, fe.WoeMaps, prep.PrepPlan, prep.Branch, CodeTable)}


def plain(v, tables: list[DataFrame] | None = None):
    """Plan objects as JSON values: dataclasses by name, tuples and mappings marked; tables are gathered and named by their place."""
    if isinstance(v, DataFrame):
        if tables is None:
            raise ValueError("a plan with code tables needs a place for them")
        tables.append(v)
        return {"table": len(tables) - 1}
    if is_dataclass(v):
        return {"part": type(v).__name__, "of": {f.name: plain(getattr(v, f.name), tables) for f in fields(v)}}
    if isinstance(v, Mapping):
        return {"map": [[plain(k, tables), plain(x, tables)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"tuple": [plain(x, tables) for x in v]}
    return [plain(x, tables) for x in v] if isinstance(v, list) else v


def revived(v, table: Callable[[int], DataFrame] | None = None):
    """The inverse of :func:`plain`."""
    if isinstance(v, list):
        return [revived(x, table) for x in v]
    if not isinstance(v, dict):
        return v
    if "table" in v:
        return table(v["table"])
    if "part" in v:
        return PLAN_PARTS[v["part"]](**{k: revived(x, table) for k, x in v["of"].items()})
    return tuple(revived(x, table) for x in v["tuple"]) if "tuple" in v else {revived(k, table): revived(x, table) for k, x in v["map"]}


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """A saved model with its plans."""
    m = json.loads(spark.read.text(f"{path}/plan").first()["value"])
    table = lambda i: spark.read.parquet(f"{path}/codes/{i}")
    roles = Roles(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in m["roles"].items()})
    return FittedModel(m["name"], roles, revived(m["plan"], table), PipelineModel.load(f"{path}/pipeline"), m["columns"], revived(m["features"], table), task=m["task"], classes=tuple(m["classes"]))


def _stages(name: str, columns: Sequence[str], params: Mapping | None, seed: int):
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {', '.join(ESTIMATORS)}")
    asm = VectorAssembler(inputCols=[f"f_{c}" for c in columns], outputCol="features", handleInvalid="error")
    est = ESTIMATORS[name](dict(params or {}), seed).setFeaturesCol("features").setLabelCol("label").setWeightCol("weight")
    return asm, est


def fit_model(
    train: DataFrame, roles: Roles, name: str = "Logistic Regression", params: Mapping | None = None, seed: int = 42,
    feature_plan: fe.FeaturePlan | None = None, transform_choices: Mapping[str, str] | None = None, cache: bool = True,
) -> FittedModel:
    """Prepare and fit with balanced class weights; all constants come from ``train``.

    The columns in use are cached for the few scans that learn the plan; pass
    ``cache=False`` when ``train`` is already a slice of a cached table.
    """
    extra = [c for i in (feature_plan.interactions if feature_plan else ()) for c in (i.a, i.b)]
    needed = list(dict.fromkeys([roles.target, *roles.features(), *[c for c in extra if c in train.columns]]))
    slim = train.where(F.col(roles.target).isNotNull()).select(*needed)
    if cache:
        slim.persist(StorageLevel.MEMORY_AND_DISK)
    table = None
    try:
        numeric, categorical = list(roles.numeric), list(roles.categorical)
        source = slim
        if feature_plan is not None:
            source = fe.apply_features(slim, feature_plan)
            have = set(source.columns)
            added = [c for c in source.columns if c not in set(slim.columns)]
            numeric = [c for c in numeric if c in have] + added
            categorical = [c for c in categorical if c in have]
        plan = prep.fit_prep(source, numeric, categorical, roles.boolean, roles.datetime, transform_choices)
        columns = plan.output_columns()
        model = FittedModel(name, roles, plan, None, columns, feature_plan)
        asm, est = _stages(name, columns, params, seed)
        weighted = with_class_weights(model.prepared(slim, [roles.target]).withColumnRenamed(f"__keep_{roles.target}", "label"), "label")
        table = asm.transform(weighted.withColumn("label", F.col("label").cast("double"))).select("label", "weight", "features")
        if name not in LINEAR:  # a linear fit keeps blocks of its own
            table.persist(StorageLevel.MEMORY_AND_DISK)
        model.pipeline = PipelineModel(stages=[asm, est.fit(table)])
        return model
    finally:
        if table is not None:
            table.unpersist()
        if cache:
            slim.unpersist()


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """A table kept for a loop of refits."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def exact_auc(scored: DataFrame, y: str) -> float | None:
    return ev.ladder_metrics(scored, y=y).first()["roc_auc"]


def cross_validate(
    df: DataFrame, roles: Roles, name: str = "Logistic Regression", params: Mapping | None = None, folds: int = 5, seed: int = 42
) -> list[float]:
    """Exact AUC of each fold with preparation refitted on the other folds."""
    out = []
    with cached(fold_column(df.select(*used(roles)), roles.keys, folds, seed, "__fold", roles.target)) as f:
        for k in range(folds):
            m = fit_model(f.where(F.col("__fold") != k).drop("__fold"), roles, name, params, seed, cache=False)
            out.append(exact_auc(m.score(f.where(F.col("__fold") == k).drop("__fold")), roles.target))
    return out


def cv_summary(aucs: Sequence[float]) -> tuple[float, float]:
    ok = [a for a in aucs if a is not None]
    mean = sum(ok) / len(ok)
    return round(mean, 4), round((sum((a - mean) ** 2 for a in ok) / len(ok)) ** 0.5, 4)


def random_search(
    train: DataFrame, roles: Roles, name: str = "Logistic Regression", draws: int = 8, folds: int = 3, seed: int = 42
) -> list[tuple[dict, float]]:
    """Random draws from the search space by exact AUC over stratified folds, best first; preparation is learned inside each fold."""
    rng = random.Random(seed)
    space = SEARCH_SPACE[name]
    seen: list[dict] = []
    for values in rng.sample(list(itertools.product(*space.values())), min(draws, math.prod(map(len, space.values())))):
        seen.append(dict(zip(space, values)))
    if len(seen) < draws:
        raise ValueError(f"the search space of {name!r} holds {len(seen)} settings, {draws} are asked for")
    aucs: list[list[float | None]] = [[] for _ in seen]
    with cached(fold_column(train.select(*used(roles)), roles.keys, folds, seed, "__fold", roles.target)) as f:
        for k in range(folds):
            rest, held = (f.where(c).drop("__fold") for c in (F.col("__fold") != k, F.col("__fold") == k))
            plan = prep.fit_prep(rest, roles.numeric, roles.categorical, roles.boolean, roles.datetime)
            model = FittedModel(name, roles, plan, None, plan.output_columns())
            label = with_class_weights(model.prepared(rest, [roles.target]).withColumnRenamed(f"__keep_{roles.target}", "label"), "label")
            asm, _ = _stages(name, model.columns, None, seed)
            with cached(asm.transform(label.withColumn("label", F.col("label").cast("double"))).select("label", "weight", "features")) as table:
                for i, params in enumerate(seen):
                    model.pipeline = PipelineModel(stages=[asm, _stages(name, model.columns, params, seed)[1].fit(table)])
                    aucs[i].append(exact_auc(model.score(held), roles.target))
    means = [cv_mean(a) for a in aucs]
    return sorted(zip(seen, means), key=lambda t: -t[1])


def cv_mean(aucs: Sequence[float | None]) -> float:
    ok = [a for a in aucs if a is not None]
    return sum(ok) / len(ok) if ok else float("nan")


def evaluate_oot(df: DataFrame, roles: Roles, ts: str, name: str = "Logistic Regression", params: Mapping | None = None) -> DataFrame:
    """Fit on development rows and evaluate once on the out-of-time rows."""
    parts = oot_split(df, ts)
    m = fit_model(parts.where("part = 'development'").drop("part"), roles, name, params)
    scored = m.score(parts.where("part = 'oot'").drop("part"))
    n = scored.agg(F.count(F.lit(1)).alias("oot_n"))
    met = ev.ladder_metrics(scored, y=roles.target).select(F.round("roc_auc", 4).alias("oot_roc_auc"), F.round("gini", 4).alias("oot_gini"))
    return with_totals(n, met)


def used(roles: Roles) -> list[str]:
    """Columns a refit reads."""
    return list(dict.fromkeys([*roles.keys, roles.target, *roles.features()]))


def three_way(df: DataFrame, roles: Roles, test: float = 0.15, val: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = stratified_split(df, roles.target, roles.keys, test, val, seed)
    return tuple(s.where(F.col("split") == k).drop("split") for k in ("train", "val", "test"))


def compare_models(df: DataFrame, roles: Roles, names: Sequence[str], seed: int = 42) -> DataFrame:
    """Metric row per estimator on the same split with light settings."""
    out = None
    split = stratified_split(df.select(*used(roles)), roles.target, roles.keys, seed=seed)
    test = split.where("split = 'test'").drop("split")
    with cached(split.where("split = 'train'").drop("split")) as train:
        for n in names:
            m = fit_model(train, roles, n, LIGHT.get(n), seed, cache=False)
            row = ev.metric_table(m.score(test), 0.5, y=roles.target).select(F.lit(n).alias("model"), "metric", "value")
            out = row if out is None else out.unionByName(row)
    return out


def importances(model: FittedModel) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, scaled to sum to one, largest first."""
    last = model.pipeline.stages[-1]
    raw = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(sum(raw)) or 1.0
    return sorted(((c, float(v) / total) for c, v in zip(model.columns, raw)), key=lambda t: (-t[1], t[0]))


def importance_table(spark: SparkSession, model: FittedModel) -> DataFrame:
    return spark.createDataFrame([(i + 1, c, round(v, 6)) for i, (c, v) in enumerate(importances(model))], "rank int, feature string, importance double")


def quick_importance(df: DataFrame, numeric: Sequence[str], target: str) -> DataFrame:
    """Absolute logistic coefficients on median-filled standardised numeric columns."""
    med = prep.fit_medians(df, numeric)
    filled = prep.fill_constants(df.where(F.col(target).isNotNull()), med)
    scaled = prep.scale(filled, prep.fit_standard(filled, numeric))
    table = VectorAssembler(inputCols=list(numeric), outputCol="features").transform(scaled).select("features", F.col(target).cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=50).fit(table)
    raw = [abs(float(v)) for v in fitted.coefficients]
    total = sum(raw) or 1.0
    rows = sorted(((c, round(v / total, 6)) for c, v in zip(numeric, raw)), key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


@dataclass
class Replication:
    """Everything a validator needs from a refit with reported settings."""

    model: FittedModel
    train: DataFrame
    test: DataFrame
    scored: DataFrame
    stats: DataFrame


def replicate(
    df: DataFrame, roles: Roles, name: str = "Logistic Regression", params: Mapping | None = None, test: float = 0.15, val: float = 0.15,
    seed: int = 42, engineer: bool = True,
) -> Replication:
    """Clean, split, learn features on train, fit and score the test rows."""
    clean, _ = finalize_xy(df, [], roles.target)
    s = stratified_split(clean, roles.target, roles.keys, test, val, seed)
    train, hold = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    plan = fe.fit_features(train, [c for c in roles.numeric], list(roles.categorical), roles.target) if engineer else None
    m = fit_model(train, roles, name, params, seed, plan)
    return Replication(m, train, hold, m.score(hold), split_stats(s, roles.target))


def seed_aucs(df: DataFrame, roles: Roles, name: str = "Logistic Regression", params: Mapping | None = None, seeds: Sequence[int] = (42, 7, 13, 99, 123)) -> list[float]:
    """Test AUC of a refit per split seed."""
    out = []
    with cached(df.select(*used(roles))) as base:
        for s in seeds:
            # the key hash of a row is worked out once for all scans of a seed
            with cached(stratified_split(base, roles.target, roles.keys, seed=s)) as split:
                train, test = (split.where(F.col("split") == k).drop("split") for k in ("train", "test"))
                out.append(exact_auc(fit_model(train, roles, name, params, s, cache=False).score(test), roles.target))
    return out


def ablation(df: DataFrame, roles: Roles, name: str = "Logistic Regression", params: Mapping | None = None, seed: int = 42) -> dict[str, float]:
    """AUC lost when one feature is removed and the model refitted, largest loss first."""
    out = {}
    with cached(stratified_split(df.select(*used(roles)), roles.target, roles.keys, seed=seed)) as split:
        train, test = (split.where(F.col("split") == k).drop("split") for k in ("train", "test"))
        base = exact_auc(fit_model(train, roles, name, params, seed, cache=False).score(test), roles.target)
        for f in roles.features():
            r = roles.without(f)
            if r.features():
                out[f] = round(base - exact_auc(fit_model(train, r, name, params, seed, cache=False).score(test), roles.target), 4)
    return dict(sorted(out.items(), key=lambda t: -t[1]))


# ---- dataset characteristics ---------------------------------------------


def saturate(x: float, top: float) -> float:
    return max(0.0, min(1.0, x / top)) if top else 0.0


def dataset_characteristics(df: DataFrame, features: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], y: str) -> dict[str, float]:
    """Size, width, missing, imbalance, categorical share, collinear share and non-linearity, each 0..1."""
    import math

    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"),
        *[F.count(F.col(c)).alias(f"c__{c}") for c in features],
    ).first()
    n = r["n"]
    miss = 100 * sum(1 - r[f"c__{c}"] / n for c in features) / len(features) if n else 0.0
    lo, hi = sorted((r["n0"], r["n1"]))
    ratio = hi / lo if lo else 1.0
    corr = correlation_values(df, list(numeric))
    pairs = [abs(corr[(a, b)]) for i, a in enumerate(numeric) for b in numeric[i + 1 :] if corr[(a, b)] is not None]
    collinear = 100 * sum(v > 0.8 for v in pairs) / len(pairs) if pairs else 0.0
    lin = df.agg(*[safe_corr(F.col(c).cast("double"), F.col(y).cast("double")).alias(c) for c in numeric]).first()
    linear = sum(abs(lin[c]) if lin[c] is not None and lin[c] == lin[c] else 0.0 for c in numeric) / len(numeric)
    q = exact_quantiles(df, numeric, [0.5])
    filled = df.select(y, *[F.coalesce(F.col(c).cast("double"), F.lit(q[c][0] or 0.0)).alias(c) for c in numeric])
    mi = binned_mutual_information(filled, numeric, y).agg(F.avg("mi")).first()[0] or 0.0
    return {
        "size": saturate(math.log10(max(n, 1) + 1), 5.0),
        "dimensionality": saturate(len(features), 100.0),
        "missingness": saturate(miss, 30.0),
        "imbalance": saturate(ratio - 1.0, 9.0),
        "categorical": len(categorical) / len(features),
        "multicollinearity": saturate(collinear, 40.0),
        "nonlinearity": max(0.0, min(1.0, saturate(mi, 0.15) - linear)),
    }


def characteristics_table(df: DataFrame, features: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], y: str) -> DataFrame:
    rows = [(k, round(float(v), 6)) for k, v in dataset_characteristics(df, features, numeric, categorical, y).items()]
    return df.sparkSession.createDataFrame(rows, "characteristic string, score double")
