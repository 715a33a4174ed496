"""Regression and multiclass models through the same preparation plans as the binary ones.

A regression predicts a number; its split is by row hash alone and its rows are weighted alike. A multiclass model
predicts one of the sorted classes seen in train, with balanced class weights, and gives every class a
probability. Both are ``FittedModel`` objects: they save, load and score any table or stream alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanforge.operators import evaluate as ev
from loanforge.operators import prep
from loanforge.operators.models import FittedModel, Roles, cached, used
from loanforge.operators.splits import stratified_split, with_class_weights

#: Classes of a multiclass model at most: one column of coefficients or one cell of every tree node each.
MAX_CLASSES = 100

REGRESSORS = {
    "Linear Regression": lambda p, seed: LinearRegression(**({"regParam": 0.0, "solver": "normal"} | p)),
    "Random Forest Regressor": lambda p, seed: RandomForestRegressor(**({"numTrees": 50, "maxDepth": 6, "seed": seed} | p)),
    "Decision Tree Regressor": lambda p, seed: DecisionTreeRegressor(**({"maxDepth": 5, "seed": seed} | p)),
    "Gradient Boosting Regressor": lambda p, seed: GBTRegressor(**({"maxIter": 20, "maxDepth": 4, "seed": seed} | p)),
}
CLASSIFIERS = {
    "Logistic Regression": lambda p, seed: LogisticRegression(**({"maxIter": 100, "regParam": 0.01, "family": "multinomial"} | p)),
    "Random Forest": lambda p, seed: RandomForestClassifier(**({"numTrees": 50, "maxDepth": 6, "seed": seed} | p)),
    "Decision Tree": lambda p, seed: DecisionTreeClassifier(**({"maxDepth": 5, "seed": seed} | p)),
}
BY_TASK = {"regression": REGRESSORS, "multiclass": CLASSIFIERS}


def classes_of(train: DataFrame, target: str) -> list[str]:
    """Sorted classes of the target as text."""
    found = [r["c"] for r in train.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c")).distinct().limit(MAX_CLASSES + 1).collect()]
    if not 2 <= len(found) <= MAX_CLASSES:
        raise ValueError(f"a multiclass target has 2 to {MAX_CLASSES} classes, {target!r} has {'more' if len(found) > MAX_CLASSES else len(found)}")
    return sorted(found)


def fit_task_model(
    train: DataFrame, roles: Roles, task: str, name: str | None = None, params: Mapping | None = None, seed: int = 42,
    transform_choices: Mapping[str, str] | None = None, cache: bool = True,
) -> FittedModel:
    """Prepare and fit for ``regression`` or ``multiclass``; all constants come from ``train``."""
    if task not in BY_TASK:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(BY_TASK)}")
    name = name or next(iter(BY_TASK[task]))
    if name not in BY_TASK[task]:
        raise ValueError(f"unknown estimator {name!r} for {task}; known: {', '.join(BY_TASK[task])}")
    slim = train.where(F.col(roles.target).isNotNull()).select(*dict.fromkeys([roles.target, *roles.features()]))
    if cache:
        slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = classes_of(slim, roles.target) if task == "multiclass" else []
        plan = prep.fit_prep(slim, roles.numeric, roles.categorical, roles.boolean, roles.datetime, transform_choices)
        columns = plan.output_columns()
        model = FittedModel(name, roles, plan, None, columns, task=task, classes=tuple(classes))
        rows = model.prepared(slim, [roles.target]).withColumnRenamed(f"__keep_{roles.target}", "label")
        if task == "multiclass":
            place = F.array_position(F.array(*map(F.lit, classes)), F.col("label").cast("string")) - 1
            rows = with_class_weights(rows.withColumn("label", place.cast("double")), "label")
        else:
            rows = rows.withColumns({"label": F.col("label").cast("double"), "weight": F.lit(1.0)})
        asm = VectorAssembler(inputCols=[f"f_{c}" for c in columns], outputCol="features", handleInvalid="error")
        est = BY_TASK[task][name](dict(params or {}), seed).setFeaturesCol("features").setLabelCol("label").setWeightCol("weight")
        with cached(asm.transform(rows).select("label", "weight", "features")) as table:
            model.pipeline = PipelineModel(stages=[asm, est.fit(table)])
        return model
    finally:
        if cache:
            slim.unpersist()


def split_for(df: DataFrame, roles: Roles, task: str, seed: int = 42) -> DataFrame:
    """Train, val and test by row hash; within every class of a multiclass target."""
    if task == "multiclass":
        return stratified_split(df, roles.target, roles.keys, seed=seed)
    one = df.where(F.col(roles.target).isNotNull()).withColumn("__one", F.lit(1))
    return stratified_split(one, "__one", roles.keys, seed=seed).drop("__one")


def multiclass_metrics(scored: DataFrame, y: str) -> DataFrame:
    """``metric`` and ``value``: accuracy, macro and weighted precision, recall and F1, log loss, and the mean one-against-rest AUC.

    ``scored`` has the true class ``y``, the predicted class ``prediction`` and ``probabilities`` by class.
    The class counts come from one shuffle of at most classes squared cells; a class that is never predicted has precision 0.
    """
    truth = F.col(y).cast("string")
    ok = scored.where(truth.isNotNull())
    cells = ok.groupBy(truth.alias("t"), F.col("prediction").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("q").alias("c"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit"))))
    per = cells.select(side.alias("s")).select("s.*").groupBy("c").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"p": ratio(F.col("hit"), F.col("said")), "r": ratio(F.col("hit"), F.col("true"))})
    per = per.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    mean = lambda c: F.avg(c)
    weighted = lambda c: F.sum(F.col(c) * F.col("true")) / F.sum("true")
    means = per.agg(
        (F.sum("hit") / F.sum("true")).alias("accuracy"), *[mean(c).alias(f"macro_{m}") for c, m in zip("prf", ("precision", "recall", "f1"))],
        *[weighted(c).alias(f"weighted_{m}") for c, m in zip("prf", ("precision", "recall", "f1"))],
    )
    given = F.try_element_at(F.col("probabilities"), truth)
    loss = ok.agg(F.avg(-F.log(F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(1e-15)))).alias("log_loss"))
    each = ok.select(truth.alias("t"), F.explode("probabilities").alias("c", "p")).select("c", (F.col("t") == F.col("c")).cast("int").alias("y"), "p")
    auc = ev.ladder_metrics(each, by=["c"]).agg(F.avg("roc_auc").alias("roc_auc_ovr"))
    wide = means.crossJoin(loss).crossJoin(auc)  # one row each
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("value")) for c in wide.columns]))
    return wide.select(items.alias("s")).select("s.*")


def regression_table(scored: DataFrame, y: str) -> DataFrame:
    """``metric`` and ``value`` of a scored regression."""
    wide = ev.regression_metrics(scored, y, "prediction")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns])).alias("s")).select("s.*")


def task_metrics(scored: DataFrame, y: str, task: str) -> DataFrame:
    return multiclass_metrics(scored, y) if task == "multiclass" else regression_table(scored, y)


def compare_task_models(df: DataFrame, roles: Roles, task: str, names: Sequence[str] | None = None, params: Mapping[str, Mapping] | None = None, seed: int = 42) -> DataFrame:
    """Metric rows per estimator on the test part of one split."""
    split = split_for(df.select(*used(roles)), roles, task, seed)
    test = split.where("split = 'test'").drop("split")
    rows = []
    with cached(split.where("split = 'train'").drop("split")) as train:
        for n in names or BY_TASK[task]:
            m = fit_task_model(train, roles, task, n, (params or {}).get(n), seed, cache=False)
            rows.append(task_metrics(m.score(test), roles.target, task).select(F.lit(n).alias("model"), "metric", "value"))
    return reduce(DataFrame.unionByName, rows)
