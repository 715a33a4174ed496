"""Binning, weight of evidence, information value, interactions, redundancy and the feature plan.

Everything is learned on the frame handed to ``fit`` (train) and replayed as
Column expressions on any other frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.functions.expressions import bin_right_closed, name_key
from loanforge.operators.codes import CodeTable, attach_all, detach_all, fit_code_table, wide_columns
from loanforge.operators.ordering import exact_quantiles, value_shares
from loanforge.operators.profile import correlation_values, value_counts
from loanforge.operators.roles import late_origin_columns, more_distinct_than, post_default_columns

EPS = 0.5
MISSING_CODE = -2
UNSEEN_CODE = -1
MISSING_LABEL = "__MISSING__"
# Selection limits of the interaction search and the plan.
TOP_FEATURES = 8
MAX_INTERACTIONS = 10
MIN_INTERACTION_IV = 0.02
LOW_IV = 0.02
MAX_PAIR_CARDINALITY = 8
REDUNDANT_CORR = 0.90
# Column-name parts of known banking interactions.
DOMAIN_PAIRS = [
    (("ltv", "loantovalue"), ("creditscore", "ficoscore", "bureauscore", "cibil", "riskscore")),
    (("income", "annualincome", "grossincome", "monthlyincome"), ("dti", "debttoincome", "debttoincomeratio")),
    (("age",), ("employmentlength", "employmentyears", "yearsemployed", "tenure")),
    (("loanamount", "principal", "creditlimit", "sanctioned"), ("income", "annualincome", "grossincome")),
    (("creditscore", "ficoscore", "bureauscore"), ("numlatepayments", "delinquencycount", "numcreditinquiries", "numinquiries")),
]


@dataclass(frozen=True)
class Bucketer:
    """Train-learned buckets: open-ended right-closed edges, distinct numbers, or categories."""

    kind: str
    edges: tuple[float, ...] = ()
    values: tuple[float, ...] = ()
    categories: tuple[str, ...] = ()
    #: Of a column with more categories than a list holds; its codes are there once the table is attached.
    table: CodeTable | None = None

    def code(self, c: Column) -> Column:
        """Bucket number; -2 for missing numbers, -1 for values not seen in train."""
        if self.table is not None:
            return self.table.value("code", UNSEEN_CODE)
        if self.kind == "category":
            v = F.coalesce(c.cast("string"), F.lit(MISSING_LABEL))
            if not self.categories:
                return F.lit(UNSEEN_CODE)
            codes = F.create_map(*[x for i, k in enumerate(self.categories) for x in (F.lit(k), F.lit(i))])
            return F.coalesce(F.try_element_at(codes, v), F.lit(UNSEEN_CODE))
        x = c.cast("double")
        if self.edges:
            return F.when(x.isNull(), F.lit(MISSING_CODE)).otherwise(bin_right_closed(x, self.edges, open_ends=True))
        out = F.when(x.isNull(), F.lit(MISSING_CODE))
        for i, v in enumerate(self.values):
            out = out.when(F.round(x, 6) == F.lit(v), F.lit(i))
        return out.otherwise(F.lit(UNSEEN_CODE))


def fit_numeric_bucketers(df: DataFrame, cols: Sequence[str], max_bins: int = 5) -> dict[str, Bucketer]:
    """Quantile edges on non-null values; few distinct values become their own buckets."""
    cols = list(cols)
    if not cols:
        return {}
    est = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if est[c] <= 4 * max_bins]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:
        rounded = df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in few])
        for r in value_counts(rounded, few).select("feature", "value").collect():  # a handful of values per column
            values[r["feature"]].append(float(r["value"]))
    out = {c: Bucketer("numeric", values=tuple(sorted(v))) for c, v in values.items() if len(v) <= max_bins}
    rest = [c for c in cols if c not in out]
    q = exact_quantiles(df, rest, [i / max_bins for i in range(max_bins + 1)]) if rest else {}
    for c in rest:
        edges = sorted({v for v in q[c] if v is not None})
        out[c] = Bucketer("numeric", edges=tuple(edges)) if len(edges) >= 2 else Bucketer("numeric", values=tuple(edges))
    return {c: out[c] for c in cols}


def fit_category_bucketers(df: DataFrame, cols: Sequence[str], y: str | None = None) -> dict[str, Bucketer]:
    """Sorted train categories, nulls as a category of their own; a code table for columns with many (with their weights, given ``y``)."""
    cols = list(cols)
    if not cols:
        return {}
    wide = wide_columns(df, cols)
    out = {c: Bucketer("category", table=fit_code_table(df, c, MISSING_LABEL, y)[0]) for c in wide}
    narrow = [c for c in cols if c not in wide]
    if narrow:
        filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias(c) for c in narrow])
        found: dict[str, list[str]] = {c: [] for c in narrow}
        for r in value_counts(filled, narrow).select("feature", "value").collect():  # short lists
            found[r["feature"]].append(r["value"])
        out |= {c: Bucketer("category", categories=tuple(sorted(v))) for c, v in found.items()}
    return {c: out[c] for c in cols}


def tables_of(specs: Mapping[str, Bucketer]) -> list[CodeTable]:
    return [s.table for s in specs.values() if s.table is not None]


def fit_bucketers(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_bins: int = 5) -> dict[str, Bucketer]:
    return fit_numeric_bucketers(df, numeric, max_bins) | fit_category_bucketers(df, categorical)


def bucketer_table(df: DataFrame, specs: Mapping[str, Bucketer]) -> DataFrame:
    """Learned edges and values as rows ``(feature, kind, position, edge)``; categories as text."""
    rows = []
    for c, s in specs.items():
        if s.table is not None:
            continue
        if s.kind == "category":
            rows += [(c, "category", i, None, k) for i, k in enumerate(s.categories)]
        elif s.edges:
            rows += [(c, "edge", i, round(float(e), 6), None) for i, e in enumerate(s.edges)]
        else:
            rows += [(c, "value", i, round(float(v), 6), None) for i, v in enumerate(s.values)]
    out = df.sparkSession.createDataFrame(rows, "feature string, kind string, position int, edge double, category string")
    for t in tables_of(specs):
        out = out.unionByName(t.rows.select(F.lit(t.column).alias("feature"), F.lit("category").alias("kind"), F.col("code").cast("int").alias("position"), F.lit(None).cast("double").alias("edge"), "category"))
    return out


def apply_bucketers(df: DataFrame, specs: Mapping[str, Bucketer], suffix: str = "_bin") -> DataFrame:
    tables = tables_of(specs)
    return detach_all(attach_all(df, tables).withColumns({c + suffix: s.code(F.col(c)) for c, s in specs.items()}), tables)


def woe_cells(df: DataFrame, buckets: Mapping[str, Column | Bucketer], y: str = "y") -> DataFrame:
    """``(feature, bucket, good, bad)`` of many columns.

    Bucket expressions are unpivoted and grouped in one shuffle of bucket counts. Bucketers without a code table
    are counted batch by batch instead, so only their cells leave a task.
    """
    coded = {c: b for c, b in buckets.items() if isinstance(b, Bucketer) and b.table is None}
    items = [F.struct(F.lit(c).alias("feature"), (b.code(F.col(c)) if isinstance(b, Bucketer) else b).cast("string").alias("bucket")) for c, b in buckets.items() if c not in coded]
    parts = [bucketer_cells(df, coded, y)] if coded else []
    if items:
        parts.append(
            df.where(F.col(y).isNotNull())
            .select(F.col(y).cast("int").alias("__y"), F.explode(F.array(*items)).alias("s"))
            .select("__y", "s.*")
            .groupBy("feature", "bucket")
            .agg(F.sum(1 - F.col("__y")).alias("good"), F.sum("__y").alias("bad"))
        )
    return reduce(DataFrame.unionByName, parts)


def bucketer_cells(df: DataFrame, specs: Mapping[str, Bucketer], y: str = "y") -> DataFrame:
    """Cells of bucketers as :func:`woe_cells` gives them: codes of an Arrow batch at once, as :meth:`Bucketer.code` gives them."""
    names, kinds = list(specs), list(specs.values())

    def handed(c: str, s: Bucketer) -> Column:
        if s.kind == "category":
            return s.code(F.col(c))
        x = F.col(c).cast("double")
        return x if s.edges else F.round(x, 6)

    def codes(x: pa.Array, s: Bucketer) -> np.ndarray:
        missing = x.is_null().to_numpy(zero_copy_only=False)
        v = x.to_numpy(zero_copy_only=False)
        if s.kind == "category":
            return v
        if s.edges:
            out = np.searchsorted(np.array(s.edges[1:-1], dtype=float), v, side="left")
        else:
            out = np.full(len(v), UNSEEN_CODE)
            for i, k in reversed(list(enumerate(s.values))):
                out[np.isnan(v) if k != k else v == k] = i
        return np.where(missing, MISSING_CODE, out)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(0) for _ in names]
        bad = [np.zeros(0) for _ in names]
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False)
            for i, s in enumerate(kinds):
                at = codes(batch.column(i + 1), s) - MISSING_CODE
                size = max(len(n[i]), int(at.max(initial=0)) + 1)
                n[i], bad[i] = (np.pad(x, (0, size - len(x))) for x in (n[i], bad[i]))
                n[i] += np.bincount(at, minlength=size)
                bad[i] += np.bincount(at, weights=target, minlength=size)
        held = [np.flatnonzero(x) for x in n]
        f = np.repeat(np.arange(len(names), dtype=np.int32), [len(h) for h in held])
        pick = lambda xs: np.concatenate([x[h] for x, h in zip(xs, held)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array((np.concatenate(held) + MISSING_CODE).astype(np.int32)), pa.array(pick(n)), pa.array(pick(bad))], names=["f", "b", "n", "bad"])

    rows = df.where(F.col(y).cast("int").isNotNull()).select(F.col(y).cast("int").alias("__y"), *[handed(c, s).alias(f"v{i}") for i, (c, s) in enumerate(specs.items())])
    cells = rows.mapInArrow(counted, "f int, b int, n bigint, bad bigint").groupBy("f", "b").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    feature = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("f") + 1)
    return cells.select(feature.alias("feature"), F.col("b").cast("string").alias("bucket"), (F.col("n") - F.col("bad")).alias("good"), "bad")


def woe_table(cells: DataFrame) -> DataFrame:
    """Weight of evidence ln(good share / bad share) and IV part per cell, +0.5 smoothing."""
    w = Window.partitionBy("feature")
    k = F.count(F.lit(1)).over(w)
    g = (F.col("good") + EPS) / (F.sum("good").over(w) + EPS * k)
    b = (F.col("bad") + EPS) / (F.sum("bad").over(w) + EPS * k)
    return cells.withColumns({"woe": F.log(g / b), "iv_part": (g - b) * F.log(g / b)})


def iv_table(cells: DataFrame) -> DataFrame:
    """IV per feature, floored at 0, strongest first by value."""
    s = woe_table(cells).groupBy("feature").agg(
        F.sum("iv_part").alias("iv"), F.count(F.lit(1)).alias("n_buckets"), F.sum("good").alias("g"), F.sum("bad").alias("b")
    )
    return s.where("g > 0 and b > 0").select("feature", F.round(F.greatest("iv", F.lit(0.0)), 5).alias("iv"), "n_buckets")


def information_value(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y", max_bins: int = 5
) -> DataFrame:
    """IV of every column; categories need no list, so any cardinality works."""
    specs = fit_numeric_bucketers(df, numeric, max_bins)
    buckets: dict[str, Column | Bucketer] = dict(specs)
    buckets |= {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)) for c in categorical}
    return iv_table(woe_cells(df, buckets, y))


def information_value_unsmoothed(df: DataFrame, numeric: Sequence[str], y: str = "y", n_bins: int = 10) -> DataFrame:
    """Review variant: ten quantile bins, cells with a zero count dropped, flag below 0.02."""
    q = exact_quantiles(df, numeric, [i / n_bins for i in range(n_bins + 1)])
    buckets = {
        c: bin_right_closed(F.col(c).cast("double"), sorted({v for v in q[c] if v is not None})) for c in numeric
    }
    whole = df.agg(F.sum(F.col(y)).cast("double").alias("e"), F.sum(1 - F.col(y)).cast("double").alias("n")).first()
    cells = woe_cells(df, buckets, y).where("bucket is not null and good > 0 and bad > 0")
    e, n = F.col("bad") / F.lit(whole["e"]), F.col("good") / F.lit(whole["n"])
    g = cells.groupBy("feature").agg(F.sum((e - n) * F.log(e / n)).alias("iv"), F.count(F.lit(1)).alias("bins"))
    return g.select("feature", F.round("iv", 5).alias("iv"), "bins", (F.col("iv") < LOW_IV).alias("low_iv"))


def binned_mutual_information(df: DataFrame, numeric: Sequence[str], y: str = "y", max_bins: int = 5) -> DataFrame:
    """Plug-in mutual information on quantile buckets (not the nearest-neighbour estimate)."""
    specs = fit_numeric_bucketers(df, numeric, max_bins)
    cells = woe_cells(df, specs, y)
    w = Window.partitionBy("feature")
    whole = cells.withColumns({"tg": F.sum("good").over(w), "tb": F.sum("bad").over(w)})
    sides = [
        F.struct(
            F.col(k).alias("c"), (F.col("good") + F.col("bad")).alias("m"), F.col(t).alias("t"), (F.col("tg") + F.col("tb")).cast("double").alias("n")
        )
        for k, t in (("good", "tg"), ("bad", "tb"))
    ]
    rows = whole.select("feature", F.explode(F.array(*sides)).alias("s")).select("feature", "s.*")
    term = F.when(F.col("c") > 0, F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("m") * F.col("t")))).otherwise(0.0)
    return rows.groupBy("feature").agg(F.round(F.sum(term), 5).alias("mi"))


# ---- collinearity --------------------------------------------------------


def correlation_array(df: DataFrame, cols: Sequence[str], medians: Mapping[str, float] | None = None) -> np.ndarray:
    """Correlation matrix (columns squared) with nulls at the median."""
    if medians is None:
        q = exact_quantiles(df, cols, [0.5])
        medians = {c: q[c][0] or 0.0 for c in cols}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(c) for c in cols])
    values = correlation_values(filled, cols)
    m = np.eye(len(cols))
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i != j:
                m[i, j] = values[(a, b)] or 0.0
    return m


def vif(corr: np.ndarray) -> list[float]:
    """Diagonal of the inverse correlation matrix, i.e. 1 / (1 - R2) of each column on the others."""
    inv = np.linalg.pinv(corr + np.eye(len(corr)) * 1e-6)
    return [float(max(inv[i, i], 0.0)) for i in range(len(corr))]


def multicollinearity(df: DataFrame, cols: Sequence[str], threshold: float = 0.90) -> tuple[list[tuple[str, str, float]], dict[str, float]]:
    """High pairs (earlier, later, correlation) and VIF per column."""
    if len(cols) < 2:
        return [], {}
    m = correlation_array(df, cols)
    pairs = [(cols[i], cols[j], round(float(m[i, j]), 4)) for j in range(len(cols)) for i in range(j) if abs(m[i, j]) >= threshold]
    return pairs, {c: round(v, 3) for c, v in zip(cols, vif(m))}


def multicollinearity_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.90) -> DataFrame:
    pairs, _ = multicollinearity(df, cols, threshold)
    return df.sparkSession.createDataFrame(pairs, "feature_1 string, feature_2 string, correlation double")


def vif_table(df: DataFrame, cols: Sequence[str], flag_above: float = 10.0) -> DataFrame:
    _, v = multicollinearity(df, cols)
    return df.sparkSession.createDataFrame([(c, x, x > flag_above) for c, x in v.items()], "feature string, vif double, high boolean")


def near_constant(df: DataFrame, numeric: Sequence[str], above: float = 0.99) -> DataFrame:
    """Columns of at most one distinct value or one value on more than 99% of non-null rows."""
    # numbers that a double holds exactly travel as such, others as text
    plain = [f.name for f in df.select(*numeric).schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType))]
    rows = [(c, k, share) for c, (k, share) in value_shares(df, plain).items() if k]
    vc = df.sparkSession.createDataFrame(rows, "feature string, unique bigint, share double")
    if other := [c for c in numeric if c not in plain]:
        vc = vc.unionByName(value_counts(df, other).groupBy("feature").agg(F.count(F.lit(1)).alias("unique"), (F.max("n") / F.sum("n")).alias("share")))
    names = df.sparkSession.createDataFrame([(c,) for c in numeric], "feature string")
    return names.join(vc, "feature", "left").select(
        "feature",
        F.coalesce("unique", F.lit(0)).alias("unique"),
        F.round("share", 6).alias("top_share"),
        ((F.coalesce("unique", F.lit(0)) <= 1) | (F.coalesce("share", F.lit(1.0)) > above)).alias("near_constant"),
    )


# ---- encodings by table --------------------------------------------------


def frequency_table(train: DataFrame, col: str) -> DataFrame:
    """Share of each category among non-null train rows."""
    g = train.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("t")).first()["t"] or 1
    return g.select("category", (F.col("n") / F.lit(float(total))).alias("share"))


def encode_by_table(df: DataFrame, table: DataFrame, col: str, out: str, value: str, default: float = 0.0) -> DataFrame:
    """Left join of a learned ``(category, value)`` table; unseen and null give ``default``.

    No broadcast hint: Spark broadcasts the table only when its measured size allows.
    """
    t = table.select(F.col("category").alias("__c"), F.col(value).alias("__v"))
    return (
        df.join(t, F.col(col).cast("string") == F.col("__c"), "left")
        .withColumn(out, F.coalesce("__v", F.lit(default)))
        .drop("__c", "__v")
    )


def frequency_encode(df: DataFrame, train: DataFrame, col: str) -> DataFrame:
    return encode_by_table(df, frequency_table(train, col), col, f"{col}_freq", "share")


# ---- interactions --------------------------------------------------------


@dataclass(frozen=True)
class Interaction:
    name: str
    a: str
    b: str
    kind: str
    source: str = "ranked"
    iv: float = 0.0
    gini: float | None = None


@dataclass(frozen=True)
class WoeMaps:
    """Bucketers and bucket-to-weight maps of the encoded columns."""

    specs: dict[str, Bucketer]
    maps: dict[str, dict[int, float]]

    def column(self, c: str) -> Column:
        if self.specs[c].table is not None:
            return self.specs[c].table.value("woe", 0.0)
        m = self.maps[c]
        if not m:
            return F.lit(0.0)
        lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(int(k)), F.lit(float(v)))])
        return F.coalesce(F.try_element_at(lut, self.specs[c].code(F.col(c))), F.lit(0.0))


def fit_woe(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y") -> tuple[WoeMaps, dict[str, float]]:
    """WOE maps and IV of all columns: one grouped count, and one for each column with many categories."""
    wide = {c: fit_code_table(df, c, MISSING_LABEL, y) for c in wide_columns(df, categorical)}
    narrow = fit_bucketers(df, numeric, [c for c in categorical if c not in wide])
    specs = {c: narrow.get(c) or Bucketer("category", table=wide[c][0]) for c in [*numeric, *categorical]}
    maps: dict[str, dict[int, float]] = {c: {} for c in specs}
    iv: dict[str, float] = {c: wide[c][1] if c in wide else 0.0 for c in specs}
    if narrow:
        table = woe_table(woe_cells(df, narrow, y)).collect()  # columns x buckets
        for r in table:
            maps[r["feature"]][int(r["bucket"])] = r["woe"]
            iv[r["feature"]] += r["iv_part"]
    return WoeMaps(specs, maps), {c: round(max(v, 0.0), 5) for c, v in iv.items()}


Generator = Callable[[Sequence[str], Sequence[str], Mapping[str, int], Sequence[str]], list[Interaction]]


def numeric_pairs(numeric, categorical, cardinality, columns):
    return [Interaction(f"{a}_x_{b}", a, b, "numeric_numeric") for a, b in combinations(numeric, 2)]


def numeric_woe_pairs(numeric, categorical, cardinality, columns):
    return [Interaction(f"{a}_x_{b}_WOE", a, b, "numeric_woe") for a in numeric for b in categorical]


def woe_pairs(numeric, categorical, cardinality, columns):
    low = [c for c in categorical if cardinality.get(c, 0) <= MAX_PAIR_CARDINALITY]
    return [Interaction(f"{a}_WOE_x_{b}_WOE", a, b, "woe_woe") for a, b in combinations(low, 2)]


def domain_pairs(numeric, categorical, cardinality, columns):
    """Known banking pairs by name, over all numeric columns of the table."""
    keys = {name_key(c): c for c in columns}
    out = []
    for left, right in DOMAIN_PAIRS:
        a = next((c for k, c in keys.items() if any(s in k for s in left)), None)
        b = next((c for k, c in keys.items() if any(s in k for s in right)), None)
        if a and b and a != b:
            out.append(Interaction(f"{a}_x_{b}", a, b, "numeric_numeric", "domain"))
    return out


GENERATORS: list[Generator] = [numeric_pairs, numeric_woe_pairs, woe_pairs, domain_pairs]


def interaction_column(i: Interaction, woe: WoeMaps) -> Column:
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    a = woe.column(i.a) if i.kind == "woe_woe" else num(i.a)
    b = num(i.b) if i.kind == "numeric_numeric" else woe.column(i.b)
    return a * b


def interaction_candidates(
    numeric: Sequence[str], categorical: Sequence[str], iv: Mapping[str, float], cardinality: Mapping[str, int],
    top: int = TOP_FEATURES, generators: Sequence[Generator] = tuple(GENERATORS),
) -> list[Interaction]:
    """Pairs over the ``top`` columns by IV from every registered generator."""
    ranked = sorted((c for c in [*numeric, *categorical] if c in iv), key=lambda c: -iv[c])[:top]
    num, cat = [c for c in ranked if c in numeric], [c for c in ranked if c in categorical]
    seen: dict[str, Interaction] = {}
    for g in generators:
        for i in g(num, cat, cardinality, list(numeric)):
            seen.setdefault(i.name, i)
    return list(seen.values())


def score_interactions(df: DataFrame, candidates: Sequence[Interaction], woe: WoeMaps, y: str = "y") -> DataFrame:
    """IV and Gini of every candidate, all candidates in the same few jobs."""
    from loanforge.operators.evaluate import univariate_gini

    names = [i.name for i in candidates]
    df = attach_all(df, tables_of(woe.specs))
    wide = df.select(y, *[interaction_column(i, woe).alias(i.name) for i in candidates])
    return information_value(wide, names, [], y).select("feature", "iv").join(univariate_gini(wide, names, y), "feature")


def select_interactions(
    df: DataFrame, candidates: Sequence[Interaction], woe: WoeMaps, numeric: Sequence[str], y: str = "y",
    min_iv: float = MIN_INTERACTION_IV, limit: int | None = MAX_INTERACTIONS, corr: float = REDUNDANT_CORR,
) -> list[Interaction]:
    """IV gate, best by Gini, then a greedy redundancy filter against columns and kept pairs."""
    if not candidates:
        return []
    scores = {r["feature"]: (r["iv"], r["gini"]) for r in score_interactions(df, candidates, woe, y).collect()}
    good = [Interaction(i.name, i.a, i.b, i.kind, i.source, *scores[i.name]) for i in candidates if i.name in scores and scores[i.name][0] >= min_iv]
    best = sorted(good, key=lambda i: (-(i.gini if i.gini is not None else i.iv), i.name))[:limit]
    if not best:
        return []
    df = attach_all(df, tables_of(woe.specs))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[interaction_column(i, woe).alias(i.name) for i in best])
    r = correlation_values(wide, [*numeric, *[i.name for i in best]])
    kept: list[Interaction] = []
    for i in best:
        others = [*numeric, *[k.name for k in kept]]
        if all(r.get((i.name, o)) is None or abs(r[(i.name, o)]) <= corr for o in others):
            kept.append(i)
    return kept


# ---- plan ----------------------------------------------------------------


@dataclass(frozen=True)
class FeaturePlan:
    """Feature steps learned on train; small values only."""

    log_cols: tuple[str, ...] = ()
    interactions: tuple[Interaction, ...] = ()
    bins: dict[str, Bucketer] = field(default_factory=dict)
    frequencies: dict[str, dict[str, float]] = field(default_factory=dict)
    woe: WoeMaps = field(default_factory=lambda: WoeMaps({}, {}))
    woe_cols: tuple[str, ...] = ()
    iv: dict[str, float] = field(default_factory=dict)
    low_iv: tuple[str, ...] = ()
    low_variance: tuple[str, ...] = ()
    high_corr: tuple[tuple[str, str, float], ...] = ()
    vif: dict[str, float] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    woe_only: tuple[str, ...] = ()
    confirmed_drop: tuple[str, ...] | None = None

    def dropped(self, columns: Sequence[str]) -> list[str]:
        """Columns removed at apply time: of a correlated pair the earlier one goes."""
        if self.confirmed_drop is not None:
            names = list(self.confirmed_drop)
        else:
            names = [*dict.fromkeys([a for a, _, _ in self.high_corr] + list(self.low_variance) + list(self.low_iv))]
        return [c for c in names if c in columns]

    def steps(self) -> list[tuple[str, str]]:
        """Decision log: (step, column)."""
        rows = [("log_transform", c) for c in self.log_cols] + [("interaction", i.name) for i in self.interactions]
        rows += [("quantile_binning", c) for c in self.bins] + [("frequency_encoding", c) for c in self.frequencies]
        rows += [("woe_encoding", c) for c in self.woe_cols] + [("low_iv", c) for c in self.low_iv]
        rows += [("near_constant", c) for c in self.low_variance] + [("multicollinearity", a) for a, _, _ in self.high_corr]
        return rows


def fit_features(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y",
    transform_choices: Mapping[str, str] | None = None, woe_only: Sequence[str] = (),
    binned: int | None = None, woe_features: int | None = None, interactions: int | None = None, interaction_pool: int | None = TOP_FEATURES,
) -> FeaturePlan:
    """Learn all feature steps on train only; the columns in use are cached while learning.

    All wide numeric columns are binned, all columns of some value weighted and all interactions that
    pass kept; ``binned``, ``woe_features`` and ``interactions`` keep only so many, the best by information value (by
    Gini for interactions). Interactions are sought among the ``interaction_pool`` best columns (None: all; their pairs grow with the square).
    """
    hidden = tuple(late_origin_columns([*numeric, *categorical]))
    num = [c for c in numeric if c not in hidden]
    cat = [c for c in categorical if c not in hidden]
    train = train.select(y, *num, *cat).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_features(train, num, cat, y, transform_choices or {}, woe_only, hidden, binned, woe_features, interactions, interaction_pool)
    finally:
        train.unpersist()


def _fit_features(
    train: DataFrame, num: list[str], cat: list[str], y: str, choices: Mapping[str, str], woe_only: Sequence[str], hidden: tuple[str, ...],
    n_binned: int | None, n_woe: int | None, n_interactions: int | None, pool: int | None,
) -> FeaturePlan:
    many = more_distinct_than(train, num, 20)
    woe, iv = fit_woe(train, num, cat, y)
    ranked = sorted(iv, key=lambda c: -iv[c])
    low = tuple(c for c in ranked if iv[c] < LOW_IV)
    cardinality = {c: woe.specs[c].table.size if woe.specs[c].table else len([k for k in woe.specs[c].categories if k != MISSING_LABEL]) for c in cat}
    cands = interaction_candidates(num, cat, iv, cardinality, top=len(iv) if pool is None else pool)
    freq: dict[str, dict[str, float]] = {}
    for c in cat:
        if woe.specs[c].table is not None:
            freq[c] = {}  # shares are in the code table
        elif cardinality[c] > 8:
            freq[c] = {r["category"]: r["share"] for r in frequency_table(train, c).collect()}
    pairs, v = multicollinearity(train, num)
    const = tuple(r["feature"] for r in near_constant(train, num).where("near_constant").select("feature").collect())
    binned = sorted((c for c in num if c in many), key=lambda c: -iv[c])[:n_binned]
    binned = [c for c in num if c in binned]
    return FeaturePlan(
        log_cols=tuple(c for c in num if choices.get(c) == "log1p"),
        interactions=tuple(select_interactions(train, cands, woe, num, y, limit=n_interactions)),
        bins={c: woe.specs[c] for c in binned},
        frequencies=freq,
        woe=woe,
        woe_cols=tuple(c for c in ranked[:n_woe] if c not in low),
        iv=iv,
        low_iv=low,
        low_variance=const,
        high_corr=tuple(pairs),
        vif=v,
        hidden=hidden,
        woe_only=tuple(woe_only),
    )


def apply_features(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Replay the plan: one projection, and a join for each column with many categories; valid on any split and on a stream."""
    have = set(df.columns)
    columns = df.columns
    df = attach_all(df, [t for t in tables_of(plan.woe.specs) if t.column in have])
    hidden = set(plan.hidden) | set(late_origin_columns(columns)) | set(post_default_columns(columns))
    new: dict[str, Column] = {}
    for c in plan.log_cols:
        if c in have:
            new[f"{c}_log"] = F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))
    for i in plan.interactions:
        if i.a in have and i.b in have:
            new[i.name] = interaction_column(i, plan.woe)
    for c, s in plan.bins.items():
        if c in have:
            new[f"{c}_bin"] = s.code(F.col(c))
    for c, m in plan.frequencies.items():
        if c in have and c in plan.woe.specs and plan.woe.specs[c].table is not None:
            new[f"{c}_freq"] = F.when(F.col(c).isNotNull(), plan.woe.specs[c].table.value("share", 0.0)).otherwise(F.lit(0.0))
        elif c in have and m:
            lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(float(v)))])
            new[f"{c}_freq"] = F.coalesce(F.try_element_at(lut, F.col(c).cast("string")), F.lit(0.0))
    for c in plan.woe_cols:
        if c in have:
            new[f"{c}_woe"] = plan.woe.column(c)
    gone = set(plan.dropped(columns)) | {c for c in plan.woe_only if c in have} | hidden
    return df.select(*[F.col(c) for c in columns if c not in gone], *[v.alias(k) for k, v in new.items() if k not in gone])
