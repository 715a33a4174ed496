"""Table profiling: missingness, duplicates, summaries, correlation, histograms, outliers, leakage.

Reports are long tables with one row per column. Wide inputs are read once per
report; per-value work goes through one map-side-combined ``groupBy(feature, value)``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.functions.expressions import bin_left_closed, corrected_skew, row_repeats, safe_corr, with_totals
from loanforge.operators.ordering import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rows_from(agg: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One wide aggregate row turned into one row per struct."""
    return agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value string, n)`` for the non-null values of many columns in one shuffle."""
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]))
    return (
        df.select(s.alias("s")).select("s.*").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def missingness(df: DataFrame) -> DataFrame:
    """Null count and percent per column plus one ``__total__`` row over all cells."""
    cols = df.columns
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c__{c}") for c in cols])
    n = F.col("n")
    miss = {c: n - F.col(f"c__{c}") for c in cols}
    whole = sum(miss.values(), F.lit(0))
    pct = lambda m, t: F.when(t > 0, F.round(m / t * 100, 4)).otherwise(0.0)
    rows = [
        F.struct(F.lit(c).alias("column"), miss[c].cast("bigint").alias("missing"), pct(miss[c], n).alias("percentage")) for c in cols
    ]
    rows.append(
        F.struct(
            F.lit("__total__").alias("column"), whole.cast("bigint").alias("missing"), pct(whole, n * len(cols)).alias("percentage")
        )
    )
    return rows_from(a, rows)


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to another row beyond the first, and their rate in percent."""
    a = row_repeats(df, cols or df.columns).select("n_rows", F.col("repeats").alias("duplicate_rows"))
    return a.withColumn(
        "duplicate_rate", F.when(F.col("n_rows") > 0, F.round(F.col("duplicate_rows") / F.col("n_rows") * 100, 4)).otherwise(0.0)
    )


def categorical_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, most frequent value (smallest on ties) and its frequency per column."""
    vc = value_counts(df, cols)
    return vc.groupBy(F.col("feature").alias("column")).agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, exact on all rows."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    a = df.agg(
        *[
            x
            for c in cols
            for x in (
                F.count(c).alias(f"n__{c}"), F.avg(c).alias(f"m__{c}"), F.stddev_samp(c).alias(f"s__{c}"),
                F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}"),
            )
        ]
    )
    r3 = lambda x: F.round(x.cast("double"), 3)
    return rows_from(
        a,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n__{c}").alias("count"),
                r3(F.col(f"m__{c}")).alias("mean"),
                r3(F.col(f"s__{c}")).alias("std"),
                r3(F.col(f"lo__{c}")).alias("min"),
                *[r3(F.lit(v)).alias(k) for k, v in zip(("q25", "q50", "q75"), q[c])],
                r3(F.col(f"hi__{c}")).alias("max"),
            )
            for c in cols
        ],
    )


def summary_statistics(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """All columns in one long table; measures that do not apply are null."""
    return numeric_summary(df, numeric).unionByName(categorical_summary(df, categorical), allowMissingColumns=True)


def data_dictionary(df: DataFrame, cols: Sequence[str] | None = None, samples: int = 3) -> DataFrame:
    """missing, percent, unique, min, max, mean and the smallest sample values per column."""
    cols = list(cols or df.columns)
    nums = set(numeric_columns(df))
    vc = value_counts(df, cols)
    uniq = vc.groupBy("feature").agg(F.count(F.lit(1)).alias("unique"))
    w = Window.partitionBy("feature").orderBy("value")
    first = (
        vc.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= samples)
        .groupBy("feature")
        .agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"])).alias("sample_values"))
    )
    num = [c for c in cols if c in nums]
    a = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(c)).alias(f"n__{c}") for c in cols],
        *[x for c in num for x in (F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}"), F.avg(c).alias(f"m__{c}"))],
    )
    r4 = lambda k, c: (F.round(F.col(f"{k}__{c}").cast("double"), 4) if c in nums else F.lit(None).cast("double"))
    base = rows_from(
        a,
        [
            F.struct(
                F.lit(c).alias("column"),
                (F.col("n") - F.col(f"n__{c}")).alias("missing"),
                F.round((F.col("n") - F.col(f"n__{c}")) / F.col("n") * 100, 2).alias("missing_pct"),
                r4("lo", c).alias("min"),
                r4("hi", c).alias("max"),
                r4("m", c).alias("mean"),
            )
            for c in cols
        ],
    )
    return (
        base.join(uniq.withColumnRenamed("feature", "column"), "column", "left")
        .join(first.withColumnRenamed("feature", "column"), "column", "left")
        .withColumn("unique", F.coalesce("unique", F.lit(0)))
    )


def correlation_pairs(df: DataFrame, cols: Sequence[str], digits: int = 4, chunk: int = 300) -> DataFrame:
    """Pearson correlation of every column pair (a before b), pairwise complete.

    Pairs are split over a few wide aggregates so that generated code stays small.
    """
    pairs = list(combinations(cols, 2))
    out = None
    for i in range(0, len(pairs), chunk):
        part = pairs[i : i + chunk]
        a = df.agg(*[safe_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"r{j}") for j, (x, y) in enumerate(part)])
        rows = rows_from(
            a,
            [
                F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(F.coalesce(F.nanvl(F.col(f"r{j}"), F.lit(0.0)), F.lit(0.0)), digits).alias("corr"))
                for j, (x, y) in enumerate(part)
            ],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


class PairMoments:
    """Counts, means and centred second moments of every column pair over the rows where both are present."""

    def __init__(self, d: int):
        self.n, self.mean, self.m2, self.c = (np.zeros((d, d)) for _ in range(4))  # mean and m2 of the row's column

    def add(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, c: np.ndarray, back: np.ndarray | None = None, other: np.ndarray | None = None) -> None:
        """Merge moments of other rows; ``other`` and ``back`` are the means of the column's column here and there (default: transposed)."""
        total = self.n + n
        share = n / np.maximum(total, 1.0)
        delta = np.where(self.n > 0, mean - self.mean, 0.0)
        across = delta.T if back is None else np.where(self.n > 0, back - other, 0.0)
        self.c = self.c + c + delta * across * self.n * share
        self.m2 = self.m2 + m2 + delta * delta * self.n * share
        self.mean = np.where(self.n > 0, self.mean + delta * share, mean)
        self.n = total

    def add_rows(self, x: np.ndarray, there: np.ndarray) -> None:
        """Merge the rows of a block; ``there`` is false for nulls."""
        odd = there & ~np.isfinite(x)
        fine = np.where(there & ~odd, x, np.nan)
        shift = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in fine.T])
        z, m = np.nan_to_num(fine - shift), there.astype(float)
        n, s, q = m.T @ m, z.T @ m, (z * z).T @ m
        at = np.maximum(n, 1.0)
        mean, m2, c = shift[:, None] + s / at, np.maximum(q - s * s / at, 0.0), z.T @ z - s * s.T / at
        for i, j in zip(*np.nonzero((m2 <= 1e-9 * q) & (q > 0))):  # one value on the rows of the pair has no spread at all
            v = x[there[:, i] & there[:, j], i]
            if (v == v[0]).all():
                mean[i, j], m2[i, j], c[i, j], c[j, i] = v[0], 0.0, 0.0, 0.0
        if odd.any():
            bad = (odd.T.astype(float) @ m) > 0
            m2[bad] = np.nan
            c[bad | bad.T] = np.nan
        self.add(n, mean, m2, c)


def correlation_values(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Unrounded correlations as driver values (columns squared, not rows); pairwise complete, None for a column without spread.

    One scan: the moments of all pairs are matrix products per Arrow batch, a task hands on one row per column, and
    these rows are merged column by column.
    """
    cols = list(cols)
    d = len(cols)
    out: dict[tuple[str, str], float | None] = {(x, y): None for x in cols for y in cols if x != y}
    if d < 2:
        return out
    parts = ("n", "mean", "back", "m2", "away", "c")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = PairMoments(d)
        for b in batches:
            if b.num_rows:
                x = np.column_stack([v.to_numpy(zero_copy_only=False) for v in b.columns])
                whole.add_rows(x, np.column_stack([v.is_valid().to_numpy(zero_copy_only=False) for v in b.columns]))
        if whole.n.any():
            found = (whole.n, whole.mean, whole.mean.T, whole.m2, whole.m2.T, whole.c)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32())} | {k: pa.array([list(r) for r in v], pa.list_(pa.float64())) for k, v in zip(parts, found)})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = PairMoments(1), PairMoments(1)  # of the row's column and of the others; arrays of pairs
        for _, r in rows.iterrows():
            n, mean, back, m2, away, c = (np.asarray(r[k], dtype=float) for k in parts)
            here, there = one.mean, two.mean
            one.add(n, mean, m2, c, back, there)
            two.add(n, back, away, c, mean, here)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(one.m2 / one.n * (two.m2 / two.n))
            r = np.where(spread == 0, np.nan, one.c / one.n / spread)
        return pd.DataFrame({"i": [rows["i"].iat[0]], "r": [r.reshape(-1)]})

    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    moments = values.mapInArrow(gathered, "i int, " + ", ".join(f"{k} array<double>" for k in parts))
    for row in moments.groupBy("i").applyInPandas(merged, "i int, r array<double>").collect():
        for j, v in enumerate(row["r"]):
            if row["i"] < j:
                x, y = cols[row["i"]], cols[j]
                out[(x, y)] = out[(y, x)] = None if v is None or v != v else v
    return out


def high_correlation(df: DataFrame, cols: Sequence[str], threshold: float, digits: int = 4) -> DataFrame:
    """Pairs whose absolute correlation exceeds ``threshold``."""
    return correlation_pairs(df, cols, 12).where(F.abs("corr") > threshold).withColumn("corr", F.round("corr", digits))


def leakage_columns(df: DataFrame, numeric: Sequence[str], target: str, threshold: float = 0.95) -> DataFrame:
    """Numeric columns whose absolute correlation with the target exceeds ``threshold``."""
    cols = [c for c in numeric if c != target]
    a = df.agg(*[safe_corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r__{c}") for c in cols])
    rows = rows_from(a, [F.struct(F.lit(c).alias("column"), F.col(f"r__{c}").alias("corr")) for c in cols])
    return rows.where(F.abs(F.nanvl("corr", F.lit(0.0))) > threshold).withColumn("corr", F.round("corr", 4))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max per column, last bin closed, empty bins kept."""
    r = df.agg(*[x for c in cols for x in (F.min(c).cast("double").alias(f"lo__{c}"), F.max(c).cast("double").alias(f"hi__{c}"))]).first()
    live = [c for c in cols if r[f"lo__{c}"] is not None]
    bounds = {}
    for c in live:
        lo, hi = r[f"lo__{c}"], r[f"hi__{c}"]
        bounds[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        bin_left_closed(F.col(c).cast("double"), F.lit(bounds[c][0]), F.lit(bounds[c][1]), bins).alias("bin"),
                    )
                    for c in live
                ]
            )
        ).alias("s")
    ).select("s.*")
    counts = long.where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame(
        [(c, i, bounds[c][0] + (bounds[c][1] - bounds[c][0]) * i / bins, bounds[c][0] + (bounds[c][1] - bounds[c][0]) * (i + 1) / bins) for c in live for i in range(bins)],
        "column string, bin int, lo double, hi double",
    )
    return frame.join(counts, ["column", "bin"], "left").select(
        "column", "bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.coalesce("n", F.lit(0)).alias("count")
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, flag_above: float = 0.02) -> DataFrame:
    """Rows outside ``factor`` interquartile ranges per column."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    live = [c for c in cols if q[c][0] is not None]
    out = {}
    for c in live:
        lo, hi = q[c]
        out[c] = (F.col(c) < lo - factor * (hi - lo)) | (F.col(c) > hi + factor * (hi - lo))
    a = df.agg(*[x for c in live for x in (F.count(c).alias(f"n__{c}"), F.count_if(out[c]).alias(f"o__{c}"))])
    frac = lambda c: F.round(F.col(f"o__{c}") / F.col(f"n__{c}"), 4)
    return rows_from(
        a,
        [
            F.struct(
                F.lit(c).alias("column"), F.col(f"o__{c}").alias("outlier_count"), frac(c).alias("outlier_fraction"),
                (frac(c) > flag_above).alias("has_outliers"),
            )
            for c in live
        ],
    )


def date_integrity(df: DataFrame, cols: Sequence[str], as_of: dt.date) -> DataFrame:
    """min, max, dates after ``as_of`` and dates before 1900 per date column."""
    a = df.agg(
        *[
            x
            for c in cols
            for x in (
                F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}"),
                F.count_if(F.col(c) > F.lit(as_of)).alias(f"f__{c}"), F.count_if(F.year(c) < 1900).alias(f"a__{c}"),
            )
        ]
    )
    return rows_from(
        a,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.date_format(f"lo__{c}", "yyyy-MM-dd").alias("min_date"),
                F.date_format(f"hi__{c}", "yyyy-MM-dd").alias("max_date"),
                F.col(f"f__{c}").alias("future_count"),
                F.col(f"a__{c}").alias("ancient_count"),
            )
            for c in cols
        ],
    )


def class_distribution(df: DataFrame, target: str, flag_above: float = 3.0) -> DataFrame:
    """Rows per class with the max/min ratio and the imbalance flag on every row."""
    g = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("class").isNotNull(), F.col("n"))
    t = g.agg(F.when(F.count(seen) >= 2, F.round(F.max(seen) / F.min(seen), 2)).alias("imbalance_ratio"))
    return with_totals(g, t).withColumn("is_imbalanced", F.coalesce(F.col("imbalance_ratio") > flag_above, F.lit(False)))


def preview(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by key: a partial top-n per task, then a merge."""
    return df.orderBy(*key).limit(n)


def categorical_analysis(df: DataFrame, cols: Sequence[str], onehot_max: int = 8) -> DataFrame:
    """missing share, cardinality, binary flag, encoder, top share and share spread per column."""
    s = value_counts(df, cols).groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.max("n").alias("hi"), F.min("n").alias("lo")
    )
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"n__{c}") for c in cols])
    base = rows_from(a, [F.struct(F.lit(c).alias("feature"), (1 - F.col(f"n__{c}") / F.col("n")).alias("m")) for c in cols])
    k = F.coalesce("k", F.lit(0))
    return base.join(s, "feature", "left").select(
        F.col("feature").alias("column"),
        F.round("m", 6).alias("missing_pct"),
        k.alias("cardinality"),
        (k == 2).alias("is_binary"),
        F.when(k <= onehot_max, "onehot").otherwise("ordinal").alias("encoding"),
        F.round(F.coalesce(F.col("hi") / F.col("t"), F.lit(1.0)), 6).alias("top_freq"),
        F.round(F.when(k > 1, (F.col("hi") - F.col("lo")) / F.col("t")).otherwise(0.0), 6).alias("freq_imbalance"),
    )


def numeric_analysis(df: DataFrame, cols: Sequence[str], transforms: dict[str, str] | None = None) -> DataFrame:
    """missing share, corrected skew, 3-IQR outlier share, scaler and safety-net imputer per column."""
    transforms = transforms or {}
    q = exact_quantiles(df, cols, [0.25, 0.75])
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.col(c).cast("double")
        lo, hi = q[c]
        far = (
            F.count_if((x < lo - 3 * (hi - lo)) | (x > hi + 3 * (hi - lo)))
            if lo is not None and hi > lo
            else F.lit(0)
        )
        aggs += [F.count(x).alias(f"n__{c}"), corrected_skew(x).alias(f"s__{c}"), far.alias(f"o__{c}")]
    rows = []
    for c in cols:
        n = F.col(f"n__{c}")
        miss = 1 - n / F.col("n")
        enough = n >= 4
        frac = F.when(enough, F.col(f"o__{c}") / n).otherwise(0.0)
        median = (frac > 0.02) | F.lit(transforms.get(c) in ("log1p", "yeo_johnson")) | (enough & (miss > 0.20))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(miss, 6).alias("missing_pct"),
                F.round(F.when(n > 3, F.col(f"s__{c}")).otherwise(0.0), 4).alias("skewness"),
                F.round(frac, 6).alias("outlier_frac"),
                (frac > 0.02).alias("has_outliers"),
                F.when(frac > 0.02, "robust").otherwise("standard").alias("scaler"),
                F.when(median, "median").otherwise("mean").alias("safety_net_imputer"),
            )
        )
    return rows_from(df.agg(*aggs), rows)


def transformation_review(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """|skew| above 2 or a 1%-99% spread above 1000 gives an advised transform."""
    q = exact_quantiles(df, cols, [0.01, 0.99])
    a = df.agg(
        *[
            x
            for c in cols
            for x in (
                F.count(c).alias(f"n__{c}"), corrected_skew(F.col(c).cast("double")).alias(f"s__{c}"), F.min(c).alias(f"lo__{c}"),
            )
        ]
    )
    rows = []
    for c in cols:
        skew, nonpos = F.col(f"s__{c}"), F.col(f"lo__{c}") <= 0
        lo, hi = (v if v is not None else 0.0 for v in q[c])
        wide = F.lit(hi - lo > 0 and hi / max(abs(lo), 1e-9) > 1000)
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n__{c}").alias("n"),
                F.round(skew, 3).alias("skewness"),
                nonpos.alias("has_negatives"),
                F.when((F.abs(skew) > 2) & ~nonpos, "log_or_sqrt")
                .when((F.abs(skew) > 2) & nonpos, "binning_or_yeo_johnson")
                .when(wide, "woe_or_log_scale")
                .otherwise("none")
                .alias("recommendation"),
                F.when((F.abs(skew) > 2) | wide, "WARN").otherwise("OK").alias("status"),
            )
        )
    return rows_from(a, rows).where("n >= 10").drop("n")
