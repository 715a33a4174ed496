"""Cleaning to a modelling frame, stratified and out-of-time splits, class weights, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.functions.expressions import with_totals
from loanforge.operators.ordering import order_statistics
from loanforge.operators.roles import late_origin_columns, post_default_columns

# Up to so many classes the hash cut-offs travel as literals, beyond that in a joined table; the cuts are the same.
LITERAL_CLASSES = 50
#: Rows of a class within one hash range that are ranked in one task, about.
ROWS_PER_RANGE = 100_000


def finalize_xy(df: DataFrame, id_cols: Sequence[str], target: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Drop id, leakage and post-default columns, then duplicate rows.

    Returns the frame and the dropped column names; counts are in :func:`cleaning_report`.
    """
    rest = [c for c in df.columns if c not in id_cols]
    late = [c for c in late_origin_columns(rest) if c != target]
    rest = [c for c in rest if c not in late]
    post = [c for c in post_default_columns(rest) if c != target]
    rest = [c for c in rest if c not in post]
    return df.select(*rest).dropDuplicates(), {"id": list(id_cols), "late_origin": late, "post_default": post}


def cleaning_report(df: DataFrame, id_cols: Sequence[str], target: str) -> DataFrame:
    """Rows before and after, duplicates removed and the columns dropped, as one row."""
    clean, dropped = finalize_xy(df, id_cols, target)
    groups = df.select(*clean.columns).groupBy(*clean.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.sum("__n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"),
        *[F.lit(",".join(dropped[k])).alias(f"{k}_dropped") for k in ("id", "late_origin", "post_default")],
    )


def key_hash(keys: Sequence[str], seed: int | str) -> Column:
    """52-bit integer from the md5 of the row key and a seed: the same in any engine and partitioning."""
    text = F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def stratified_split(
    df: DataFrame, y: str, keys: Sequence[str], test_size: float = 0.15, val_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train, val, test) with exact class shares.

    The rows of a class are ordered by key hash; the two hash cut-offs per class
    are exact order statistics, so no class is ever sorted in one task and the
    split itself is a projection.
    """
    return _cut_classes(df, y, key_hash(keys, seed), [test_size, test_size + val_size], ["test", "val", "train"], "split", [test_size, val_size])


def _cut_classes(df: DataFrame, y: str, h: Column, shares: Sequence[float], labels: Sequence, name: str, sizes: Sequence[float] | None = None) -> DataFrame:
    """Add ``name``: rows of every class in hash order, cut at exact shares of the class.

    ``sizes`` are part sizes to be rounded one by one; without it the ends in ``shares`` are rounded.
    """
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(LITERAL_CLASSES + 1).collect()
    if len(few) > LITERAL_CLASSES:
        return _cut_by_table(df, y, h, counts, shares, labels, name, sizes)
    classes = {r[y]: r["n"] for r in few}
    pick = {k: (F.col(y).isNull() if k is None else F.col(y).eqNullSafe(F.lit(k))) for k in classes}
    names = {k: f"h{i}" for i, k in enumerate(classes)}
    hashed = df.select(*[F.when(pick[k], h).alias(names[k]) for k in classes])

    def ends(n: int) -> list[int]:
        if sizes is None:
            return [_half_up(n * s) for s in shares]
        return [sum(_half_up(n * s) for s in sizes[: i + 1]) for i in range(len(sizes))]

    wanted = {k: [e - 1 for e in ends(n) if 1 <= e <= n] for k, n in classes.items()}
    cut = order_statistics(hashed, {names[k]: r for k, r in wanted.items()}, {names[k]: n for k, n in classes.items()})
    out: Column = F.lit(labels[-1])
    for k, n in classes.items():
        label = F.lit(labels[-1])
        for e, text in reversed(list(zip(ends(n), labels))):
            label = F.when(h.cast("double") <= cut.get((names[k], e - 1), -1.0), F.lit(text)).otherwise(label)
        out = F.when(pick[k], label).otherwise(out)
    return df.withColumn(name, out)


def _cut_by_table(df: DataFrame, y: str, h: Column, counts: DataFrame, shares: Sequence[float], labels: Sequence, name: str, sizes: Sequence[float] | None) -> DataFrame:
    """The same cuts for any number of classes: rows per class and hash range, then ranks inside the ranges that hold a cut."""
    bits = max(0, min(30, math.ceil(math.log2(max(df.count(), 1) / ROWS_PER_RANGE + 1))))
    rows = df.select(F.col(y).alias("__y"), h.alias("__h"), F.shiftright(h, 52 - bits).alias("__r"))
    half_up = lambda c: F.floor(c + 0.5).cast("bigint")
    if sizes is None:
        ends = [half_up(F.col("n") * s) for s in shares]
    else:
        ends = [sum((half_up(F.col("n") * s) for s in sizes[1 : i + 1]), half_up(F.col("n") * sizes[0])) for i in range(len(sizes))]
    per = rows.groupBy("__y", "__r").agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("upto", F.sum("k").over(Window.partitionBy("__y").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)))
    need = counts.select(F.col(y).alias("__cy"), F.posexplode(F.array(*ends)).alias("i", "end"))
    held = need.join(per, F.col("__cy").eqNullSafe(F.col("__y")) & (F.col("end") <= F.col("upto")) & (F.col("end") > F.col("upto") - F.col("k")))
    held = held.select("__cy", F.col("__r").alias("__cr"), "i", (F.col("end") - F.col("upto") + F.col("k")).alias("at"))
    ranges = held.groupBy("__cy", "__cr").agg(F.collect_list(F.struct("i", "at")).alias("cuts"))
    inside = rows.join(ranges, F.col("__y").eqNullSafe(F.col("__cy")) & (F.col("__r") == F.col("__cr")))
    rank = F.row_number().over(Window.partitionBy("__y", "__r").orderBy("__h"))
    found = inside.withColumn("rank", rank).select("__y", "__h", F.explode(F.filter("cuts", lambda c: c["at"] == F.col("rank"))).alias("c"))
    table = found.groupBy(F.col("__y").alias("__cy")).agg(F.map_from_entries(F.collect_list(F.struct("c.i", "__h"))).alias("__cut"))
    out: Column = F.lit(labels[-1])
    for i in reversed(range(len(shares))):
        out = F.when(h <= F.coalesce(F.try_element_at("__cut", F.lit(i)), F.lit(-1)), F.lit(labels[i])).otherwise(out)
    joined = df.join(table, df[y].eqNullSafe(F.col("__cy")), "left")
    return joined.select(*[F.col(c) for c in df.columns], out.alias(name))


def fold_column(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42, name: str = "fold", y: str | None = None) -> DataFrame:
    """Fold number from the key hash; with ``y`` every class is cut into folds of equal size."""
    h = key_hash(keys, f"f{seed}")
    if y is None:
        return df.withColumn(name, (h % folds).cast("int"))
    return _cut_classes(df, y, h, [(i + 1) / folds for i in range(folds - 1)], list(range(folds)), name)


def split_stats(df: DataFrame, y: str, split: str = "split") -> DataFrame:
    """Rows, share of all rows and share within the split per (split, class)."""
    g = df.groupBy(split, F.col(y).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    per = g.groupBy(split).agg(F.sum("n").alias("split_n"))
    out = with_totals(g.join(per, split), g.agg(F.sum("n").alias("__t")))
    return out.select(
        F.col(split).alias("split"),
        "class",
        "n",
        "split_n",
        F.round(F.col("split_n") / F.col("__t"), 6).alias("split_pct"),
        F.round(F.col("n") / F.col("split_n"), 6).alias("class_share"),
    )


def oot_window_size(n: int, target: float = 0.15, lo: float = 0.10, hi: float = 0.20, min_n: int = 100) -> int:
    """Rows to hold out: 15% of dated rows kept within 10% to 20% and at least ``min_n``."""
    if n <= 1:
        return 0
    floor_n, cap = max(round(n * lo), min_n), round(n * hi)
    size = min(floor_n, n // 2) if cap < floor_n else min(max(round(n * target), floor_n), cap)
    return max(1, min(size, n - 1))


def oot_cutoff(df: DataFrame, ts: str, min_dated_rows: int = 50) -> int | None:
    """Microseconds of the n-th latest date, or None when too few rows are dated."""
    micros = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("u"))
    n = micros.agg(F.count("u")).first()[0]
    size = oot_window_size(n) if n >= min_dated_rows else 0
    if size < 1:
        return None
    return int(order_statistics(micros, {"u": [n - size]}, {"u": n})[("u", n - size)])


def oot_split(df: DataFrame, ts: str, min_dated_rows: int = 50) -> DataFrame:
    """Add ``part``: oot from the cut-off date on, development before it and for undated rows."""
    cut = oot_cutoff(df, ts, min_dated_rows)
    if cut is None:
        return df.withColumn("part", F.lit("development"))
    late = F.unix_micros(F.col(ts).cast("timestamp")) >= F.lit(cut)
    return df.withColumn("part", F.when(late, "oot").otherwise("development"))


def oot_report(df: DataFrame, ts: str) -> DataFrame:
    cut = oot_cutoff(df, ts)
    day = F.lit(None).cast("string") if cut is None else F.date_format(F.timestamp_micros(F.lit(cut)), "yyyy-MM-dd")
    return (
        oot_split(df, ts)
        .agg(
            F.count_if(F.col("part") == "oot").alias("oot_n"),
            F.count_if(F.col("part") == "development").alias("dev_n"),
            F.count(ts).alias("n_dated_rows"),
        )
        .withColumn("cutoff_date", day)
    )


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    g = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return with_totals(g, t).select(y, "n", F.round(F.col("__t") / (F.col("__k") * F.col("n")), 6).alias("weight"))


def with_class_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(LITERAL_CLASSES + 1).collect()
    if len(rows) < 2:
        return df.withColumn(name, F.lit(1.0))
    if len(rows) > LITERAL_CLASSES:
        t = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
        weights = counts.select(F.col(y).alias("__cy"), (F.lit(float(t["t"])) / (F.col("n") * t["k"])).alias("__w"))
        joined = df.join(weights, df[y] == F.col("__cy"), "left")
        return joined.select(*[F.col(c) for c in df.columns], F.coalesce("__w", F.lit(1.0)).alias(name))
    total = sum(r["n"] for r in rows)
    out = F.lit(1.0)
    for r in rows:
        out = F.when(F.col(y) == F.lit(r[y]), F.lit(total / (len(rows) * r["n"]))).otherwise(out)
    return df.withColumn(name, out)


def capped_sample(df: DataFrame, keys: Sequence[str], max_rows: int, seed: int = 42) -> DataFrame:
    """The ``max_rows`` rows of smallest key hash: repeatable, one exact cut-off and a filter."""
    h = key_hash(keys, seed)
    n = df.count()
    if n <= max_rows:
        return df
    cut = order_statistics(df.select(h.alias("h")), {"h": [max_rows - 1]}, {"h": n})[("h", max_rows - 1)]
    return df.where(h.cast("double") <= cut)

