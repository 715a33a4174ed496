"""Distributed order statistics: exact quantiles, running sums and score ladders.

Nothing here sorts a whole table in one task. A global order is built from
order buckets: cut points come from a small sample (they only decide which task
handles which range, every row is still used), totals per bucket are exact, and
a window runs inside one bucket at a time. Equal values are merged by a
map-side-combined ``groupBy`` first, so a value held by a third of all rows is
one row by the time anything is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values one task may order by itself; below it a single bucket is enough.
ROWS_PER_BUCKET = 1_000_000
# Values about a wanted rank that are ordered, when a column has more than ten times as many.
ROWS_PER_RANK = 20_000
MAX_BUCKETS = 8192
# Values (rows x columns) for which Spark's own exact percentile is used.
DIRECT_PERCENTILE_VALUES = 500_000
SAMPLE_PER_BUCKET = 200


def order_cuts(
    df: DataFrame,
    cols: Sequence[str],
    counts: Mapping[str, int],
    rows_per_bucket: int | None = None,
) -> dict[str, list[float]]:
    """Interior cut points per column so that a bucket holds about ``rows_per_bucket`` rows."""
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    largest = max(counts.values(), default=0)
    buckets = min(MAX_BUCKETS, math.ceil(largest / rows_per_bucket)) if largest else 1
    if buckets <= 1:
        return {c: [] for c in cols}
    fraction = min(1.0, buckets * SAMPLE_PER_BUCKET / largest)
    probs = [i / buckets for i in range(1, buckets)]
    sample = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=7)
    row = sample.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in cols]).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


def with_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]], suffix: str = "__b") -> DataFrame:
    """Add ``<col>__b`` (0-based order bucket, left-closed) for every column of ``cuts``.

    Null values stay null.
    """
    flat = [c for c in cuts if not cuts[c]]
    split = [c for c in cuts if cuts[c]]
    for c in flat:
        df = df.withColumn(c + suffix, F.when(F.col(c).isNotNull(), F.lit(0)))
    if split:
        df = Bucketizer(
            inputCols=[c + "__d" for c in split],
            outputCols=[c + suffix for c in split],
            splitsArray=[[-math.inf, *cuts[c], math.inf] for c in split],
            handleInvalid="keep",
        ).transform(df.withColumns({c + "__d": F.col(c).cast("double") for c in split}))
        df = df.withColumns(
            {c + suffix: F.when(F.col(c).isNotNull(), F.col(c + suffix).cast("int")) for c in split}
        ).drop(*[c + "__d" for c in split])
    return df


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()


def _column_values(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Non-null values of a float column; NaN stays."""
    return batch.column(i).drop_null().to_numpy(zero_copy_only=False)


def _rows_of_ranges(values: DataFrame, edges: Sequence[np.ndarray]) -> dict[int, dict[int, int]]:
    """Non-null values per column and range, counted batch by batch; one small row per task, column and range."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        for batch in batches:
            for i, e in enumerate(edges):
                sizes[i] += np.bincount(np.searchsorted(e, _column_values(batch, i), side="right"), minlength=len(e) + 1)
        held = [np.flatnonzero(n) for n in sizes]
        f = np.repeat(np.arange(len(edges), dtype=np.int32), [len(b) for b in held])
        n = np.concatenate([n[b] for n, b in zip(sizes, held)])
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.concatenate(held).astype(np.int32)), pa.array(n)], names=["f", "b", "n"])

    out: dict[int, dict[int, int]] = {i: {} for i in range(len(edges))}
    for r in values.mapInArrow(counted, "f int, b int, n bigint").groupBy("f", "b").agg(F.sum("n").alias("n")).collect():  # at most columns x MAX_BUCKETS rows
        out[r["f"]][r["b"]] = r["n"]
    return out


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int] | None = None,
    rows_per_bucket: int | None = None,
) -> dict[tuple[str, int], float]:
    """Exact value at each 0-based rank of each column (nulls excluded).

    Two narrow scans and no full shuffle: values per range are counted, then only
    the ranges that hold a wanted rank leave the scan, to be grouped by value and
    ranked. Ranges are looked up per Arrow batch, so the work per value does not
    grow with the number of columns and ranks asked for.
    """
    cols = [c for c in ranks if ranks[c]]
    if not cols:
        return {}
    counts = counts or non_null_counts(df, cols)
    if rows_per_bucket is None and max(counts[c] for c in cols) > 10 * ROWS_PER_RANK:
        rows_per_bucket = ROWS_PER_RANK
    cuts = order_cuts(df.select(*cols), cols, {c: counts[c] for c in cols}, rows_per_bucket)
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    edges = [np.array(cuts[c], dtype=float) for c in cols]
    sizes = _rows_of_ranges(values, edges) if any(map(len, edges)) else {i: {0: counts[c]} for i, c in enumerate(cols)}
    base: dict[tuple[int, int], int] = {}
    wanted = []
    for i, c in enumerate(cols):
        done = 0
        for b in sorted(sizes[i]):
            size = sizes[i][b]
            hits = sorted(r - done for r in set(ranks[c]) if done <= r < done + size)
            if hits:
                base[(i, b)] = done
                wanted.append((i, b, hits))
            done += size
    if not wanted:
        return {}
    asked = [np.zeros(len(e) + 1, dtype=bool) for e in edges]
    for i, b, _ in wanted:
        asked[i][b] = True

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, e in enumerate(edges):
                v = _column_values(batch, i)
                b = np.searchsorted(e, v, side="right")
                keep = asked[i][b]
                if keep.any():
                    b = b[keep].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, dtype=np.int32)), pa.array(b), pa.array(v[keep])], names=["f", "b", "v"])

    w = Window.partitionBy("f", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.sparkSession.createDataFrame(wanted, "f int, b int, hits array<bigint>")
    found = (
        values.mapInArrow(held, "f int, b int, v double")
        .groupBy("f", "b", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(w))
        .join(F.broadcast(local), ["f", "b"])  # one row per range that holds a wanted rank
        .withColumn("hit", F.explode(F.filter("hits", lambda h: (h < F.col("upto")) & (h >= F.col("upto") - F.col("n")))))
        .select("f", "b", "hit", "v")
        .collect()  # one row per wanted rank
    )
    return {(cols[r["f"]], base[(r["f"], r["b"])] + r["hit"]): r["v"] for r in found}


def typed_order_statistic(df: DataFrame, col: str, rank: int, rows_at_once: int = 1_000_000, cuts: int = 100):
    """Exact value at a 0-based rank of a column of any ordered type (nulls excluded).

    Each round counts rows between sampled values and keeps the range that holds
    the rank, until at most ``rows_at_once`` rows are left to sort.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v"))
    n = rows.count()
    while n > rows_at_once:
        seen = sorted({r["v"] for r in rows.sample(fraction=min(1.0, 50.0 * cuts / n), seed=11).limit(100 * cuts).collect()})
        points = [seen[len(seen) * i // cuts] for i in range(1, cuts)] if len(seen) > cuts else seen
        if not points:
            break
        place = F.size(F.filter(F.array(*[F.lit(x) for x in points]), lambda x: x <= F.col("v")))
        sizes = sorted((r["b"], r["count"]) for r in rows.groupBy(place.alias("b")).count().collect())
        for b, size in sizes:
            if rank < size:
                break
            rank -= size
        rows = rows.where(place == b)
        if size == n:
            break
        n = size
    counted = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("upto", upto).where(F.col("upto") > rank).agg(F.min("v").alias("v")).first()["v"]


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    direct_values: int | None = None,
    rows_per_bucket: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of many columns, exact at any size.

    Small inputs (checked by count) use Spark's ``percentile``; larger ones go
    through :func:`order_statistics`, which never buffers a column in one task.
    """
    cols = list(cols)
    if not cols:
        return {}
    limit = DIRECT_PERCENTILE_VALUES if direct_values is None else direct_values
    counts = non_null_counts(df, cols)
    if sum(counts.values()) <= limit:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), list(probs)).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    spots = {
        c: [((counts[c] - 1) * q, math.floor((counts[c] - 1) * q), math.ceil((counts[c] - 1) * q)) for q in probs]
        for c in cols
        if counts[c]
    }
    values = order_statistics(df, {c: [r for s in v for r in s[1:]] for c, v in spots.items()}, counts, rows_per_bucket)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for c, v in spots.items():
        out[c] = [_between(values[(c, lo)], values[(c, hi)], h, lo, hi) for h, lo, hi in v]
    return out


def _between(a: float, b: float, h: float, lo: int, hi: int) -> float:
    """Linear interpolation in the form Spark's ``percentile`` uses, so both ways give the same bits."""
    return a if lo == hi or a == b else (hi - h) * a + (h - lo) * b


def running_sums(
    df: DataFrame,
    order_col: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    bucket_col: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<x>`` and ``tot_<x>`` for each ``x`` in ``sums`` over rows ordered by ``order_col``.

    ``df`` must hold one row per (by, order value). With ``bucket_col`` set the
    window runs inside a bucket and a small per-bucket offset is joined back.
    """
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if bucket_col is None:
        part = list(by) or [F.lit(0)]
        run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*part)
        return df.withColumns(
            {f"cum_{s}": F.sum(s).over(run) for s in sums} | {f"tot_{s}": F.sum(s).over(whole) for s in sums}
        )
    part = [*by, bucket_col]
    run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b_order = F.col(bucket_col).desc() if descending else F.col(bucket_col).asc()
    group = list(by) or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        df.groupBy(*part)
        .agg(*[F.sum(s).alias(f"b_{s}") for s in sums])
        .select(
            *part,
            *[F.coalesce(F.sum(f"b_{s}").over(before), F.lit(0)).alias(f"off_{s}") for s in sums],
            *[F.sum(f"b_{s}").over(whole).alias(f"tot_{s}") for s in sums],
        )
    )
    return (
        df.withColumns({f"cum_{s}": F.sum(s).over(run) for s in sums})
        .join(offsets, part, "inner")
        .withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"off_{s}") for s in sums})
        .drop(*[f"off_{s}" for s in sums])
    )


def score_ladder(
    scored: DataFrame,
    y: str = "y",
    p: str = "p",
    by: Sequence[str] = (),
    descending: bool = True,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Distinct scores with positives, negatives and cumulative counts from the top.

    Columns: ``*by, score, pos, neg, cum_pos, cum_neg, tot_pos, tot_neg``.
    """
    return feature_ladder(scored, {None: p}, y, by, descending, rows_per_bucket)


def feature_ladder(
    df: DataFrame,
    features: Mapping[str | None, str] | Sequence[str],
    y: str = "y",
    by: Sequence[str] = (),
    descending: bool = True,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Ladders of several numeric columns at once, one extra key ``feature``.

    A mapping ``{None: col}`` gives a plain ladder without the ``feature`` column.
    """
    named = dict(features) if isinstance(features, Mapping) else {c: c for c in features}
    cols = list(dict.fromkeys(named.values()))
    slim = df.select(*by, F.col(y).cast("int").alias("__y"), *[F.col(c).cast("double").alias(c) for c in cols])
    counts = non_null_counts(slim, cols)
    cuts = order_cuts(slim, cols, counts, rows_per_bucket)
    bucketed = any(cuts.values())
    slim = with_buckets(slim, cuts) if bucketed else slim
    entries = []
    for name, c in named.items():
        fields = [F.col(c).alias("score")]
        if name is not None:
            fields.insert(0, F.lit(name).alias("feature"))
        if bucketed:
            fields.append(F.col(c + "__b").alias("__bucket"))
        entries.append(F.struct(*fields))
    if len(entries) == 1:
        long = slim.select(*by, "__y", entries[0].alias("s"))
    else:
        long = slim.select(*by, "__y", F.explode(F.array(*entries)).alias("s"))
    long = long.select(*by, "__y", "s.*").where("score is not null and __y is not null")
    keys = [*by, *([] if None in named else ["feature"])]
    bucket = ["__bucket"] if bucketed else []
    rungs = long.groupBy(*keys, *bucket, "score").agg(
        F.sum("__y").cast("bigint").alias("pos"), F.sum(1 - F.col("__y")).cast("bigint").alias("neg")
    )
    out = running_sums(rungs, "score", ["pos", "neg"], keys, "__bucket" if bucketed else None, descending)
    return out.select(*keys, "score", "pos", "neg", "cum_pos", "cum_neg", "tot_pos", "tot_neg")


# Rows that a task sorts and merges at once before values leave it.
ROWS_PER_BLOB = 200_000


def merged_values(v: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order with the sums of ``pos`` and ``n``."""
    order = np.argsort(v)  # NaN last
    v = v[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
    return v[new], np.add.reduceat(pos[order], new), np.add.reduceat(n[order], new)


def value_ranges(slim: DataFrame, n_cols: int, edges: Sequence[np.ndarray], reduced: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> list:
    """``f``, ``b`` and what ``reduced`` makes of the sums and counts of the different values, in order, of every column and order bucket.

    ``slim`` holds an int to be summed and ``n_cols`` float columns. Values travel as sorted arrays with equal values
    merged, one per task, column and bucket, and a bucket is merged by itself.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            whole = t.column(0).to_numpy().astype(np.int64)
            rows: dict[str, list] = {"f": [], "b": [], "v": [], "pos": [], "n": []}
            for i, e in enumerate(edges):
                c = t.column(i + 1).combine_chunks()
                v = c.drop_null().to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                pos = whole if len(v) == len(whole) else whole[c.is_valid().to_numpy(zero_copy_only=False)]
                v, pos, n = merged_values(v, pos, np.ones(len(v), dtype=np.int64))
                ends = [0, *np.searchsorted(v, e, side="left"), len(v)]
                for b, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    if lo < hi:
                        for k, x in zip(("f", "b", "v", "pos", "n"), (i, b, v[lo:hi].tobytes(), pos[lo:hi].tobytes(), n[lo:hi].tobytes())):
                            rows[k].append(x)
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("f", pa.int32()), ("b", pa.int32()), ("v", pa.binary()), ("pos", pa.binary()), ("n", pa.binary())]))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS_PER_BLOB:
                yield blobs(held)
                held = []
        if held:
            yield blobs(held)

    def met(part: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(part["v"]), dtype=float)
        pos, n = (np.frombuffer(b"".join(part[k]), dtype=np.int64) for k in ("pos", "n"))
        _, pos, n = merged_values(v, pos, n)
        return pd.DataFrame({"f": [part["f"].iat[0]], "b": [part["b"].iat[0]]} | {k: [x] for k, x in reduced(pos, n).items()})

    blobs = slim.mapInArrow(packed, "f int, b int, v binary, pos binary, n binary")
    return blobs.groupBy("f", "b").applyInPandas(met, f"f int, b int, {schema}").collect()  # columns x buckets


def feature_aucs(df: DataFrame, cols: Sequence[str], y: str = "y", rows_per_bucket: int | None = None) -> dict[str, float | None]:
    """Rank AUC of several numeric columns over their non-null values, ties counted half; None for a single class.

    The same numbers as :func:`feature_ladder` gives; buckets meet on the driver as three counts each.
    """
    cols = list(cols)
    if not cols:
        return {}
    slim = df.where(F.col(y).cast("int").isNotNull()).select(F.col(y).cast("int").alias("__y"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    places = [f"v{i}" for i in range(len(cols))]
    cuts = order_cuts(slim, places, non_null_counts(slim, places), rows_per_bucket)

    def reduced(pos: np.ndarray, n: np.ndarray) -> dict:
        neg = n - pos
        above = np.cumsum(pos[::-1])[::-1]
        return {"pos": int(pos.sum()), "neg": int(neg.sum()), "won": float(np.sum(neg * (above - pos * 0.5)))}

    found = value_ranges(slim, len(cols), [np.array(cuts[c], dtype=float) for c in places], reduced, "pos bigint, neg bigint, won double")
    out: dict[str, float | None] = {}
    for i in sorted({r["f"] for r in found}):
        above, pairs_neg, won = 0, 0, 0.0
        for r in sorted((r for r in found if r["f"] == i), key=lambda r: -r["b"]):
            won += r["won"] + float(r["neg"]) * above
            above += r["pos"]
            pairs_neg += r["neg"]
        pairs = float(above) * pairs_neg
        out[cols[i]] = won / pairs if pairs > 0 else None
    return out


def value_shares(df: DataFrame, cols: Sequence[str], rows_per_bucket: int | None = None) -> dict[str, tuple[int, float | None]]:
    """How many different non-null values each numeric column has and the share of the most frequent one."""
    cols = list(cols)
    if not cols:
        return {}
    places = [f"v{i}" for i in range(len(cols))]
    slim = df.select(F.lit(0).alias("__y"), *[F.col(c).cast("double").alias(p) for p, c in zip(places, cols)])
    cuts = order_cuts(slim, places, non_null_counts(slim, places), rows_per_bucket)
    reduced = lambda pos, n: {"k": len(n), "top": int(n.max()), "n": int(n.sum())}
    out: dict[str, tuple[int, float | None]] = {c: (0, None) for c in cols}
    found = value_ranges(slim, len(cols), [np.array(cuts[c], dtype=float) for c in places], reduced, "k bigint, top bigint, n bigint")
    for i in {r["f"] for r in found}:
        rows = [r for r in found if r["f"] == i]
        out[cols[i]] = sum(r["k"] for r in rows), max(r["top"] for r in rows) / sum(r["n"] for r in rows)
    return out


def average_ranks(df: DataFrame, col: str, n: str = "n", rows_per_bucket: int | None = None) -> DataFrame:
    """``(col, avg_rank, tot_n)`` per distinct value of a frame holding (col, n) counts, ties at mid-rank."""
    counts = {col: df.agg(F.count(col)).first()[0]}
    cuts = order_cuts(df, [col], counts, rows_per_bucket)
    bucketed = bool(cuts[col])
    src = with_buckets(df.select(col, n), cuts) if bucketed else df.select(col, n)
    bucket = [col + "__b"] if bucketed else []
    rungs = src.groupBy(col, *bucket).agg(F.sum(n).alias("n"))
    run = running_sums(rungs, col, ["n"], (), bucket[0] if bucketed else None, descending=False)
    return run.select(col, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"), "tot_n")
