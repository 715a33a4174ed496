"""Exact nearest donors of vectors with gaps, in cells of donors that a bound rules in or out.

A query compares with a donor on the coordinates both have. Queries that miss a
target and have the same coordinates form a need; the donors of a need fall into
groups that share the same coordinates with it, and a group is cut into boxes at
medians of a sample, which decide only which task holds which donors. A query
first meets the box it lies in of every group; the k-th distance found bounds
the search, and it then meets the other boxes that come as near as that. So the
result is that of all pairs. Donors and needs that get no boxes (rare patterns
of gaps) are in loose cells, which every query of their need meets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanforge.session import cut_lineage

# Donors of a cell and of its innermost boxes, about, and queries that meet a cell in one task.
DONORS_PER_CELL = 20_000
DONORS_PER_LEAF = 48
QUERIES_PER_BLOCK = 10_000
# Donors whose values decide the cuts, and cells up to which they are asked for.
SAMPLE_PER_CELL = 200
MAX_SAMPLE = 500_000
# Needs and groups of a need with boxes of their own, the largest ones.
MAX_NEEDS = 16
MAX_GROUPS = 64
NEAR = "array<struct<d:double,v:double>>"
# A bound computed along another path may differ in its last bits.
SLACK = 1.0 + 1e-9


@dataclass
class Boxes:
    """Nodes of a tree of median cuts and the boxes of its cells; cells are numbered from ``first``."""

    cols: list[int]
    first: int
    dim: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        node = np.zeros(len(x), dtype=np.int64)
        while len(open_ := np.flatnonzero(self.cell[node] < 0)):
            at = node[open_]
            node[open_] = np.where(x[open_, self.dim[at]] <= self.cut[at], self.low[at], self.high[at])
        return self.first + self.cell[node]

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row from each cell's box."""
        out = np.zeros((len(x), len(self.lo)))
        for i, c in enumerate(self.cols):
            v = x[:, c, None]
            out += np.square(np.maximum(np.maximum(self.lo[:, i] - v, v - self.hi[:, i]), 0.0))
        return out


@dataclass
class Need:
    """A target and the coordinates of the queries that miss it (``None``: of any other queries), with its groups of donors."""

    target: int
    mask: int | None
    groups: dict[int, Boxes] = field(default_factory=dict)
    loose: int = 0
    n_loose: int = 1


def median_boxes(x: np.ndarray, cols: Sequence[int], rows_per_cell: float, first: int) -> Boxes:
    """Cut the widest column at its median until a cell holds ``rows_per_cell`` rows or has one point."""
    dim, cut, low, high, cell = [], [], [], [], []
    lo, hi = [], []
    todo = [(np.arange(len(x)), np.full(len(cols), -np.inf), np.full(len(cols), np.inf), None)]
    while todo:
        rows, a, b, parent = todo.pop()
        at = len(dim)
        if parent is not None:
            (low if parent[1] else high)[parent[0]] = at
        for s in (dim, cut, low, high, cell):
            s.append(-1)
        done = True
        if len(rows) > rows_per_cell:
            part = x[rows][:, cols]
            for i in np.argsort(-np.ptp(part, axis=0), kind="stable"):
                v = part[:, i]
                c = np.partition(v, len(v) // 2)[len(v) // 2]
                if c == v.max() and (v < c).any():
                    c = v[v < c].max()
                left = v <= c
                if not left.all():
                    dim[at], cut[at], done = cols[i], c, False
                    b1, a2 = b.copy(), a.copy()
                    b1[i] = a2[i] = c
                    todo += [(rows[~left], a2, b, (at, False)), (rows[left], a, b1, (at, True))]
                    break
        if done:
            cell[at] = len(lo)
            lo.append(a)
            hi.append(b)
    return Boxes(list(cols), first, *(np.array(v) for v in (dim, np.array(cut, dtype=float), low, high, cell)), np.array(lo), np.array(hi))


def bits(x: np.ndarray) -> np.ndarray:
    """Coordinates present, one bit each."""
    return (~np.isnan(x)).astype(np.int64) @ (1 << np.arange(x.shape[1], dtype=np.int64))


def columns_of(mask: int) -> list[int]:
    return [c for c in range(mask.bit_length()) if mask >> c & 1]


def smallest(d2: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest distances of each row with their values; of equal ones those of smallest value, ``v`` ascending."""
    n = d2.shape[1]
    if n <= k:
        pad = ((0, 0), (0, k - n))
        return np.pad(d2, pad, constant_values=np.inf), np.pad(np.broadcast_to(v, d2.shape), pad)
    kth = np.partition(d2, k - 1, axis=1)[:, k - 1, None]
    below, tied = d2 < kth, d2 == kth
    keep = below | (tied & (np.cumsum(tied, axis=1) <= k - below.sum(axis=1, keepdims=True)))
    at = np.nonzero(keep)[1].reshape(-1, k)
    return np.take_along_axis(d2, at, axis=1), v[at]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances over shared coordinates, scaled to all of them; infinite without any."""
    d2, shared = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    for c in range(q.shape[1]):
        d = q[:, c, None] - x[None, :, c]
        both = ~np.isnan(d)
        d2 += np.where(both, d * d, 0.0)
        shared += both
    return np.where(shared > 0, d2 * q.shape[1] / np.maximum(shared, 1.0), np.inf)


def nearest_donors(q: np.ndarray, x: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance and value of the ``k`` nearest donors within ``bound``, sorted by both; infinite where there are fewer.

    ``x`` are the donors' coordinates and ``v`` their targets. Donors that all
    have the same coordinates are cut into small boxes that a query's bound rules out.
    """
    order = np.argsort(v, kind="stable")
    x, v = x[order], v[order]
    there = ~np.isnan(x)
    cols = np.flatnonzero(there.any(axis=0))
    boxed = len(x) > 4 * DONORS_PER_LEAF and len(cols) and there[:, cols].all() and not np.isnan(q[:, cols]).any()
    best, value = np.full((len(q), k), np.inf), np.zeros((len(q), k))
    limit = np.full(len(q), np.inf) if bound is None else bound.copy()

    def meet(rows: np.ndarray, donors: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(donors)))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            if boxed:
                d2 = np.zeros((len(r), len(donors)))
                for c in cols:
                    d2 += np.square(q[r, c, None] - x[None, donors, c])
                d2 = d2 * q.shape[1] / float(len(cols))
            else:
                d2 = distances(q[r], x[donors])
            new, its = smallest(d2, v[donors], k)
            new, its = np.concatenate([best[r], new], axis=1), np.concatenate([value[r], its], axis=1)
            at = np.lexsort((its, new), axis=-1)[:, :k]
            best[r], value[r] = np.take_along_axis(new, at, axis=1), np.take_along_axis(its, at, axis=1)
            limit[r] = np.minimum(limit[r], best[r, -1] * SLACK)

    if not boxed:
        meet(np.arange(len(q)), np.arange(len(x)))
        return best, value
    boxes = median_boxes(x, list(cols), DONORS_PER_LEAF, 0)
    leaf = boxes.place(x)
    members = np.split(np.argsort(leaf, kind="stable"), np.cumsum(np.bincount(leaf, minlength=len(boxes.lo)))[:-1])  # ascending values
    tight = [(x[m][:, cols].min(axis=0), x[m][:, cols].max(axis=0)) for m in members]
    boxes.lo, boxes.hi = np.array([a for a, _ in tight]), np.array([b for _, b in tight])
    step = max(1, 4_000_000 // len(members))
    for i in range(0, len(q), step):
        part = np.arange(i, min(i + step, len(q)))
        far = boxes.reach(q[part]) * q.shape[1] / float(len(cols))
        home = far.argmin(axis=1)
        for first in (True, False):
            if first:
                pairs = (np.arange(len(part)), home)
            else:
                near = far <= limit[part, None]
                near[np.arange(len(part)), home] = False
                pairs = np.nonzero(near)
            turn = np.argsort(pairs[1], kind="stable")
            rows, at = pairs[0][turn], pairs[1][turn]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=int)
            for s, e in zip(starts, [*starts[1:], len(at)]):
                r = rows[s:e]
                r = r[far[r, at[s]] <= limit[part[r]]]
                if len(r):
                    meet(part[r], members[at[s]])
    return best, value


def plan_needs(masks: Sequence[int], targets: Sequence[int], sample: np.ndarray, scale: float, others: bool) -> tuple[list[Need], int]:
    """Needs with their boxes and the number of cells; a sampled donor stands for ``scale`` donors."""
    needs, cells = [], 0
    wanted = [(t, m) for m in masks for t in targets if not m >> t & 1]
    left = [(t, None) for t in targets] if others or len(wanted) > MAX_NEEDS else []
    for t, m in [*wanted[:MAX_NEEDS], *left]:
        need = Need(t, m)
        own = sample[~np.isnan(sample[:, t])]
        rest = len(own)
        if m is not None:
            shared = bits(own) & m
            found, n = np.unique(shared, return_counts=True)
            for s in found[np.argsort(-n, kind="stable")][:MAX_GROUPS]:
                rows = own[shared == s]
                rest -= len(rows)
                if s:
                    need.groups[int(s)] = b = median_boxes(rows, columns_of(int(s)), DONORS_PER_CELL / scale, cells)
                    cells += len(b.lo)
        need.loose, need.n_loose = cells, max(1, int(rest * scale / DONORS_PER_CELL))
        cells += need.n_loose
        needs.append(need)
    return needs, cells


def _arrays(batch: pa.RecordBatch, d: int, at: int = 0) -> np.ndarray:
    x = np.column_stack([batch.column(at + c).to_numpy(zero_copy_only=False) for c in range(d)]) if batch.num_rows else np.zeros((0, d))
    return np.where(np.isnan(x), np.nan, x + 0.0)  # one form of NaN and of zero


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of floats as bytes."""
    return pa.array(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").reshape(-1).tolist() if len(x) else [], pa.binary())


def _floats(c: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), dtype=float).reshape(-1, d)


def nearest_by_vector(vectors: DataFrame, donors: DataFrame, d: int, targets: Sequence[int], k: int) -> DataFrame:
    """``(w, t, near)`` of every vector and target it misses: its ``k`` nearest donors by distance, then value.

    ``vectors`` and ``donors`` hold ``d`` float columns each, NaN or null where missing. ``w`` is the vector as an array.
    """
    spark = donors.sparkSession
    held: list[DataFrame] = []

    def kept(x: DataFrame) -> DataFrame:
        held.append(x.persist(StorageLevel.MEMORY_AND_DISK))
        return x

    kept(vectors)
    present = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.isnan(c), F.lit(False)) | F.col(c).isNull(), F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint") for i, c in enumerate(vectors.columns)])
    patterns = [r["m"] for r in vectors.groupBy(present.alias("m")).count().orderBy(F.desc("count"), "m").limit(MAX_NEEDS + 1).collect()]
    n = donors.count()
    share = min(1.0, min(MAX_SAMPLE, max(2_000, n // DONORS_PER_CELL * SAMPLE_PER_CELL)) / max(n, 1))
    table = (donors.sample(fraction=share, seed=5) if share < 1.0 else donors).toArrow()  # cut points only
    sample = np.concatenate([_arrays(b, d) for b in table.to_batches()] or [np.zeros((0, d))])
    needs, cells = plan_needs(patterns[:MAX_NEEDS], targets, sample, max(n, 1) / max(len(sample), 1), len(patterns) > MAX_NEEDS)
    exact = {(w.target, w.mask) for w in needs}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(0)
        for batch in batches:
            x = _arrays(batch, d)
            there = bits(x)
            for w in needs:
                own = ~np.isnan(x[:, w.target])
                for s, b in [*w.groups.items(), (None, None)]:
                    shared = there & w.mask if w.mask is not None else there
                    rows = own & (shared == s if s is not None else (shared != 0) & ~np.isin(shared, [*w.groups]))
                    if not rows.any():
                        continue
                    y = x[rows]
                    v = y[:, w.target].copy()
                    unseen = [c for c in range(d) if not (s if s is not None else w.mask if w.mask is not None else -1) >> c & 1]
                    y[:, unseen] = np.nan
                    order = np.lexsort((v, *y.T))
                    y, v = y[order], v[order]
                    # of donors at one point the k of smallest value can be among the nearest k
                    same = ((y[1:] == y[:-1]) | (np.isnan(y[1:]) & np.isnan(y[:-1]))).all(axis=1)
                    start = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(v)), 0))
                    few = np.arange(len(v)) - start < k
                    y, v = y[few], v[few]
                    cell = b.place(y) if b is not None else w.loose + rng.integers(0, w.n_loose, len(y))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(v), _binary(y)], names=["cell", "v", "x"])

    def asked(x: np.ndarray, known: np.ndarray | None, t_of: np.ndarray | None, limit: np.ndarray | None) -> pa.RecordBatch:
        """Cells a query meets: at first the one it lies in of every group, then the others within its bound."""
        there = bits(x)
        cell, row, target = [], [], []
        for w in needs:
            own = np.isnan(x[:, w.target]) & (there != 0)
            if w.mask is not None:
                own &= there == w.mask
            else:
                own &= ~np.isin(there, [m for t, m in exact if t == w.target and m is not None])
            if t_of is not None:
                own &= t_of == w.target
            rows = np.flatnonzero(own)
            if not len(rows):
                continue
            found = []
            for s, b in w.groups.items():
                home = b.place(x[rows])
                if limit is None:
                    found.append((home, rows))
                else:
                    near = b.reach(x[rows]) * d / float(len(b.cols)) <= limit[rows, None]
                    near[np.arange(len(rows)), home - b.first] = False
                    r, c = np.nonzero(near)
                    found.append((c + b.first, rows[r]))
            if limit is None:
                found += [(np.full(len(rows), c), rows) for c in range(w.loose, w.loose + w.n_loose)]
            for c, r in found:
                cell.append(c)
                row.append(r)
                target.append(np.full(len(r), w.target))
        join = lambda a: np.concatenate([np.zeros(0, dtype=np.int64), *a]).astype(np.int32)
        cell, row, target = join(cell), join(row), join(target)
        bound = np.full(len(row), np.inf) if limit is None else limit[row]
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(target), pa.array(bound), _binary(x[row])], names=["cell", "t", "r", "q"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield asked(_arrays(batch, d), None, None, None)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                q = _floats(part.column(0), d)
                yield asked(q, None, part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False) * SLACK)

    def met(query: pa.Table, donor: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.binary()), ("t", pa.int32()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("v", pa.float64())])))])
        if not (query.num_rows and donor.num_rows):
            return schema.empty_table()
        dist, value = nearest_donors(_floats(query.column("q"), d), _floats(donor.column("x"), d), donor.column("v").to_numpy(), k, query.column("r").to_numpy())
        real = np.isfinite(dist)
        ends = np.r_[0, np.cumsum(real.sum(axis=1))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(dist[real]), pa.array(value[real])], names=["d", "v"])
        near = pa.ListArray.from_arrays(pa.array(ends), pairs)
        return pa.table([query.column("q").combine_chunks(), query.column("t").combine_chunks(), near], schema=schema)

    def meeting(asking: DataFrame) -> DataFrame:
        counts = asking.groupBy("cell").count().collect()  # cells
        parts = spark.createDataFrame([(r["cell"], -(-r["count"] // QUERIES_PER_BLOCK)) for r in counts], "cell int, parts int")
        left = asking.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), "q", "t", "r")
        right = placed.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "x")
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(met, f"q binary, t int, near {NEAR}")

    def best(x: DataFrame) -> DataFrame:
        return x.groupBy("q", "t").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(0), d)
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([w, batch.column(1), batch.column(2)], names=["w", "t", "near"])

    try:
        placed = kept(donors.mapInArrow(dealt, "cell int, v double, x binary"))
        first = kept(best(meeting(kept(vectors.mapInArrow(at_home, "cell int, t int, r double, q binary")))))
        bound = F.when(F.size("near") == k, F.element_at("near", k)["d"]).otherwise(F.lit(float("inf")))
        again = kept(first.select("q", "t", bound.alias("r")).mapInArrow(around, "cell int, t int, r double, q binary"))
        return cut_lineage(best(first.unionByName(meeting(again))).mapInArrow(unpacked, f"w array<double>, t int, near {NEAR}"))
    finally:
        for x in held:
            x.unpersist()
