"""Chained (round-robin regression) imputation on moments, not rows.

Within the rows that miss the same columns every filled cell is one affine function of
the observed ones. So a row's filled vector is ``A x`` with one matrix ``A`` per pattern of missing columns,
and the moments of the filled table are the sum of ``A M A'`` over patterns. One
aggregate takes the observed moments ``M`` per pattern; all rounds then update ``A`` and solve
small systems. The data are scanned once and nothing is written, whatever the rounds.

As many patterns as fit ``LOCAL_CELLS`` matrix cells are held by the driver; more stay a distributed table of one
row each, whose sums every step takes by a small job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.session import cut_lineage

#: Matrix cells of patterns that the driver holds at most.
LOCAL_CELLS = 4_000_000
#: Aggregates of one scan at most.
AGGREGATES = 400

Step = tuple[str, float, dict[str, float]]


@dataclass(frozen=True)
class ChainedPlan:
    """Ridge coefficients per round and column of a chained imputation."""

    cols: tuple[str, ...]
    targets: tuple[str, ...]
    means: dict[str, float]
    rounds: tuple[dict[str, tuple[float, dict[str, float]]], ...]


def pattern_moments(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pattern of present columns (a string of 0 and 1): rows ``n``, ``mean`` and upper triangle of ``cov``, null where a column is missing."""
    x = [F.col(c).cast("double") for c in cols]
    pattern = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in x])
    k = len(cols)
    # Centred inside the aggregate, so that large means cost no digits.
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    named = [F.avg(v).alias(f"m{i}") for i, v in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]
    rows = train.select(pattern.alias("pattern"), *cols)
    out = None
    for a in range(0, len(named), AGGREGATES):
        part = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n" if a == 0 else f"n_{a}"), *named[a : a + AGGREGATES])
        out = part if out is None else out.join(part.drop(f"n_{a}"), "pattern")
    return out.select("pattern", "n", F.array(*[f"m{i}" for i in range(k)]).alias("mean"), F.array(*[f"c{i}_{j}" for i, j in pairs]).alias("cov"))


class Patterns:
    """Moments and affine fills of a set of patterns, in standardised columns."""

    def __init__(self, rows: pd.DataFrame, mean: np.ndarray, sd: np.ndarray) -> None:
        p, k = len(rows), len(mean)
        self.seen = np.array([[c == "1" for c in s] for s in rows["pattern"]], bool).reshape(p, k)
        own = np.array([list(m) for m in rows["mean"]], float).reshape(p, k)
        cov = np.zeros((p, k, k))
        i, j = np.triu_indices(k)
        cov[:, i, j] = cov[:, j, i] = np.array([list(c) for c in rows["cov"]], float).reshape(p, len(i))
        n = rows["n"].to_numpy(float)
        z = np.where(self.seen, (own - mean) / sd, 0.0)
        both = self.seen[:, :, None] & self.seen[:, None, :]
        self.m = np.zeros((p, k + 1, k + 1))
        self.m[:, 0, 0] = n
        self.m[:, 0, 1:] = self.m[:, 1:, 0] = n[:, None] * z
        self.m[:, 1:, 1:] = np.where(both, n[:, None, None] * (cov / np.outer(sd, sd) + z[:, :, None] * z[:, None, :]), 0.0)
        self.a = np.zeros((p, k + 1, k + 1))  # missing columns start at their mean, which is zero here
        self.a[:, 0, 0] = 1.0
        self.a[:, np.arange(1, k + 1), np.arange(1, k + 1)] = self.seen

    def fill(self, target: int, beta: np.ndarray) -> None:
        """The regression of ``target`` (weights of 1 and of all columns) takes its place where it is missing."""
        at = ~self.seen[:, target]
        self.a[at, target + 1] = np.einsum("c,pcx->px", beta, self.a[at])

    def moments(self, target: int) -> np.ndarray:
        """Moments of [1, filled columns] over the rows that have ``target``."""
        at = self.seen[:, target]
        return np.einsum("pax,pxy,pby->ab", self.a[at], self.m[at], self.a[at], optimize=True)


def _spread(rows: Sequence, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column over all patterns that have it; 0 and 1 where there is none."""
    n, total, square = np.zeros(k), np.zeros(k), np.zeros(k)
    diagonal = [i * k - i * (i - 1) // 2 for i in range(k)]
    for r in rows:
        for i in range(k):
            if r["mean"][i] is not None:
                n[i] += r["n"]
                total[i] += r["n"] * r["mean"][i]
    mean = total / np.maximum(n, 1)
    for r in rows:
        for i in range(k):
            if r["mean"][i] is not None:
                square[i] += r["n"] * ((r["cov"][diagonal[i]] or 0.0) + (r["mean"][i] - mean[i]) ** 2)
    sd = np.sqrt(square / np.maximum(n, 1))
    return mean, np.where(sd > 0, sd, 1.0)


class _Distributed:
    """The same as ``Patterns`` on a table of patterns of any number: steps are replayed in tasks, only sums come back."""

    def __init__(self, table: DataFrame, mean: np.ndarray, sd: np.ndarray) -> None:
        self.table, self.mean, self.sd = table, mean, sd
        self.steps: list[tuple[int, np.ndarray]] = []

    def fill(self, target: int, beta: np.ndarray) -> None:
        self.steps.append((target, beta))

    def moments(self, target: int) -> np.ndarray:
        mean, sd, steps, k = self.mean, self.sd, list(self.steps), len(self.mean)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k + 1, k + 1))
            for rows in it:
                p = Patterns(rows, mean, sd)
                for t, beta in steps:
                    p.fill(t, beta)
                total += p.moments(target)
            a, b = np.indices(total.shape)
            yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "v": total.ravel()})

        out = np.zeros((k + 1, k + 1))
        for r in self.table.mapInPandas(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():  # (columns + 1) squared rows
            out[r["a"], r["b"]] = r["v"]
        return out


def fit_chained(train: DataFrame, cols: Sequence[str], targets: Sequence[str], rounds: int = 10, alpha: float = 1e-3, tolerance: float = 1e-6, local_cells: int = LOCAL_CELLS) -> ChainedPlan:
    """Each round regresses every target on the other columns as filled so far; ends early once no slope moves by ``tolerance``."""
    k = len(cols)
    table = pattern_moments(train, cols)
    most = max(1, local_cells // (k + 1) ** 2)
    rows = table.limit(most + 1).collect()
    if len(rows) <= most:
        mean, sd = _spread(rows, k)
        held: Patterns | _Distributed = Patterns(pd.DataFrame([r.asDict() for r in rows], columns=["pattern", "n", "mean", "cov"]), mean, sd)
    else:
        s = train.agg(*[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"m__{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s__{c}"))]).first()
        mean = np.array([s[f"m__{c}"] or 0.0 for c in cols])
        sd = np.array([s[f"s__{c}"] or 1.0 for c in cols])
        held = _Distributed(cut_lineage(table), mean, sd)
    history: list[dict[str, tuple[float, dict[str, float]]]] = []
    for _ in range(rounds):
        step: dict[str, tuple[float, dict[str, float]]] = {}
        for t in targets:
            i = list(cols).index(t)
            at = [0, *[j + 1 for j in range(k) if j != i]]
            m = held.moments(i)
            solved = np.linalg.solve(m[np.ix_(at, at)] + alpha * np.eye(k), m[at, i + 1])
            beta = np.zeros(k + 1)
            beta[at] = solved
            held.fill(i, beta)
            slope = {c: float(beta[j + 1] * sd[i] / sd[j]) for j, c in enumerate(cols) if j != i}
            step[t] = (float(mean[i] + beta[0] * sd[i] - sum(slope[c] * mean[j] for j, c in enumerate(cols) if j != i)), slope)
        history.append(step)
        if len(history) > 1 and k > 1:
            scale = dict(zip(cols, sd))
            moved = max(abs(v - history[-2][t][1][c]) * scale[c] / scale[t] for t in targets for c, v in step[t][1].items())
            if moved < tolerance:
                break
    return ChainedPlan(tuple(cols), tuple(targets), dict(zip(cols, map(float, mean))), tuple(history))


def _guess(cols: Sequence[str], target: str, step: tuple[float, dict[str, float]]) -> Column:
    const, slope = step
    guess = F.lit(const)
    for c in cols:
        if c != target:
            guess = guess + F.lit(slope[c]) * F.col(f"__f_{c}")
    return F.when(F.col(target).isNull(), guess).otherwise(F.col(f"__f_{target}"))


def apply_chained(df: DataFrame, plan: ChainedPlan) -> DataFrame:
    """Replay the learned rounds on any split; only null cells change."""
    work = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(plan.means[c])) for c in plan.cols})
    for step in plan.rounds:
        for t in plan.targets:
            work = work.withColumn(f"__f_{t}", _guess(plan.cols, t, step[t]))
    return work.withColumns({t: F.col(f"__f_{t}") for t in plan.targets}).drop(*[f"__f_{c}" for c in plan.cols])
