"""Suffix-safe joins and join reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.session import cut_lineage



@dataclass(frozen=True)
class JoinSpec:
    """One step of an integration: join ``right_table`` on a key pair."""

    right_table: str
    left_key: str
    right_key: str
    how: str = "left"


def join_step(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Left or inner equi join; clashing right columns get a ``_<table>`` suffix.

    Null keys match nothing. The plan carries no hint, so Spark broadcasts the
    right side only when its size allows and splits skewed keys otherwise.
    """
    if spec.how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {spec.how!r}")
    if spec.left_key not in left.columns:
        raise ValueError(f"join key {spec.left_key!r} not in the data built so far")
    if spec.right_key not in right.columns:
        raise ValueError(f"join key {spec.right_key!r} not in table {spec.right_table!r}")
    same = spec.left_key == spec.right_key
    clash = {c for c in right.columns if c in left.columns}
    renamed = right.select(
        *[F.col(c).alias(f"{c}_{spec.right_table}" if c in clash else c) for c in right.columns]
    )
    rk = f"{spec.right_key}_{spec.right_table}" if spec.right_key in clash else spec.right_key
    out = left.join(renamed, left[spec.left_key] == renamed[rk], spec.how)
    return out.drop(rk) if same else out


def join_report(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Row counts, unmatched rows, orphan keys and duplicates of one step as one row.

    Everything follows from rows per key on both sides, so the join itself is not
    run and a hot key is one row on each side.
    """
    one = F.lit(1).alias("n")
    return _report(left.select(F.col(spec.left_key).alias("k"), one), right.select(F.col(spec.right_key).alias("k"), one), spec)


def _report(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """The report from keys ``k`` that stand for ``n`` rows each, on both sides."""
    lk = left.groupBy(F.col("k").cast("string").alias("k")).agg(F.sum("n").alias("nl"))
    rk = right.groupBy(F.col("k").cast("string").alias("k")).agg(F.sum("n").alias("nr"))
    both = lk.join(rk, "k", "full")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    miss = F.sum(F.when(F.col("nr").isNull(), nl).otherwise(0))
    left_join = spec.how == "left"
    s = both.agg(
        F.sum(nl).alias("rows_before"),
        F.sum(nl * nr).alias("matched"),
        miss.alias("miss"),
        F.count_if(F.col("nl").isNull() & F.col("k").isNotNull()).alias("orphan_right"),
        F.sum(F.when(nl > 1, nl).otherwise(0)).alias("duplicate_left_keys"),
        F.sum(F.when(nr > 1, nr).otherwise(0)).alias("duplicate_right_keys"),
    )
    after = F.col("matched") + F.col("miss") if left_join else F.col("matched")
    return s.select(
        F.lit(spec.right_table).alias("right_table"),
        F.lit(spec.left_key).alias("left_key"),
        F.lit(spec.right_key).alias("right_key"),
        F.lit(spec.how).alias("how"),
        "rows_before",
        after.alias("rows_after"),
        (F.col("miss") if left_join else F.lit(0).cast("bigint")).alias("unmatched_left"),
        "orphan_right",
        "duplicate_left_keys",
        "duplicate_right_keys",
        (after > F.col("rows_before")).alias("fan_out"),
    )


def integrate(base: DataFrame, tables: Mapping[str, DataFrame], specs: Sequence[JoinSpec]) -> DataFrame:
    """Base table with every spec joined in order: one lazy join tree."""
    for s in specs:
        if s.right_table not in tables:
            raise ValueError(f"join references unknown table {s.right_table!r}")
    return reduce(lambda acc, s: join_step(acc, tables[s.right_table], s), specs, base)


def integration_report(base: DataFrame, tables: Mapping[str, DataFrame], specs: Sequence[JoinSpec]) -> DataFrame:
    """One report row per step of :func:`integrate`, without running its joins.

    What is carried from step to step is a table of row weights: the different values of the keys that later steps
    use, each with the number of rows that have them. A step multiplies weights by the right side's
    rows per key, so every table is scanned once and no step repeats the ones before it.
    """
    columns, needed = list(base.columns), [s.left_key for s in specs]

    def weights(df: DataFrame, keep: Sequence[str], n: Column) -> DataFrame:
        return cut_lineage(df.groupBy(*dict.fromkeys(keep)).agg(F.sum(n).cast("bigint").alias("__n")))

    def checked(i: int) -> None:
        if needed[i] not in columns:
            raise ValueError(f"join key {needed[i]!r} not in the data built so far")

    checked(0)
    acc = weights(base, [c for c in needed if c in columns], F.lit(1))
    out = []
    for i, s in enumerate(specs):
        checked(i)
        right = tables[s.right_table]
        later = set(needed[i + 1 :])
        # The names that join_step gives to the right side's columns.
        named = {c: f"{c}_{s.right_table}" if c in columns else c for c in right.columns}
        own = {c: n for c, n in named.items() if n in later and not (c == s.right_key and s.left_key == s.right_key)}
        side = weights(right.select(F.col(s.right_key).alias("__key"), *[F.col(c).alias(n) for c, n in own.items()]), ["__key", *own.values()], F.lit(1))
        out.append(_report(acc.select(F.col(s.left_key).alias("k"), F.col("__n").alias("n")), side.select(F.col("__key").alias("k"), F.col("__n").alias("n")), s).withColumn("step", F.lit(i + 1)))
        columns += [n for c, n in named.items() if not (c == s.right_key and s.left_key == s.right_key)]
        if later:
            met = acc.join(side.withColumnRenamed("__n", "__m"), acc[s.left_key] == F.col("__key"), s.how)
            acc = weights(met, [c for c in needed[i + 1 :] if c in columns], F.col("__n") * F.coalesce("__m", F.lit(1)))
    return reduce(DataFrame.unionByName, out)
