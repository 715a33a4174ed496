"""Codes of wide categorical columns: learned tables of any size, applied by a join.

A plan writes short category lists into its expressions. A column with more than
``LITERAL_CATEGORIES`` gets a table instead, one row per category with its code and what else was
learned of it. Rows meet the table in a left join; the few categories that many rows hold are looked up in
place and leave the join, so that no join key is hot. Works on streams (the table is the static side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.session import cut_lineage

#: Categories that a plan writes into its expressions at most; each is compared in turn for every row.
LITERAL_CATEGORIES = 200
#: Categories of at least this share of rows are looked up in place, so many at most.
HOT_SHARE = 0.001
HOT = 64
MISSING = "__MISSING__"
EPS = 0.5


@dataclass(frozen=True)
class CodeTable:
    """``rows``: ``category``, ``code`` (place among the sorted categories from 0) and further ``values``."""

    column: str
    fill: str
    size: int
    values: tuple[str, ...]
    hot: tuple[tuple, ...]
    rows: DataFrame

    @property
    def name(self) -> str:
        return f"__codes_{self.column}"

    def value(self, which: str, default: float) -> Column:
        """A value on a frame that went through :meth:`attach`; ``default`` for unseen categories."""
        return F.coalesce(F.col(self.name)[which], F.lit(default))

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the struct column that :meth:`value` reads."""
        v = F.coalesce(F.col(self.column).cast("string"), F.lit(self.fill))
        row = F.struct(*[F.col(c) for c in self.values])
        table = self.rows.select(F.col("category").alias("__category"), row.alias("__row"))
        kind = table.schema["__row"].dataType.simpleString()
        if not self.hot:
            return df.join(table, v == F.col("__category"), "left").withColumn(self.name, F.col("__row")).drop("__category", "__row")
        entry = lambda h: F.struct(*[F.lit(x).alias(c) for x, c in zip(h[1:], self.values)]).cast(kind)
        known = F.try_element_at(F.create_map(*[x for h in self.hot for x in (F.lit(h[0]), entry(h))]), v)
        # Keys of hot rows match nothing and lie apart.
        spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]), F.lit(4096)).cast("string"))
        keyed = df.withColumn("__hot", known).withColumn("__key", F.when(F.col("__hot").isNull(), v).otherwise(spread))
        out = keyed.join(table, F.col("__key") == F.col("__category"), "left")
        return out.withColumn(self.name, F.coalesce("__hot", "__row")).drop("__hot", "__key", "__category", "__row")


def attach_all(df: DataFrame, tables: Sequence[CodeTable]) -> DataFrame:
    for t in tables:
        df = t.attach(df)
    return df


def detach_all(df: DataFrame, tables: Sequence[CodeTable]) -> DataFrame:
    return df.drop(*[t.name for t in tables])


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``col`` (different values): ranges are sorted apart, their sizes say where each begins."""
    parts = cut_lineage(df.repartitionByRange(col).withColumn("__part", F.spark_partition_id()))
    begin, at = {}, 0
    for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # one row per range
        begin[r["__part"]] = at
        at += r["n"]
    if not begin:
        return parts.withColumn(name, F.lit(0).cast("bigint")).drop("__part")
    first = F.create_map(*[x for k, v in begin.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    place = F.row_number().over(Window.partitionBy("__part").orderBy(col)) - 1
    return parts.withColumn(name, F.element_at(first, F.col("__part")) + place).drop("__part")


def wide_columns(df: DataFrame, cols: Sequence[str], limit: int = LITERAL_CATEGORIES) -> dict[str, int]:
    """Columns with more different values than ``limit`` and about how many; one aggregate."""
    if not cols:
        return {}
    r = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(f"u{i}") for i, c in enumerate(cols)]).first()
    return {c: r[f"u{i}"] for i, c in enumerate(cols) if r[f"u{i}"] > limit}


def fit_code_table(df: DataFrame, col: str, fill: str = MISSING, y: str | None = None) -> tuple[CodeTable, float]:
    """Codes in sorted order with each category's ``share`` of non-null rows and, given ``y``, its weight of evidence ``woe``; and the information value."""
    v = F.coalesce(F.col(col).cast("string"), F.lit(fill))
    target = F.col(y).cast("int") if y else F.lit(None).cast("int")
    cells = df.groupBy(v.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("seen"), F.sum(1 - target).alias("good"), F.sum(target).alias("bad"))
    cells = cut_lineage(cells)
    t = cells.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("good").alias("cells")).first()
    g = (F.col("good") + EPS) / F.lit((t["good"] or 0) + EPS * (t["cells"] or 1))
    b = (F.col("bad") + EPS) / F.lit((t["bad"] or 0) + EPS * (t["cells"] or 1))
    table = cells.withColumn("share", F.col("seen") / F.lit(float(t["seen"] or 1)))
    values = ["code", "share"]
    iv = 0.0
    if y:
        table = table.withColumn("woe", F.coalesce(F.log(g / b), F.lit(0.0)))
        values.append("woe")
        iv = max(0.0, cells.agg(F.sum((g - b) * F.log(g / b)).alias("iv")).first()["iv"] or 0.0)
    table = cut_lineage(numbered(table, "category", "code").select("category", *values, "n"))
    often = table.where(F.col("n") >= HOT_SHARE * (t["n"] or 1)).orderBy(F.desc("n"), "category").limit(HOT).collect()
    return CodeTable(col, fill, t["k"], tuple(values), tuple((r["category"], *[r[c] for c in values]) for r in often), table.drop("n")), iv


def split_wide(cols: Sequence[str], specs: Mapping[str, object]) -> tuple[list[str], list[CodeTable]]:
    """The columns with short lists, and the code tables of the others."""
    wide = [t for c in cols if isinstance(t := specs[c], CodeTable)]
    return [c for c in cols if not isinstance(specs[c], CodeTable)], wide
