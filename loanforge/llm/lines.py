"""Cross-site boilerplate lines by distinct-site spread, with DataFrame operations only.

A line is known by two 64-bit hashes of its text without outer blanks. One HyperLogLog
sketch of sites per line is filled before the shuffle and merged after it, so a line
that a third of all rows hold is one row per task. Lines whose estimate is clearly above
``min_sites`` are boilerplate; for those within the sketch's error of it the sites are
counted exactly; the rest stay.

Boilerplate lines leave their documents, however much of one they are; a document whose
lines are all boilerplate or blank is a copy rather than a page with boilerplate and stays
whole, as removing copies is left to the near-duplicate operator.

Results: null texts stay null with no lines; an empty text is one empty line; blank lines
are never boilerplate; a null site counts for no line; rows with equal
key, null included, are judged each by its own lines; repeated rows give repeated results;
other columns pass through ``remove_boilerplate`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.llm.common import stored

MIN_SITES = 10
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _id(line: Column) -> Column:
    """Two hashes of a line as one string; null for a blank line."""
    t = F.trim(line)
    return F.when(t != "", F.concat_ws(":", F.xxhash64(t), F.xxhash64(F.lit(17), t)))


def _each_line(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key ``k``, text hash ``h``, place ``at`` and id of every line that is not blank."""
    # The text's hash is a field of the lines' array, so that it is taken once per text and not per line.
    one = F.array(F.struct(_lines(F.col(text)).alias("all"), F.xxhash64(text).alias("h")))
    each = F.flatten(F.transform(one, lambda x: F.transform(x["all"], lambda v, i: F.struct(x["h"].alias("h"), i.alias("at"), _id(v).alias("line")))))
    return docs.select(F.col(key).alias("k"), F.explode(F.filter(each, lambda x: x["line"].isNotNull())).alias("e")).select("k", "e.*")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Ids (``line``) of lines that stand on at least ``min_sites`` sites."""
    ids = F.array_distinct(F.transform(_lines(F.col(text)), _id))
    rows = docs.select(F.col(site).cast("string").alias("site"), F.explode(ids).alias("line")).where("line is not null")
    spread = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s")).select("line", F.hll_sketch_estimate("s").alias("n"))
    margin = max(1, math.ceil(5 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    some = stored(spread.where(F.col("n") >= min_sites - margin), "line-spread")
    sure, near = some.where(F.col("n") > min_sites + margin), some.where(F.col("n") <= min_sites + margin)
    exact = rows.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n"))
    return stored(sure.select("line").unionByName(exact.where(F.col("n") >= min_sites).select("line")), "boilerplate")


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, counts: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines; with ``counts`` also ``n_lines`` and ``n_removed``, which replace columns of those names."""
    found = boilerplate(docs, text, site, min_sites, lg_k)
    mine = _each_line(docs, key, text).join(found, "line", "left_semi")
    marks = mine.groupBy("k", "h").agg(F.collect_list("at").alias("gone"))
    new = ("n_lines", "n_removed") if counts else ()
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("row"), F.col(key).alias("own"), F.xxhash64(text).alias("own_h"), F.col(text).alias("t"))
    out = rows.join(marks, rows["own"].eqNullSafe(marks["k"]) & (rows["own_h"] == marks["h"]), "left")
    # Bound once as a lambda variable: lines are taken by place, in time linear in their number.
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), x["gone"]), lambda i: x["all"][i])
    stay = F.transform(F.array(F.struct(_lines(F.col("t")).alias("all"), F.col("gone").alias("gone"))), kept)[0]
    out = out.select("row", "t", F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    whole = F.col("stay").isNull() | ~F.exists("stay", lambda x: F.trim(x) != "")
    out = out.select("row", "t", "stay", whole.alias("whole"))
    changed = F.when(F.col("whole"), F.col("t")).otherwise(F.array_join("stay", "\n"))
    n_lines = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("t")))).cast("bigint")
    n_removed = F.when(F.col("whole"), F.lit(0).cast("bigint")).otherwise(n_lines - F.size("stay"))
    cols = [(changed if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in new]
    return out.select(*cols, *([n_lines.alias("n_lines"), n_removed.alias("n_removed")] if counts else []))
