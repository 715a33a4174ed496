"""How far the sources of a language differ in their words: a source divergence audit.

``bytes.translate`` with one table lowers ASCII letters and blanks every byte that is
no letter; ``bytes.split`` gives the terms, a ``Counter`` per document their
frequencies. Each slice of texts adds its documents up to one row per language, source
and term before the shuffle, so a source that holds a third of all rows is a few rows
per task for each of its terms.

Every language keeps the terms of at least ``min_docs`` of its documents. Each group (language,
source) and each language gives a kept term the smoothed share
``1 + floor(SCALE * (count + ADD) / (N + ADD * V))``, ``N`` the count of all kept
terms there and ``V`` their number; decimals keep this exact at any size.

Pairs of sources are compared over all kept terms. Sources are taken in blocks of
``SOURCE_BLOCK`` and terms in chunks; each task adds up one small matrix per pair of
blocks and chunk, so no pair is emitted per term, and terms that neither block has
enter as a product.

Results: null text, language and source are the empty string; a group without terms is
compared all the same; a language without kept terms has distance 0 between its
sources; ties go to the lesser UTF-8 bytes; repeated rows count as often as they
stand there; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.llm.common import slices, stored

MIN_DOCS = 30
SCALE = 1_000_000_000
ADD = 5
TOP_TERMS = 50
SOURCE_BLOCK = 64
#: Entries of a slice's counters after which they are handed on.
HELD = 200_000

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> Counter:
    """Frequency of every term of one text, as UTF-8 bytes."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of each term per group; a row without term holds the documents of the group."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for (a, b), counts in n.items():
                held = len(counts)
                of = seen[a, b]
                for c, x in zip(cols, ([a] * held, [b] * held, [None if t is None else t.decode("utf-8", "replace") for t in counts], counts.values(), [of[t] for t in counts])):
                    c.extend(x)
            n.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

        for b in slices(it, 2):
            for a, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts = terms_of(t)
                n[a, s].update(counts)
                seen[a, s].update(counts.keys())
                n[a, s][None] += 0
                seen[a, s][None] += 1
            if sum(map(len, n.values())) >= HELD:
                yield rows()
        if n:
            yield rows()

    return src.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``term``, its occurrences in the language and those in each source, for terms of enough documents."""
    by = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by.where(F.col("docs") >= min_docs).select("lang", "term", "n", "sources")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in units of 1/SCALE, exact; null where nothing is kept."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADD).cast("decimal(19,0)")
    below = (total + ADD * kept).cast("decimal(19,0)")
    return F.when(kept > 0, F.call_function("div", top, below) + 1)


def _groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group with its count ``total`` of kept terms, place ``at`` in its language, share ``unseen`` of a term that it lacks, and the language's ``kept`` and ``lang_total``."""
    of_group = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    full = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    full = full.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "kept")])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = F.count("*").over(Window.partitionBy("lang"))
    return full.select("*", at.alias("at"), sources.alias("sources"), F.coalesce(_share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)).alias("unseen"))


def _cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each kept term of each source that has it, with the share ``p`` there and ``q`` in the language."""
    c = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("sources").alias("s")).select("lang", "term", "n_lang", "s.source", "s.n")
    c = c.join(groups, ["lang", "source"])
    return c.select("lang", "source", "at", "sources", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("n_lang"), F.col("lang_total"), F.col("kept")).alias("q"))


_SUMS = "lang string, i int, j int, value bigint, terms bigint"


def _summed(table: pa.Table) -> pa.Table:
    """Differences of all pairs of sources of two blocks over the terms of one chunk; a row without term holds the share of unseen terms."""
    at, p, term = (table.column(c).to_numpy() for c in ("at", "p", "term"))
    lang, lo, hi = (table.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    seen = table.column("term").is_valid().to_numpy()
    members, base = at[~seen], p[~seen]
    order = np.argsort(members)
    members, base = members[order], base[order]
    left, right = members // SOURCE_BLOCK == lo, members // SOURCE_BLOCK == hi
    names, row = np.unique(term[seen].astype(np.int64), return_inverse=True)
    col, value = np.searchsorted(members, at[seen]), p[seen]
    by = np.argsort(row, kind="stable")
    row, col, value = row[by], col[by], value[by]
    total = np.zeros((int(left.sum()), int(right.sum())), np.int64)
    for k in range(0, len(names), 1024):
        a, b = np.searchsorted(row, [k, k + 1024])
        m = np.tile(base, (min(1024, len(names) - k), 1))
        m[row[a:b] - k, col[a:b]] = value[a:b]
        total += np.abs(m[:, left, None] - m[:, None, right]).sum(axis=0)
    i, j = np.meshgrid(members[left], members[right], indexing="ij")
    pairs = i < j
    n = int(pairs.sum())
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(i[pairs], pa.int32()), pa.array(j[pairs], pa.int32()), pa.array(total[pairs]), pa.array(np.full(n, len(names)), pa.int64())], names=["lang", "i", "j", "value", "terms"])


def distances(groups: DataFrame, cells: DataFrame, chunks: int) -> DataFrame:
    """``lang``, ``source``, ``item`` and ``value``: summed difference of the shares of two sources over all kept terms, in both orders."""
    block = F.floor(F.col("at") / SOURCE_BLOCK).cast("int")
    last = F.floor((F.col("sources") - 1) / SOURCE_BLOCK).cast("int")
    with_all = F.explode(F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.least(b, block).alias("lo"), F.greatest(b, block).alias("hi"))))
    name = F.xxhash64("term")
    rows = cells.select("lang", "at", "p", name.alias("term"), F.pmod(name, F.lit(chunks)).cast("int").alias("chunk"), with_all.alias("b"))
    const = groups.select("lang", "at", F.col("unseen").alias("p"), F.lit(None).cast("bigint").alias("term"), F.sequence(F.lit(0), F.lit(chunks - 1)).alias("c"), with_all.alias("b"))
    rows = rows.unionByName(const.withColumn("chunk", F.explode("c")).drop("c")).select("lang", "at", "p", "term", "chunk", "b.lo", "b.hi")
    sums = rows.groupBy("lang", "lo", "hi", "chunk").applyInArrow(_summed, _SUMS).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"), "value", "terms")
    side = lambda k, to: groups.select("lang", F.col("at").alias(k), F.col("source").alias(to), F.col("unseen").alias(f"{k}_unseen"), *(["kept"] if k == "a" else []))
    named = both.select("lang", "e.a", "e.b", "value", "terms").join(side("a", "source"), ["lang", "a"]).join(side("b", "item"), ["lang", "b"])
    rest = (F.col("kept") - F.col("terms")) * F.abs(F.col("a_unseen") - F.col("b_unseen"))
    return named.select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source", chunk_terms: int = 8192) -> DataFrame:
    """Part ``pair``: all other sources of the language by distance; part ``term``: the terms that a source uses more than its language does, ``top_terms`` of them."""
    counts = stored(term_counts(docs, text, lang, source), "term-counts", drop_shuffle=True)
    kept = stored(kept_terms(counts, min_docs), "kept-terms", drop_shuffle=True)
    groups = stored(_groups(counts, kept), "groups", drop_shuffle=True)
    cells = _cells(kept, groups)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = distances(groups, cells, -(-kept.count() // chunk_terms) or 1)
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    term = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pair.unionByName(term)
