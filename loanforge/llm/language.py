"""Language identification by nearest centroid.

A text becomes a hashed vector of its 1-, 2- and 3-byte strings (lower case, runs of
other ASCII characters as one blank), weighted by square-root frequency times inverse
document frequency and scaled to length one. Each language has several centroids
found by spherical k-means; a text takes the language of the centroid of highest
cosine. A text is rejected when that cosine is far below what labelled texts of about
its length reach.

The model is fitted on a bounded sample, ``per_language`` labelled rows of each
language chosen by hash; the groups of one language are the only rows that meet in a
task. Prediction is one narrow pass over whole texts.

Results: ``lang_pred`` is ``und`` with score 0 and ``rejected`` for a null text, a text
without a letter, or when no language was learned; rows without label or key are not
learned from; a null key counts as not held out; equal cosines go to the language
first in order. Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.llm.common import joined_bytes, slices, stored

BUCKETS = 4096
#: Bytes of text, one row at least, that are counted at once: the arrays for them take some 70 times as many.
COUNT_BYTES = 256 << 10
PER_LANGUAGE = 1000
CENTROIDS = 3
#: Share of the lowest cosine of labelled texts of the same length class below which a text is rejected.
SLACK = 0.6
_CLASSES = 32

_FOLD = np.full(256, 32, np.uint8)
for _c in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_c] = _c
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32


def counts(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts per row and the bytes counted."""
    out, n, at, inside = np.zeros((len(texts), buckets), np.float32), np.zeros(len(texts), np.int64), 0, False
    for b in slices(iter([pa.record_batch([texts], names=["text"])]), 0, limit=COUNT_BYTES):
        n[at : at + b.num_rows], inside = _add_counts(b.column(0), out[at : at + b.num_rows], inside)
        at += b.num_rows
    return out, n


def _add_counts(texts: pa.Array, out: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Adds the counts of each row to ``out``; the bytes counted. ``inside``: whether the byte before the texts, and then their last one, is no blank."""
    buckets = out.shape[1]
    raw, offsets = joined_bytes(texts)
    low = _FOLD[raw]
    if len(raw) > 1:  # capitals of the Latin-1 letters: second byte after C3
        low[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
    keep = low != 32
    last = bool(keep[-1]) if len(keep) else inside
    keep[1:] |= keep[:-1]  # the first blank of a run stays
    keep[:1] |= inside
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    low = low[keep].astype(np.uint32)
    n = len(low)
    one = low * np.uint32(2654435761)
    two, three = one.copy(), one.copy()
    two[1:] = (low[1:] + (low[:-1] << np.uint32(8)) + np.uint32(1 << 24)) * np.uint32(2246822519)
    three[2:] = (low[2:] + (low[1:-1] << np.uint32(8)) + (low[:-2] << np.uint32(16)) + np.uint32(1 << 25)) * np.uint32(3266489917)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    grams = [(g >> shift).astype(np.int64) for g in (one, two, three)]
    for r in range(len(texts)):
        a, b = int(kept[r]), int(kept[r + 1])
        for k, g in enumerate(grams):
            if b - a > k:
                out[r] += np.bincount(g[a + k : b], minlength=buckets)
    return np.diff(kept), last


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(c) * idf)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), _CLASSES - 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are the mean and then the rows farthest from the seeds so far."""
    centres = [_unit(x.mean(axis=0))]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([_unit(x[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # lowest accepted cosine by language and length class

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and whether it is rejected."""
        c, n = counts(texts, len(self.idf))
        s = vectors(c, self.idf) @ self.centroids.T
        best = np.argmax(s, axis=1)
        score = np.clip(s[np.arange(len(s)), best], 0.0, 1.0).astype(float)
        lang = self.owner[best]
        return lang, score, score < self.least[lang, length_class(n)]


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, k: int = CENTROIDS, buckets: int = BUCKETS, slack: float = SLACK) -> Model:
    """Learn from labelled rows that are not held out, about ``per_language`` of each language."""
    rows = docs.where(~held_out(key) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("k"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0, int), np.zeros((0, buckets)), np.ones(buckets, np.float32), np.zeros((0, _CLASSES)))
    cut = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, per_language / n)))])
    part = F.pmod(F.xxhash64("k", "lang"), F.lit(1 << 30)) / float(1 << 30)
    # Small tables: at least the row of the lowest hash stands for a language.
    first = {r["lang"]: r["p"] for r in rows.groupBy("lang").agg(F.min(part).alias("p")).collect()}
    low = F.create_map(*[x for g, p in first.items() for x in (F.lit(g), F.lit(p))])
    sample = rows.where((part < cut[F.col("lang")]) | (part <= low[F.col("lang")])).select("lang", "text")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1):
            c, n = counts(b.column(1), buckets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in np.minimum(c, 65535).astype(np.uint16)], pa.binary())], names=["lang", "n", "c"])

    seen = stored(sample.mapInArrow(measure, "lang string, n bigint, c binary"), "language-sample")

    def presence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for b in it:
            for x in b.column(0).to_pylist():
                df += np.frombuffer(x, np.uint16) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, buckets), pa.int32()), pa.array([n, *df], pa.int64())], names=["i", "n"])

    df = {r["i"]: r["n"] for r in seen.select("c").mapInArrow(presence, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1)
    idf = np.array([np.log((1 + total) / (1 + df[i])) + 1 for i in range(buckets)], np.float32)

    def centres(t: pa.Table) -> pa.Table:
        x = vectors(np.array([np.frombuffer(v, np.uint16) for v in t.column("c").to_pylist()], np.float32), idf)
        c = cluster(x, k).astype(np.float32)
        best = np.max(x @ c.T, axis=1)
        least, size = np.full(_CLASSES, np.inf), length_class(t.column("n").to_numpy())
        np.minimum.at(least, size, best)
        least = np.minimum.accumulate(least[::-1])[::-1]  # a shorter text need not do better than a longer one
        least[np.isinf(least)] = best.max()
        least[: size.min()] = 0.0  # shorter than any seen: nothing is known
        g = t.column("lang")[0].as_py()
        return pa.table({"lang": [g] * len(c), "c": [v.tobytes() for v in c], "least": [(least * slack).tolist()] * len(c)}, schema=pa.schema([("lang", pa.string()), ("c", pa.binary()), ("least", pa.list_(pa.float64()))]))

    found = sorted(((r["lang"], bytes(r["c"]), r["least"]) for r in seen.groupBy("lang").applyInArrow(centres, "lang string, c binary, least array<double>").collect()))
    names = sorted({g for g, _, _ in found})
    owner = np.array([names.index(g) for g, _, _ in found])
    least = np.array([next(x for n, _, x in found if n == g) for g in names])
    return Model(names, owner, np.array([np.frombuffer(c, np.float32) for _, c, _ in found]), idf, least)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``rejected``, which replace columns of those names."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    at, names = docs.columns.index(text), docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(it, at):
            known = b.column(len(names)).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            lang, score, bad = m.predict(b.column(at)) if m.languages else (np.zeros(b.num_rows, int), np.zeros(b.num_rows), known)
            pred = [m.languages[g] if ok else "und" for g, ok in zip(lang, known)]
            cols = [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | bad)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *cols], names=[*names, "lang_pred", "score", "rejected"])

    empty = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    return src.mapInArrow(run, empty.schema)
