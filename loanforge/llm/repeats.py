"""Removal of byte strings that also start in an earlier document, by column-wise suffix sorting.

Every ``WINDOW``-byte string is dealt to a bucket by its least-hashed ``SEED``-byte
substring, so equal strings meet and a run of windows with the same such substring (the
anchor) travels as one segment. The segments of a bucket are a collection of short
documents lined up at their anchors. Their suffixes are sorted column by column from the
right: each round adds one symbol per segment, the symbols before the sorted suffixes
are that round's Burrows-Wheeler transform, its stable order is the next round's
suffix order, and common prefixes of neighbours follow from range minima of the round
before. Neighbours with a common prefix of a whole window hold the same string.

Before they are sorted, segments go none of whose sides (the anchor and half a window's
rest beside it) is found in another document. A bucket holds the share of about ``BUCKET`` bytes of text. Segments equal within
a slice of the input are settled there, so a passage that a third of all documents hold
reaches its bucket once per slice. Marked windows and texts meet in blocks of bounded
size; a text is shuffled once.

Results: keys are whole numbers; a null text is empty; texts shorter than a window lose nothing; strings that
repeat only inside one document stay; a null key comes after all others; rows with
equal key are one document; lengths and spans count bytes of UTF-8; columns other than the
key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanforge.llm.common import joined_bytes, slices, stored

WINDOW = 50
SEED = 16
SPAN = WINDOW - SEED + 1  # places of a seed in a window
WIDTH = WINDOW + SPAN - 1  # columns of a segment: anchors stand at column SPAN - 1
BUCKET = 8 << 20
BLOCK = 8 << 20
_SLICE = 4 << 20
_LAST = np.iinfo(np.int64).max
#: ``twin``: hash of the text, which tells rows of one key apart; ``block``: where the text meets its marks.
_ROW = np.dtype([("doc", "<i8"), ("twin", "<i8"), ("block", "<i4"), ("start", "<i4"), ("left", "u1"), ("count", "u1")])
_MIX = np.random.default_rng(11).integers(1, 2**63, WIDTH // 8 + 1, dtype=np.uint64) | np.uint64(1)


def _seed_hashes(raw: np.ndarray) -> np.ndarray:
    """32-bit hash of the seed that starts at every byte."""
    w = raw.astype(np.uint32)
    w = w[:-1] | (w[1:] << np.uint32(8))
    w = w[:-2] | (w[2:] << np.uint32(16))
    h = w[:-4] * np.uint32(0x9E3779B1) + w[4:] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(16)
    h = h[:-8] * np.uint32(0xC2B2AE3D) + h[8:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def segments(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of joined texts and their bytes, one row of ``WIDTH`` columns each; ``rows`` has doc, twin and block."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, _ROW), np.zeros((0, WIDTH), np.uint8)
    h = _seed_hashes(raw)
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(SPAN - 32)], least[SPAN - 32 :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts at each byte
    valid = np.ones(len(anchor) + WINDOW, bool)
    ends = offsets[1:]
    for k in range(1, WINDOW):  # windows must not cross the end of their text
        at = ends - k
        valid[at[(at >= 0) & (at < len(valid))]] = False
    valid = valid[: len(anchor)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    a = np.flatnonzero(new)
    stop = ~valid
    stop = np.flatnonzero(np.concatenate((new[1:] | stop[1:], [True])) & valid)
    row = np.searchsorted(offsets, a, side="right") - 1
    out = np.zeros(len(a), _ROW)
    p = anchor[a]
    out["left"], out["count"] = p - a, stop - a + 1
    out["start"] = a - offsets[row]
    for f in ("doc", "twin", "block"):
        out[f] = rows[f][row]
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint8), raw, np.zeros(WIDTH, np.uint8)))
    text = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[p]
    column = np.arange(WIDTH, dtype=np.uint8)
    first = (SPAN - 1 - out["left"])[:, None]
    text[(column < first) | (column >= first + out["count"][:, None] + WINDOW - 1)] = 0
    return out, text


def _anchor_hash(text: np.ndarray) -> np.ndarray:
    return _seed_hashes(np.ascontiguousarray(text[:, SPAN - 1 : SPAN - 1 + SEED]).ravel())[::SEED] if len(text) else np.zeros(0, np.uint32)


def _shared(seg: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Segments that may hold a window of another document.

    A window holds its anchor and the bytes around it, at least half of them on one side. So two
    segments of one window have equal bytes there, and a segment none of whose sides is found in
    another document holds no such window.
    """
    half = (WINDOW - SEED + 1) // 2
    out = np.zeros(len(seg), bool)
    for a, b in ((SPAN - 1, SPAN - 1 + SEED + half), (SPAN - 1 - half, SPAN - 1 + SEED)):
        wide = np.zeros((len(seg), -(-(b - a) // 8) * 8), np.uint8)
        wide[:, : b - a] = text[:, a:b]
        key = (wide.view(np.uint64) * _MIX[: wide.shape[1] // 8]).sum(axis=1)
        key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        k, doc = key[order], seg["doc"][order]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else []
        if len(k):
            many = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
            out[order] |= np.repeat(many, np.diff(np.append(starts, len(k))))
    return out


def settle(seg: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments are needed further, and which are repeats of an equal segment of a smaller document."""
    if not len(seg):
        return np.zeros(0, bool), np.zeros(0, bool)
    wide = np.zeros((len(seg), len(_MIX) * 8), np.uint8)
    wide[:, :WIDTH] = text
    wide[:, -2], wide[:, -1] = seg["left"], seg["count"]
    key = (wide.view(np.uint64) * _MIX).sum(axis=1)
    key ^= key >> np.uint64(31)
    order = np.lexsort((seg["doc"], key))
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of the smallest document
    same = (wide[order] == wide[first]).all(axis=1)
    repeat = np.zeros(len(seg), bool)
    repeat[order] = same & (seg["doc"][order] > seg["doc"][first])
    return ~repeat, repeat


def _range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of entries ``lo`` to ``hi`` inclusive by two overlapping powers of two."""
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.uint8)
    for j in np.unique(k):
        while len(levels) <= j:
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        at = np.flatnonzero(k == j)
        out[at] = np.minimum(levels[j][lo[at]], levels[j][hi[at] - (1 << j) + 1])
    return out


def repeated_windows(seg: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per segment and column, whether the window that starts there also starts in a smaller document."""
    n = len(seg)
    marks = np.zeros((n, SPAN), bool)
    if n < 2:
        return marks
    columns = np.ascontiguousarray(text.T)
    first = SPAN - 1 - seg["left"].astype(np.int64)
    last = first + seg["count"] - 1
    order, common = np.arange(n), np.full(n, WINDOW, np.uint8)  # before any symbol all suffixes are the empty string
    for c in range(WIDTH - 1, -1, -1):
        before = columns[c][order]  # the symbols before the sorted suffixes: the transform of this round
        to = np.argsort(before, kind="stable")
        symbol = before[to]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        longer = np.zeros(n, np.uint8)
        longer[same] = np.minimum(_range_min([common], to[same - 1] + 1, to[same]), WINDOW - 1) + 1
        order, common = order[to], longer
        if c < SPAN:
            group = np.cumsum(common < WINDOW)
            ok = (first[order] <= c) & (c <= last[order])
            rows, group = order[ok], group[ok]
            if len(rows):
                starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                doc = seg["doc"][rows]
                least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(rows))))
                marks[rows[doc > least], c] = True
    return marks


def _all_windows(seg: np.ndarray) -> np.ndarray:
    first = (SPAN - 1 - seg["left"].astype(np.int64))[:, None]
    c = np.arange(SPAN)
    return (c >= first) & (c < first + seg["count"][:, None])


_MARK = np.dtype([("doc", "<i8"), ("twin", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def _marked(seg: np.ndarray, marks: np.ndarray) -> list[tuple[int, bytes]]:
    """Runs of marked windows as covered bytes, packed by block."""
    wide = np.zeros((len(seg), SPAN + 2), np.int8)
    wide[:, 1:-1] = marks
    edge = np.diff(wide, axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    out = np.zeros(len(row), _MARK)
    base = seg["start"].astype(np.int64) - (SPAN - 1 - seg["left"].astype(np.int64))
    out["doc"], out["twin"] = seg["doc"][row], seg["twin"][row]
    out["start"], out["stop"] = base[row] + a, base[row] + b - 1 + WINDOW
    block = seg["block"][row]
    order = np.lexsort((out["start"], out["twin"], out["doc"], block))
    out, block = out[order], block[order]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
    return [(int(block[i]), _pack(out[i:j])) for i, j in zip(cuts, [*cuts[1:], len(block)])]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays field by field, compressed: neighbours are alike."""
    body = b"".join(np.ascontiguousarray(x[f]).tobytes() for x in arrays for f in (x.dtype.names or (...,)))
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(body, asbytes=True)


def _unpack(blob: bytes, dtype: np.dtype, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    body = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n, at = size // (dtype.itemsize + width), 0
    out = np.zeros(n, dtype)
    for f in dtype.names:
        out[f] = np.frombuffer(body, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return out, np.frombuffer(body, np.uint8, n * width, at).reshape(n, width)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET, block_bytes: int = BLOCK) -> DataFrame:
    """Per row: the key, ``n_bytes``, removed byte ``spans`` and the ``kept`` bytes."""
    total = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    n_buckets, n_blocks = -(-total // bucket_bytes) + 1, -(-total // block_bytes) + 1
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST))
    src = docs.select(F.col(key).alias("k"), order.alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    src = src.select("*", F.xxhash64("t").alias("twin"))
    src = src.select("*", F.pmod(F.xxhash64("doc", F.when(F.col("doc") == _LAST, F.col("twin"))), F.lit(n_blocks)).cast("int").alias("block"))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by bucket; marks that a slice settles by itself, with the number of their block below zero."""
        for b in slices(it, 3, 1 << 16, _SLICE):
            rows = {f: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(("doc", "twin", "block"))}
            seg, body = segments(*joined_bytes(b.column(3)), rows)
            need, repeat = settle(seg, body)
            places, blobs = [], []
            for block, blob in _marked(seg[repeat], _all_windows(seg[repeat])):
                places.append(-1 - block)
                blobs.append(blob)
            seg, body = seg[need], body[need]
            place = ((_anchor_hash(body).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(n_buckets)
            at = np.argsort(place, kind="stable")
            seg, body, place = seg[at], body[at], place[at]
            cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(seg) else []
            for i, j in zip(cuts, [*cuts[1:], len(seg)]):
                places.append(int(place[i]))
                blobs.append(_pack(seg[i:j], body[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], names=["place", "blob"])

    def meet(t: pa.Table) -> pa.Table:
        place = t.column("place")[0].as_py()
        if place < 0:
            return pa.table({"block": pa.array([-1 - place] * t.num_rows, pa.int32()), "blob": t.column("blob")})
        parts = [_unpack(x.as_py(), _ROW, WIDTH) for x in t.column("blob")]
        seg, body = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        near = _shared(seg, body)
        seg, body = seg[near], body[near]
        need, repeat = settle(seg, body)
        found = [*_marked(seg[repeat], _all_windows(seg[repeat])), *_marked(seg[need], repeated_windows(seg[need], body[need]))]
        return pa.table({"block": pa.array([x for x, _ in found], pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})

    marks = src.select("doc", "twin", "block", "t").mapInArrow(deal, "place bigint, blob binary").groupBy("place").applyInArrow(meet, "block int, blob binary")
    marks = stored(marks, "repeats", drop_shuffle=True)
    kinds = {"n_bytes": "bigint", "spans": "array<struct<start:int,stop:int>>", "kept": "binary"}
    out_schema = docs.select(F.col(key), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(d: pa.Table, m: pa.Table) -> pa.Table:
        d = d.combine_chunks()
        marks = [_unpack(x.as_py(), _MARK)[0] for x in m.column("blob")]
        mark = np.concatenate(marks) if marks else np.zeros(0, _MARK)
        mark = mark[np.lexsort((mark["twin"], mark["doc"]))]
        ids = np.rec.fromarrays([mark["doc"], mark["twin"]], names="doc,twin")
        texts = [x.as_py().encode() for x in d.column("t")]
        spans, kept = [], []
        for doc, twin, raw in zip(d.column("doc").to_pylist(), d.column("twin").to_pylist(), texts):
            lo, hi = np.searchsorted(mark["doc"], doc, "left"), np.searchsorted(mark["doc"], doc, "right")
            own = mark[lo:hi][ids["twin"][lo:hi] == twin]
            if not len(own):
                spans.append([])
                kept.append(raw)
                continue
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, own["start"], 1)
            np.add.at(depth, own["stop"], -1)
            gone = np.cumsum(depth)[:-1] > 0
            edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            spans.append([{"start": int(a), "stop": int(z)} for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        cols = [d.column("k"), pa.array([len(x) for x in texts], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
        return pa.table(cols, names=[f.name for f in out_schema.fields])

    return src.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut, out_schema)
