"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton over the items' words holds every word string that occurs in any
item. Training words stream through it; the state keeps the longest match that
ends at each word. A match of ``window`` words, or of a whole shorter item, is a
hit on its words, and the automaton knows the items that hold it.

The automaton's first two levels (which words and which neighbouring pairs occur)
are arrays, so that most text is passed over by array operations; only runs of
known pairs as long as the shortest window go through the states word by word.

Items are taken in blocks of at most ``block_words`` words, one broadcast automaton and one
narrow pass each. What a pass found is written before the next block's automaton is made and the
last one is dropped, so memory does not grow with the benchmark; documents are never shuffled.

Results: null and empty texts have no words and no hits; null or empty items have
no windows; items without an id hit words but are not listed; rows with equal
``item_id`` are one item; repeated documents get repeated rows; an empty item table
hits nothing. Other columns of the documents pass through ``decontaminate`` as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.llm.common import discard, joined_bytes, slices, stored, word_table

WINDOW = 10
BLOCK_WORDS = 1_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_LOWER = np.zeros(256, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LOWER[_c] = _c
for _c in range(0x41, 0x5B):
    _LOWER[_c] = _c + 32
_INSIDE = _LOWER > 0


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


class Items:
    """Generalised suffix automaton of items given as ``(id, words)``."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in seqs:
            v = 0
            for c in s:
                v = self._extend(v, c)
        self.holders: list[set[int]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, s in enumerate(seqs):
            v = 0
            for c in s:
                v = u = self.next[v][c]
                while u > 0 and k not in self.holders[u]:
                    self.holders[u].add(k)
                    u = self.link[u]
            if 0 < len(s) < window:
                while self.length[self.link[v]] >= len(s):
                    v = self.link[v]
                self.short[v].append((len(s), k))
        self.least = min([window, *(len(s) for s in seqs if s)])
        self._levels(seqs)

    def _extend(self, last: int, c: int) -> int:
        """Add word ``c`` after state ``last`` of the current item; returns the state of the longer prefix."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1)
        self.next[twin] = dict(self.next[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _levels(self, seqs: list[list[int]]) -> None:
        """Words and pairs as sorted arrays, each with a bitmap in front."""
        joined = np.frombuffer(b" ".join(self.vocab) or b" ", np.uint8)
        h = word_table(joined, joined != 32, np.array([0, len(joined)]))[2]
        order = np.argsort(h, kind="stable")
        self.hashes, self.hash_ids = h[order], order.astype(np.int64)
        self.words = list(self.vocab)
        self.has_word = np.zeros(1 << 20, bool)
        self.has_word[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        n = len(self.words)
        self.pairs = np.unique(np.array([a * n + b for s in seqs for a, b in zip(s, s[1:])], dtype=np.int64))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            some = np.flatnonzero(self.has_word[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            out[some] = np.where(self.hashes[at] == h[some], self.hash_ids[at], -1)
        return out

    def runs(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges of one row whose neighbouring pairs all occur in items, at least as long as the shortest window."""
        if not len(ids) or not len(self.words):
            return
        if self.least == 1:
            ok, extra = ids >= 0, 0
        else:
            ok, extra = np.zeros(len(ids), bool), 1
            some = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:]))
            if len(some) and len(self.pairs):
                code = ids[some] * len(self.words) + ids[some + 1]
                at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                ok[some[self.pairs[at] == code]] = True
        edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for i, j in zip(a, b):
            if j - i + extra >= self.least:
                cuts = [i, *(np.flatnonzero(np.diff(row[i : j + extra])) + i + 1), j + extra] if not extra else [i, j + extra]
                yield from zip(cuts, cuts[1:])

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """``(start, end, items)`` of every window occurrence in a word list."""
        state = matched = 0
        get = self.vocab.get
        for end, w in enumerate(words, 1):
            c = get(w, -1)
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c not in self.next[state]:
                continue
            state, matched = self.next[state][c], matched + 1
            u = state
            while u:
                if matched >= self.window and self.length[self.link[u]] < self.window <= self.length[u]:
                    yield end - self.window, end, self.holders[u]
                for k, item in self.short[u]:
                    if k <= matched:
                        yield end - k, end, {item}
                u = self.link[u]


def _blocks(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, words = [], 0
    for r in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        w = words_of(r[1])
        block.append((r[0], w))
        words += len(w)
        if words >= size:
            yield block
            block, words = [], 0
    if block:
        yield block


def _merge(pairs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_STATE = [("__n_words", T.LongType()), ("__n_hit", T.LongType()), ("__spans", _SPANS), ("__runs", _SPANS), ("__items", T.ArrayType(T.StringType()))]


def _scan(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, block_words: int) -> DataFrame:
    """``docs`` with the word count, hit words, hit byte spans, hit word runs and item ids of each row."""
    sc = docs.sparkSession.sparkContext
    empty = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _STATE])
    names = empty.columns
    column = docs.columns.index(text)

    def step(items_of_block):
        shared = sc.broadcast(Items(items_of_block, window))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(it, column):
                auto = shared.value
                raw, offsets = joined_bytes(b.column(column))
                low = _LOWER[raw]
                start, end, h, row = word_table(low, _INSIDE[raw], offsets)
                first = np.searchsorted(row, np.arange(b.num_rows + 1))
                found: dict[int, tuple[list, set]] = {}
                for i, j in auto.runs(auto.lookup(h), row):
                    words = [low[start[k] : end[k]].tobytes() for k in range(i, j)]
                    for a, z, held in auto.matches(words):
                        hit = found.setdefault(int(row[i]), ([], set()))
                        hit[0].append((int(i + a - first[row[i]]), int(i + z - first[row[i]])))
                        hit[1].update(held)
                runs = b.column(len(names) - 2).to_pylist()
                ids = b.column(len(names) - 1).to_pylist()
                n_hit, spans = [], []
                for r in range(b.num_rows):
                    if r in found:
                        runs[r] = _merge([*found[r][0], *((x, y) for x, y in runs[r] or [])])
                        ids[r] = sorted({*(ids[r] or []), *(auto.ids[k] for k in found[r][1] if auto.ids[k] is not None)})
                    runs[r], ids[r] = runs[r] or [], ids[r] or []
                    n_hit.append(sum(y - x for x, y in runs[r]))
                    spans.append([[int(start[first[r] + x] - offsets[r]), int(end[first[r] + y - 1] - offsets[r])] for x, y in runs[r]])
                pairs = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: len(names) - 5], pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pairs), pa.array(runs, pairs), pa.array(ids, pa.list_(pa.string()))], names=names
                )

        return run, shared

    out, before, held = empty, None, []
    for block in _blocks(items, item_id, item_text, block_words) if items is not None else ():
        if before is not None:  # what the blocks before this one found is written; one automaton at a time is in memory
            out = stored(out, "scan")
            held.append(out)
            before.destroy()
            if len(held) > 1:
                discard(held[-2])
        run, before = step(block)
        out = out.mapInArrow(run, empty.schema)
    return out.mapInArrow(step([])[0], empty.schema) if out is empty else out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``n_hit``, ``coverage``, hit byte ``spans`` of the UTF-8 text, and ``items`` that occur."""
    out = _scan(docs.select(F.col(key), F.col(text).alias("__text")), items, "__text", item_id, item_text, window, block_words)
    cover = F.when(F.col("__n_words") > 0, F.col("__n_hit") / F.col("__n_words")).otherwise(F.lit(0.0))
    return out.select(key, F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), cover.alias("coverage"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans; rows with more than ``max_coverage`` of their words hit are left out."""
    out = _scan(docs, items, text, item_id, item_text, window, block_words)

    # What stays is cut out by expressions: a second Python function would take a second worker for every task.
    def left(x: Column) -> Column:
        first = lambda i: F.coalesce(F.get(F.get(x["spans"], i - 1), F.lit(1)), F.lit(0))
        last = lambda i: F.coalesce(F.get(F.get(x["spans"], i), F.lit(0)), F.octet_length(x["raw"]))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["spans"])), lambda i: F.substring(x["raw"], first(i) + 1, last(i) - first(i)).cast("string")), "")

    one = F.array(F.struct(F.col(text).cast("binary").alias("raw"), F.col("__spans").alias("spans")))
    rest = F.when(F.size("__spans") > 0, F.transform(one, left)[0]).otherwise(F.col(text))
    keep = F.col("__n_hit") <= max_coverage * F.col("__n_words")
    return out.where(keep).select(*[rest.alias(c) if c == text else F.col(c) for c in docs.columns])


def digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(ids)), 256)
