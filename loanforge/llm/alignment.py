"""Alignment of two tokenizers' tokens by byte ranges, composed from fragments.

Tokenizer A is a byte-level BPE file, B a BPE model of pieces that adds a space; both read
space+text. Where tokens of both end, a group ends. A *fragment* is what a range of bytes
knows alone: an open prefix before its first common end, closed groups, and an open suffix
after its last one. ``compose`` of two neighbours closes what becomes known; it is
associative, so the fragments of a very long document, one per ``chunk_bytes``, are made
by different tasks and reduced by a tree of ``FAN`` a node.

A range begins for A at the next place where A's tokens can't cross (before a word, between
a letter and a digit), for B at the next place where B's can't (before a word), so each
tokenizer sees whole words and its tokens are those of the whole text. A text without
such places stays one range.

Words are closed fragments at both ends. So a batch of shorter documents tokenizes and
aligns each different word once and adds up per document, which is written with a bag of
its links.

Corpus counts: every batch adds up its links per id pair, Spark the batches; the bags of a
batch then meet the counts of the batch's own pairs by a join, as no bound on the number of
pairs of a corpus is small enough for a broadcast. What travels with tasks are the two vocabulary files.

Results: texts that are null or empty, or whose tokens' bytes differ from space+text (such
as those with U+2581), have no tokens: counts are 0 and groups ''. Repeated rows count
as often as they stand there; columns not in ``keep`` are left out; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.llm.common import HELD, slices, stored

CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
FAN = 8
#: Words tokenized in one call.
CALL = 2000

#: Before a word: a space that no space precedes and a visible character follows (a first byte of no Unicode blank).
_WORD = rb"(?<=[^ ])(?= [!-~\xc3-\xdf\xe0\xe4-\xf4])"
WORD = re.compile(_WORD)
#: Where A's split pattern always cuts.
A_CUT = re.compile(_WORD + rb"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: As WORD, on characters.
_TEXT_WORD = re.compile("(?<=[^ ])(?= [!-~\xc0-\u167f\u1681-\u180d\u180f-\u1fff\u2070-\u2fff\u3001-\U0010ffff])")
_NONE = np.zeros(0, np.int64)


def ranges(raw: bytes, size: int) -> list[tuple[int, int]]:
    """First bytes for A and for B of every range of about ``size`` bytes; ``raw`` is space+text."""
    out, at = [(0, 0)], size
    while (b := WORD.search(raw, at)) is not None:
        out.append((A_CUT.search(raw, at).start(), b.start()))
        at = b.start() + size
    return out


class Tokenizers:
    """Both vocabularies, each with the bytes of its tokens.

    A's file must hold a byte-level BPE whose merges come in the order of their ids; its ids then are
    ranks, by which the faster of the two libraries encodes alike.
    """

    def __init__(self, a: str, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(a)
        entries = model["model"]["vocab"]
        # Byte-level entries write bytes that are no visible Latin-1 character as code points from 256 on, in order.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        added = {x["id"] for x in model.get("added_tokens", ())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in entries.items() if i not in added}
        merged = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged) or model.get("normalizer") or (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("no byte-level BPE with merges in the order of ids")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.a_bytes[i] = x
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

    def ids_a(self, words: Sequence[str]) -> np.ndarray:
        """Ids of the words one after another; each starts at a cut of A."""
        calls = ("".join(words[i : i + CALL]) for i in range(0, len(words), CALL))
        return np.fromiter(chain.from_iterable(map(self.a.encode_ordinary, calls)), np.int64)

    def ids_b(self, words: Sequence[str]) -> np.ndarray:
        """Ids of the words one after another; each starts with the space that B adds."""
        calls = (words[i : i + CALL] for i in range(0, len(words), CALL))
        return np.fromiter(chain.from_iterable(x for c in calls for x in self.b.encode([w[1:] for w in c], num_threads=1)), np.int64)


@dataclass
class Tokens:
    """Tokens of both vocabularies with the bytes at which they end."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_end: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_end: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, o: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.parts(), o.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def within(self, after: int, to: int) -> Tokens:
        """Tokens that end after byte ``after`` and by byte ``to``; both are common ends."""
        i, j = np.searchsorted(self.a_end, [after, to], side="right")
        k, m = np.searchsorted(self.b_end, [after, to], side="right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def common(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Last byte of every stretch between neighbouring ends, and the id pair that covers it."""
        ends = np.union1d(self.a_end, self.b_end)
        return ends, self.a[np.searchsorted(self.a_end, ends)] << 32 | self.b[np.searchsorted(self.b_end, ends)]

    def groups(self) -> list[str]:
        """``a1,a2|b1`` of each group; the tokens start and end at common ends."""
        ends = self.common()
        i, j = (np.searchsorted(e, ends, side="right") for e in (self.a_end, self.b_end))
        p, q = np.r_[0, i[:-1]], np.r_[0, j[:-1]]
        single = (i - p == 1) & (j - q == 1)
        out = np.empty(len(ends), object)
        out[single] = [f"{x}|{y}" for x, y in zip(self.a[p[single]].tolist(), self.b[q[single]].tolist())]
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        more = ~single
        out[more] = [f"{','.join(a[x:y])}|{','.join(b[z:w])}" for x, y, z, w in zip(*(v[more].tolist() for v in (p, i, q, j)))]
        return out.tolist()


@dataclass
class Fragment:
    """Tokens of a byte range: ``prefix`` up to its first common end, closed groups, ``suffix``; without a common end all is prefix."""

    prefix: Tokens
    joined: bool = False
    closed: str = ""
    n_groups: int = 0
    suffix: Tokens = field(default_factory=Tokens)
    #: Pairs linked in groups that were closed by composing.
    seams: np.ndarray = field(default_factory=lambda: _NONE)


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens]:
    """The fragment of a range's tokens, and the tokens of its closed groups."""
    ends = tokens.common()
    if not len(ends):
        return Fragment(tokens), Tokens()
    inner = tokens.within(ends[0], ends[-1])
    last = 1 << 62
    return Fragment(tokens.within(-1, ends[0]), True, ";".join(inner.groups()), len(ends) - 1, tokens.within(ends[-1], last)), inner


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    seam, inner = fragment((f.suffix if f.joined else f.prefix) + g.prefix)
    if f.joined and seam.joined:  # what came before starts at a common end: its first group closes as well
        inner = seam.prefix + inner
        seam = Fragment(Tokens(), True, ";".join(inner.groups()), seam.n_groups + 1, seam.suffix)
    pairs = np.concatenate([f.seams, inner.links()[1], g.seams])
    if not f.joined and not seam.joined:
        return Fragment(seam.prefix, seams=pairs)
    suffix = g.suffix if g.joined else seam.suffix if seam.joined else seam.prefix
    closed = ";".join(x for x in (f.closed, seam.closed if seam.joined else "", g.closed) if x)
    return Fragment(f.prefix if f.joined else seam.prefix, True, closed, f.n_groups + seam.n_groups * seam.joined + g.n_groups, suffix, pairs)


def finish(f: Fragment) -> Fragment:
    """The fragment of a whole text with its first group closed."""
    return compose(Fragment(Tokens(), True), f)


@dataclass
class Words:
    """Different words, each aligned once; a word whose tokens' bytes differ from it has no links."""

    bad: np.ndarray
    #: Per word: tokens of A, of B, groups, links.
    counts: np.ndarray
    #: Id pairs that occur, and which of them each link of each word is, word after word.
    names: np.ndarray
    links: np.ndarray
    text: list[str]


def align_words(tok: Tokenizers, words: list[str]) -> Words:
    bad = np.zeros(len(words), bool)
    sides = [(tok.ids_a(words), tok.a_size, tok.a_bytes), (tok.ids_b(words), tok.b_size, tok.b_bytes)]
    raw = "".join(words).encode()
    if any(b"".join(map(names.__getitem__, ids.tolist())) != raw for ids, _, names in sides):
        bad[:] = [any(b"".join(map(names.__getitem__, ids.tolist())) != w.encode() for ids, names in ((tok.ids_a([w]), tok.a_bytes), (tok.ids_b([w]), tok.b_bytes))) for w in words]
        good = [w for w, x in zip(words, bad) if not x]
        sides = [(tok.ids_a(good), tok.a_size, tok.a_bytes), (tok.ids_b(good), tok.b_size, tok.b_bytes)]
    size = np.where(bad, 0, np.array([len(w) if w.isascii() else len(w.encode()) for w in words], np.int64))
    word_end = np.cumsum(size)
    t = Tokens(sides[0][0], np.cumsum(tok.a_size[sides[0][0]]), sides[1][0], np.cumsum(tok.b_size[sides[1][0]]))
    ends, pairs = t.links()
    common = t.common()
    of = lambda e: np.searchsorted(word_end, e)
    n = len(words)
    counts = np.stack([np.bincount(of(e), minlength=n) for e in (t.a_end, t.b_end, common, ends)], axis=1)
    groups, text, at = t.groups(), [], 0
    for k in counts[:, 2].tolist():
        text.append(groups[at] if k == 1 else ";".join(groups[at : at + k]))
        at += k
    names, links = np.unique(pairs, return_inverse=True)
    return Words(bad, counts, names, links, text)


def words_of(text: str) -> list[str]:
    """Words of space+text."""
    return _TEXT_WORD.split(text)


def chunk_tokens(tok: Tokenizers, text: str, offset: int, b_from: int, a_to: int) -> Tokens | None:
    """Tokens of one range of a long text; None where their bytes differ from it."""
    raw = text.encode()
    a_raw, b_raw = raw[:a_to], raw[b_from:]
    a, b = tok.ids_a(words_of(a_raw.decode())), tok.ids_b(words_of(b_raw.decode()))
    if b"".join(map(tok.a_bytes.__getitem__, a.tolist())) != a_raw or b"".join(map(tok.b_bytes.__getitem__, b.tolist())) != b_raw:
        return None
    return Tokens(a, offset + np.cumsum(tok.a_size[a]), b, offset + b_from + np.cumsum(tok.b_size[b]))


_HELD: dict[str, Tokenizers] = {}


def _tokenizers(shared) -> Tokenizers:
    """Of this worker; only the latest pair is held."""
    name, a, b = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Tokenizers(a, b)
    HELD["alignment"] = _HELD.clear
    return _HELD[name]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start[i] ... start[i] + size[i] - 1`` of all i, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _bag(place: np.ndarray, n: np.ndarray) -> bytes:
    """Places (rising) and how often each, compressed."""
    return pa.compress(np.diff(place, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), "zstd", asbytes=True) if len(place) else b""


def _unbagged(bag: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(pa.decompress(bag, decompressed_size=8 * size, codec="zstd", asbytes=True), "<u4").astype(np.int64) if size else _NONE
    return np.cumsum(v[:size]), v[size:]


_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _pairs(names: np.ndarray, n: np.ndarray) -> pa.Array:
    """One list of id pairs with numbers."""
    items = pa.StructArray.from_arrays([pa.array((names >> 32).astype(np.int32)), pa.array((names & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], fields=list(_PAIR))
    return pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), items)


#: What one pass writes. Kind 0: a shorter text, done but for the counts, with its links as a bag of places in its batch's pairs.
#: Kind 1: the pairs of a batch. Kind 2: a range of a long text, still to be read.
_UNIT = "kind int, row bigint, no int, chunks int, batch bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, size int, bag binary, pairs array<struct<a:int,b:int,n:bigint>>, at bigint, b_from bigint, a_to bigint, text string"
_UNIT_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int32(), pa.binary(), pa.list_(_PAIR), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def units(docs: DataFrame, shared, text: str, keep: Sequence[str], groups: bool, digests: bool, chunk_bytes: int, batch_bytes: int) -> DataFrame:
    """The written rows of the first pass, with ``keep`` as ``k0``, ``k1`` ..."""
    src = docs.select(*[F.col(c) for c in keep], F.monotonically_increasing_id().alias("__row"), F.col(text).cast("string").alias("__text"))
    k = len(keep)
    fields = T._parse_datatype_string(_UNIT).fields
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(src.schema.fields[:k])] + fields)
    names = [f.name for f in fields]

    def rows(kept: list[pa.Array], n: int, **values: object) -> pa.RecordBatch:
        cols = [v if isinstance(v := values.get(x), (pa.Array, pa.ChunkedArray)) else pa.array(v if v is not None else [None] * n, t) for x, t in zip(names, _UNIT_TYPES)]
        return pa.RecordBatch.from_arrays([*kept, *cols], names=schema.names)

    def batch(tok: Tokenizers, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(k)]
        row = [x for p in parts for x in p.column(k).to_pylist()]
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        at = [np.fromiter(map(index.__getitem__, words_of(f" {t}") if t else ()), np.int32) for p in parts for t in p.column(k + 1).to_pylist()]
        w = align_words(tok, list(index))
        start = np.cumsum(w.counts[:, 3]) - w.counts[:, 3]
        total = np.zeros(len(w.names), np.int64)
        n, text_of, sizes, bags = [], [], [], []
        for x in at:
            if not len(x) or w.bad[x].any():
                x = x[:0]
            n.append(w.counts[x].sum(axis=0))
            text_of.append(";".join(map(w.text.__getitem__, x.tolist())))
            place, times = np.unique(w.links[_ragged(start[x], w.counts[x, 3])], return_counts=True)
            total[place] += times
            sizes.append(len(place))
            bags.append(_bag(place, times))
        m = len(row)
        n_a, n_b, n_groups, n_links = np.array(n, np.int64).reshape(m, 4).T
        yield rows(
            kept, m, kind=[0] * m, row=row, no=[0] * m, chunks=[1] * m, batch=[row[0]] * m, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links,
            groups=text_of if groups else None, groups_sha256=list(map(_digest, text_of)) if digests else None, size=sizes, bag=bags,
        )
        yield rows([pa.nulls(1, c.type) for c in kept], 1, kind=[1], row=[row[0]], no=[0], chunks=[1], batch=[row[0]], pairs=_pairs(w.names, total))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(shared)
        held, size = [], 0
        for b in slices(it, k + 1, operator="alignment"):
            long = pc.greater_equal(pc.fill_null(pc.binary_length(b.column(k + 1)), 0), chunk_bytes)
            for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
                raw = b" " + b.column(k + 1)[i].as_py().encode()
                cuts = [*ranges(raw, chunk_bytes), (len(raw), len(raw))]
                m = len(cuts) - 1
                own = [c.take(pa.array([i] * m, pa.int64())) for c in b.columns[: k + 1]]
                spans = list(zip(cuts, cuts[1:]))
                yield rows(own[:k], m, kind=[2] * m, row=own[k], no=list(range(m)), chunks=[m] * m, batch=own[k], at=[a for (a, _), _ in spans], b_from=[c - a for (a, c), _ in spans], a_to=[d - a for (a, _), (d, _) in spans], text=[raw[a:e].decode() for (a, _), (_, e) in spans])
            short = b.filter(pc.invert(long))
            if short.num_rows:
                held.append(short)
                size += short.column(k + 1).nbytes
            if size >= batch_bytes:
                yield from batch(tok, held)
                held, size = [], 0
        if held:
            yield from batch(tok, held)

    return stored(src.mapInArrow(run, schema), "align-units")


#: A fragment as a row; ``size``, ``bag`` and ``pairs`` hold the links of a range's closed groups.
_FRAGMENT = "row bigint, no int, ok boolean, n_a bigint, n_b bigint, joined boolean, closed string, n_groups bigint, " + ", ".join(f"{s}{i} binary" for s in ("p", "s") for i in range(4)) + ", seams binary"


def _packed(row: int, no: int, ok: bool, n: Sequence[int], f: Fragment) -> tuple:
    return (row, no, ok, *n, f.joined, f.closed, f.n_groups, *(x.tobytes() for x in (*f.prefix.parts(), *f.suffix.parts())), f.seams.tobytes())


def _unpacked(r: dict) -> Fragment:
    back = lambda s: Tokens(*(np.frombuffer(r[f"{s}{i}"], np.int64) for i in range(4)))
    return Fragment(back("p"), r["joined"], r["closed"], r["n_groups"], back("s"), np.frombuffer(r["seams"], np.int64))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), *[pa.binary()] * 9]
    names = [x.split()[0] for x in _FRAGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_RANGE = _FRAGMENT + ", size int, bag binary, pairs array<struct<a:int,b:int,n:bigint>>"


def range_fragments(ranges: DataFrame, shared) -> DataFrame:
    """The fragment of every range, dealt to all tasks, with the links of its closed groups."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(shared)
        for b in slices(it, 5, operator="alignment"):
            for row, no, at, b_from, a_to, t in zip(*(c.to_pylist() for c in b.columns)):
                tokens = chunk_tokens(tok, t, at, b_from, a_to)
                f, inner = fragment(tokens or Tokens())
                names, n = np.unique(inner.links()[1], return_counts=True)
                n_own = (len(tokens.a), len(tokens.b)) if tokens else (0, 0)
                own = _as_batch([_packed(row, no, tokens is not None, n_own, f)])
                bag = _bag(np.arange(len(names)), n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([len(names)], pa.int32()), pa.array([bag], pa.binary()), _pairs(names, n)], names=[*own.schema.names, "size", "bag", "pairs"])

    return ranges.select("row", "no", "at", "b_from", "a_to", "text").repartition("row", "no").mapInArrow(run, _RANGE)


def whole_fragments(leaves: DataFrame, most: int) -> DataFrame:
    """One finished fragment per long text: those of its at most ``most`` ranges, reduced by a tree."""

    def node(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["no"])
        f = _unpacked(rows[0])
        for r in rows[1:]:
            f = compose(f, _unpacked(r))
        n = [sum(r[c] for r in rows) for c in ("n_a", "n_b")]
        return pa.Table.from_batches([_as_batch([_packed(rows[0]["row"], rows[0]["no"] // FAN, all(r["ok"] for r in rows), n, f)])])

    def root(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield _as_batch([_packed(r["row"], 0, r["ok"], (r["n_a"], r["n_b"]), finish(_unpacked(r))) for r in b.to_pylist()])

    out = leaves.drop("size", "bag", "pairs")
    while most > 1:
        out = out.groupBy("row", F.floor(F.col("no") / FAN).alias("parent")).applyInArrow(node, _FRAGMENT)
        most = -(-most // FAN)
    return out.mapInArrow(root, _FRAGMENT)


def _seam_pairs(whole: DataFrame) -> DataFrame:
    """``row``, ``a``, ``b``, ``n`` of links in groups that cross ranges."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, n = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row)), pa.array((names >> 32).astype(np.int32)), pa.array((names & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["row", "a", "b", "n"])

    return whole.where("ok").select("row", "seams").mapInArrow(run, "row bigint, a int, b int, n bigint")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: Sequence[str] = ("doc_id",), groups: bool = True, digests: bool = False, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``keep`` columns, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and, as wanted, the ``groups`` text (``a1,a2|b1;a3|b2``) or its digest ``groups_sha256``."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        a, b = a.read(), b.read()
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(a.encode() + b).hexdigest(), a, b))
    k = len(keep)
    held = units(docs, shared, text, keep, groups, digests, chunk_bytes, batch_bytes)
    unit = ["batch", "no", "row", "chunks", *[f"k{i}" for i in range(k)], "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "size", "bag"]
    texts, pairs = held.where("kind = 0").select(unit), held.where("kind = 1").select("batch", "no", "pairs")
    ranges_of = held.where("kind = 2")
    most = ranges_of.agg(F.max("chunks")).first()[0]
    every = pairs.select(F.explode("pairs").alias("p")).select("p.*")
    if most:
        leaves = stored(range_fragments(ranges_of, shared), "align-ranges", drop_shuffle=True)
        whole = stored(whole_fragments(leaves, most), "align-whole", drop_shuffle=True)
        seams = stored(_seam_pairs(whole), "align-seams")
        good = leaves.join(whole.where("ok").select("row"), "row", "left_semi").withColumn("batch", F.col("row"))
        pairs = pairs.unionByName(good.select("batch", "no", "pairs"))
        every = pairs.select(F.explode("pairs").alias("p")).select("p.*").unionByName(seams.select("a", "b", "n"))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in texts.schema.fields}
        texts = texts.unionByName(good.select([F.lit(0).alias("chunks") if c == "chunks" else F.col(c) if c in ("batch", "no", "row", "size", "bag") else missing[c].alias(c) for c in unit]))
    counts = stored(every.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("count")), "align-counts", drop_shuffle=True)
    counts = counts.join(counts.groupBy("b").agg(F.max("count").alias("top")), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    found = pairs.select("batch", "no", F.posexplode("pairs").alias("place", "p")).select("batch", "no", "place", "p.a", "p.b").join(counts, ["a", "b"])
    found = found.select(F.col("batch").alias("of_batch"), F.col("no").alias("of_no"), "place", "count", "best")
    sums = [T.StructField(x, T.LongType()) for x in ("n_best", "count_sum")]
    shown = [c for c in unit if c not in ("batch", "no", "size", "bag")]
    schema = T.StructType([f for f in texts.schema.fields if f.name in shown] + sums)

    def run(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        count, best = (np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64) for _ in range(2))
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        out = []
        for bag, size in zip(rows.column("bag").to_pylist(), rows.column("size").to_pylist()):
            at, n = _unbagged(bag, size)
            out.append((int((n * best[at]).sum()), int((n * count[at]).sum())))
        return pa.table([*(rows.column(c) for c in schema.names[:-2]), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=schema.names)

    done = texts.groupBy("batch", "no").cogroup(found.groupBy("of_batch", "of_no")).applyInArrow(run, schema)
    if most:
        done = stored(done, "align-parts", drop_shuffle=True)
        inside = done.where("chunks = 0").select("row", "n_best", "count_sum")
        across = seams.join(counts, ["a", "b"]).select("row", (F.col("n") * F.col("best").cast("bigint")).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
        total = inside.unionByName(across).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        keys = ranges_of.where("no = 0").select(*[f"k{i}" for i in range(k)], "row", "chunks")
        long = keys.join(whole.withColumnRenamed("closed", "groups"), "row").join(total, "row", "left")
        long = long.withColumns({"groups": F.when(F.col("ok"), F.col("groups")).otherwise(""), "n_links": F.col("n_a") + F.col("n_b") - F.col("n_groups")})  # one link ends at every end
        long = long.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
        zero = lambda x: F.when(F.col("ok"), F.col(x)).otherwise(0).cast("bigint").alias(x)
        done = done.where("chunks = 1").unionByName(long.select([zero(c) if c.startswith("n_") or c == "count_sum" else F.col(c) for c in done.columns]))
    wanted = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *["groups"] * groups, *["groups_sha256"] * digests]
    return done.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(keep)], *wanted)
