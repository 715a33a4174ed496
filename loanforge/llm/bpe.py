"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string every prefix has exactly one token that can end its BPE
encoding. ``PrefixTable`` stores that token per prefix: the encoding is read
backwards from the end, appends go on from the last prefix, and after an edit
only the prefixes near it are computed again.

A candidate token may follow the last token of the prefix before it when the two
would stay apart if both were merged from bytes in rank order (``Vocabulary.apart``).

Results: a null text is empty; an empty text has no ids; text of any length works,
the table is as long as one match of the split pattern. Repeated rows give repeated
results. Extra columns are left out of the result unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.llm.common import HELD, slices

#: Bytes of the memos of a Python worker: encodings of matches; pairs of tokens, and tokens of word starts. They start
#: anew when full, and are freed when the worker turns to another operator.
MEMO = 80 << 20
SIDE_MEMO = 48 << 20
#: Bytes of an entry beside its text and ids.
ENTRY = 160
MEMO_BYTES = 64
#: Last tokens of prefixes up to this long are shared by all words that start so.
TAIL_BYTES = 12

_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Texts of these characters alone can be split by the standard library, three times as fast, with the same matches.
LATIN = re.compile(f"[\t-\r -~{_LETTERS[6:]}]*")
LATIN_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{_LETTERS}]+|[0-9]+|[^\s0-9{_LETTERS}]+)|\s+(?!\S)|\s+")


class Vocabulary:
    """Ranks of byte strings, how each token splits into the two it was merged from, and the inverse."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"no rank for bytes {missing[:5]}")
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.mergeable = {bytes([i]): ranks[bytes([i])] for i in range(256)}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                ends = self._last_merge(token)
                if ends:
                    self.parts[rank] = ends
                    self.pair[ends] = rank
                    self.mergeable[token] = rank
        self.longest = max(map(len, self.mergeable))
        self.known: dict[int, bool] = {}
        self.tails: dict[bytes, int] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None when rank order never gets there."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            best = min((self.pair.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                return None
            ids[best[1] : best[1] + 2] = [best[0]]
        return (ids[0], ids[1])

    def apart(self, left: int, right: int) -> bool:
        """``stay_apart``, remembered for pairs that come again."""
        key = left << 32 | right
        out = self.known.get(key)
        if out is None:
            if len(self.known) * ENTRY >= SIDE_MEMO:
                self.known.clear()
            out = self.known[key] = self.stay_apart(left, right)
        return out

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how their joined bytes are encoded.

        Merges are undone from the latest on; at the seam no pair may exist that
        would have been merged before the merge just undone.
        """
        before = 1 << 60
        while True:
            if self.pair.get((left, right), before) < before:
                return False
            # The side made later is undone first; a byte has no parts and was there from the start.
            a, b = (left if left in self.parts else -1), (right if right in self.parts else -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[a][1]
            else:
                # Equal ranks: the left one was made first, so a merge of that very rank at the seam comes too late on its right only.
                before, right = b + 1, self.parts[b][0]


class PrefixTable:
    """``last[i]`` is the token that ends the encoding of the first ``i`` bytes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"") -> None:
        self.vocab, self.data, self.last = vocab, b"", [-1]
        self.append(data)

    def _token(self, data: bytes, end: int, last: list[int]) -> int:
        v = self.vocab
        prefix = data[:end] if end <= TAIL_BYTES else None
        if prefix is not None and (t := v.tails.get(prefix)) is not None:
            return t
        get, known = v.mergeable.get, v.known.get
        for start in range(max(0, end - v.longest), end):
            t = get(data[start:end])
            if t is None:
                continue
            if start:
                ok = known(last[start] << 32 | t)
                if not (v.apart(last[start], t) if ok is None else ok):
                    continue
            if prefix is not None:
                if len(v.tails) * ENTRY >= SIDE_MEMO:
                    v.tails.clear()
                v.tails[prefix] = t
            return t
        raise AssertionError("a single byte always ends a prefix")

    def append(self, more: bytes) -> PrefixTable:
        data = self.data + more
        for end in range(len(self.data) + 1, len(data) + 1):
            self.last.append(self._token(data, end, self.last))
        self.data = data
        return self

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start:stop``; returns how many prefixes were computed again.

        A prefix depends on the ``longest`` bytes and entries before it, so once that
        many entries in a row after the edit are as they were, all later ones are.
        """
        data = self.data[:start] + new + self.data[stop:]
        old, shift = self.last, len(new) - (stop - start)
        last, same, end = old[: start + 1], 0, start + 1
        while end <= len(data) and same < self.vocab.longest:
            last.append(self._token(data, end, last))
            same = same + 1 if end > start + len(new) and last[end] == old[end - shift] else 0
            end += 1
        self.last, self.data = last + old[end - shift :] if end <= len(data) else last, data
        return end - start - 1

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.vocab.bytes_of[t])
        return out[::-1]


class Codec(dict):
    """Encodes and decodes whole texts; itself the memo from a match of the pattern to its ids."""

    def __init__(self, vocab: Vocabulary, pattern: str) -> None:
        super().__init__()
        self.vocab, self.split = vocab, regex.compile(pattern).findall
        self.latin = pattern == public_tokenizers.PATTERN
        self.digits = {i: str(i) for i in vocab.bytes_of}
        self.held = 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.vocab.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(PrefixTable(self.vocab, raw).ids())
        if len(raw) <= MEMO_BYTES:
            self.held += ENTRY + len(raw) + 8 * len(ids)
            if self.held >= MEMO:
                self.forget()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Frees the memos; the vocabulary stays."""
        self.held = 0
        for memo in (self, self.vocab.known, self.vocab.tails):
            memo.clear()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = LATIN_SPLIT.findall(text) if self.latin and LATIN.fullmatch(text) else self.split(text)
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def ids_digest(self, ids: Sequence[int]) -> str:
        return hashlib.sha256(",".join(map(self.digits.__getitem__, ids)).encode()).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The worker's codec of the latest vocabulary."""
    name, vocab = shared.value
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(vocab, pattern)
    HELD["bpe"] = _forget
    return _CODECS[name]


def _forget() -> None:
    """Frees the codecs with their memos; the vocabulary comes again with the broadcast."""
    for codec in _CODECS.values():
        codec.forget()
    _CODECS.clear()


def _sliced(fn: Callable[[Codec, pa.RecordBatch], pa.RecordBatch], shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function that hands slices of the last column's bytes to ``fn`` with the task's codec."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for b in it:
            for part in slices(iter([b]), b.num_columns - 1, operator="bpe"):
                yield fn(codec, part)

    return run


def _share(spark: SparkSession, path: str, pattern: str):
    """The vocabulary travels once per executor; its size is that of the rank file."""
    return spark.sparkContext.broadcast((f"{path}\n{pattern}", Vocabulary(read_ranks(path))))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and, as wanted, ``ids`` and the SHA-256 of the ids and of the bytes they decode to."""
    shared = _share(docs.sparkSession, path, pattern)
    src = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    fields = [*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests

    def run(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        lists, n, a, d = [], [], [], []
        for t in b.column(b.num_columns - 1).to_pylist():
            x = codec.encode(t)
            n.append(len(x))
            if ids:
                lists.append(x)
            if digests:
                a.append(codec.ids_digest(x))
                d.append(hashlib.sha256(codec.decode(x)).hexdigest())
        cols = [*b.columns[:-1], pa.array(n, pa.int64())] + [pa.array(lists, pa.list_(pa.int32()))] * ids
        cols += [pa.array(a, pa.string()), pa.array(d, pa.string())] if digests else []
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return src.mapInArrow(_sliced(run, shared, pattern), T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes of the ids; null ids are none."""
    shared = _share(encoded.sparkSession, path, pattern)
    src = encoded.select(*[F.col(c) for c in keep], F.col(ids).cast("array<int>").alias("__ids"))
    fields = [*src.schema.fields[:-1], T.StructField("decoded", T.BinaryType())]

    def run(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        out = [codec.decode(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[f.name for f in fields])

    return src.mapInArrow(_sliced(run, shared, pattern), T.StructType(fields))
