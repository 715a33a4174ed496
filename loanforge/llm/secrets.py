"""Secret scan: fixed patterns and credential formats learned by grammar inference.

Credentials that the fixed patterns find are labelled strings. Per kind, a prefix
tree of their character classes is built and its states are merged wherever their
outgoing frequencies agree within a Hoeffding bound; the result is a probabilistic
automaton. Every other token that could be a credential (``least`` or more characters of
the credential alphabet, as many as a labelled string has at least) is scored by its likelihood per
character under each automaton and becomes a span when it is as likely as the
labelled strings held back for calibration.

Learning uses at most ``sample`` distinct labelled strings per kind, those of lowest
hash, of at most ``LONGEST`` characters; scanning covers every whole text in one
narrow pass and finds token runs by array operations. A token is scored once for all its
places in a batch of texts, and a score ends where no rest of the token could lift it to
its limit. Labels are sought by the fixed patterns only in texts that hold their words.

Results: a null text is empty; without enough labelled strings only the fixed
patterns apply; spans are code points, end exclusive, sorted by start, then kind;
repeated rows get repeated results; columns not in ``keep`` are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.llm.common import joined_bytes, slices, stored

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
SAMPLE = 400
LONGEST = 256
LEAST = 6
ALPHA = 0.05
ENOUGH = 10

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")

#: Every text with a span of ASSIGN holds one of these when its ASCII letters are small.
LABELS = (b"passw", b"secret", b"token", b"api")
#: Tokens of at most ``MEMO_LENGTH`` characters whose verdict a task keeps from batch to batch.
MEMO, MEMO_LENGTH = 200_000, 64

_LOW = bytes(range(256)).lower()
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def base_spans(text: str, runs: bool = True, label: bool = True) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, credential)`` of the fixed patterns; ``runs``: whether long hex or key runs are there, ``label``: whether words of LABELS are."""
    out = []
    if label and ("=" in text or ":" in text):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    if runs:
        out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_CLASS = {**dict.fromkeys(range(0x30, 0x3A), "d"), **{o: ("h" if o < 0x67 else "l") for o in range(0x61, 0x7B)}, **{o: ("H" if o < 0x47 else "U") for o in range(0x41, 0x5B)}}


def symbols(s: str) -> str:
    """Character classes: digits, letters to f and beyond in either case, other characters as they are."""
    if s.isascii():
        return s.translate(_CLASS)
    return "".join("d" if c.isdigit() else ("h" if c <= "f" else "l") if c.islower() else ("H" if c <= "F" else "U") if c.isupper() else c for c in s)


class Automaton:
    """Probabilistic automaton learned by state merging."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.to.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                at = self.to[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in {*self.to[a], *self.to[b]}:
                if self._differ(self.seen[a].get(c, 0), self.visits[a], self.seen[b].get(c, 0), self.visits[b]):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to what is reached from ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.to[a]:
                    todo.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def _merge(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(r, c, q) for r in red for c, q in sorted(self.to[r].items()) if q not in known]
            if not blue:
                break
            r, c, q = max(blue, key=lambda x: self.visits[x[2]])
            for p in red:
                if self._compatible(p, q):
                    self.to[r][c] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
                known.add(q)
        self.red = red

    def score(self, s: str) -> float:
        """Log-likelihood per symbol, the end included."""
        at, total = 0, 0.0
        for c in s:
            if at is None or c not in self.to[at]:
                at, p = None, 1e-4
            else:
                p, at = self.seen[at][c] / (self.visits[at] + 1), self.to[at][c]
            total += math.log(p)
        total += math.log((self.ends[at] + 0.1) / (self.visits[at] + 1)) if at is not None else math.log(1e-4)
        return total / (len(s) + 1)

    def steps(self) -> tuple[list[dict[str, tuple[float, int]]], list[float]]:
        """Per state the log-likelihood and next state of each symbol, and the log-likelihood of the end."""
        step = [{c: (math.log(seen[c] / (n + 1)), q) for c, q in to.items()} for to, seen, n in zip(self.to, self.seen, self.visits)]
        return step, [math.log((e + 0.1) / (n + 1)) for e, n in zip(self.ends, self.visits)]


@dataclass
class Formats:
    """Automata by kind, each with the lowest score it accepts."""

    automata: dict[str, tuple[Automaton, float]]

    def best(self, token: str) -> float | None:
        """Highest margin over an automaton's limit; None when no automaton accepts."""
        s = symbols(token)
        margins = [a.score(s) - limit for a, limit in self.automata.values()]
        return max((m for m in margins if m >= 0), default=None)

    def accepting(self) -> Callable[[str], bool]:
        """Whether ``best`` of a token is not None, from tables of steps; a sum that has fallen below the limit ends the score, as it only falls."""
        tables = [(*a.steps(), limit) for a, limit in self.automata.values()]
        unknown = math.log(1e-4)

        def accepts(token: str) -> bool:
            s = symbols(token)
            size = len(s) + 1
            for step, end, limit in tables:
                at, total, least = 0, 0.0, limit * size - 1e-6
                for i, c in enumerate(s):
                    if c not in step[at]:
                        for _ in range(size - i):  # no state from here on, and none at the end
                            total += unknown
                            if total < least:
                                break
                        break
                    p, at = step[at][c]
                    total += p
                    if total < least:
                        break
                else:
                    total += end[at]
                if total >= least and total / size - limit >= 0:
                    return True
            return False

        return accepts


def learn(credentials: dict[str, list[str]]) -> Formats:
    """Automata of labelled strings; every third string is held back to set the limit."""
    out = {}
    for kind, strings in sorted(credentials.items()):
        if len(strings) >= ENOUGH:
            a = Automaton([symbols(s) for i, s in enumerate(strings) if i % 3])
            scores = sorted(a.score(symbols(s)) for s in strings[::3])
            out[kind] = (a, scores[len(scores) // 20])
    return Formats(out)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of a byte mask within one text, at least ``least`` long."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(mask))])
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    ok = b - a >= least
    return a[ok], b[ok]


def _in_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a hex run and rows with a word of LABELS; start, end and row of token runs."""
    a, b = _runs(_TOKEN_BYTE[raw], offsets, LEAST)
    row = np.searchsorted(offsets, a, side="right") - 1
    hexed = np.zeros(len(offsets) - 1, bool)
    long = b - a >= 24
    for i, j, r in zip(a[long], b[long], row[long]):
        if not hexed[r]:
            hexed[r] = bool(HEX.search(raw[i:j].tobytes().decode("ascii")))
    label = np.zeros(len(offsets) - 1, bool)
    low = raw.tobytes().translate(_LOW)
    for word in LABELS:
        at = low.find(word)
        while at >= 0:
            r = int(np.searchsorted(offsets, at, side="right")) - 1
            label[r] = True
            at = low.find(word, int(offsets[r + 1]))
    return hexed, label, a, b, row


def _tokens(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.DictionaryArray:
    """The runs ``a`` to ``b`` of the bytes as strings, each distinct one once."""
    size = np.concatenate(([0], np.cumsum(b - a)))
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[a] += 1
    inside[b] -= 1
    held = raw[np.cumsum(inside, dtype=np.int8)[:-1].view(bool)]
    strings = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(held))
    return strings.dictionary_encode()


def found_in(texts: pa.Array, accepts: Callable[[str], bool] | None, known: dict[str, bool]) -> list[list[tuple[str, int, int]]]:
    """``spans_of`` each text; ``known`` remembers verdicts from call to call."""
    raw, offsets = joined_bytes(texts)
    hexed, label, a, b, row = _in_rows(raw, offsets)
    base = [base_spans(t, h, w) if t else [] for t, h, w in zip(texts.to_pylist(), hexed, label)]
    out = [[s[:3] for s in spans] for spans in base]
    if accepts is None or not len(a):
        return out
    tokens = _tokens(raw, a, b)
    verdict = np.zeros(len(tokens.dictionary), bool)
    for i, t in enumerate(tokens.dictionary.to_pylist()):
        ok = known.get(t)
        if ok is None:
            ok = accepts(t)
            if len(t) <= MEMO_LENGTH:
                if len(known) >= MEMO:
                    known.clear()
                known[t] = ok
        verdict[i] = ok
    taken = verdict[tokens.indices.to_numpy()]
    a, b, row = a[taken], b[taken], row[taken]
    # Code points: bytes that go on with a character don't count, and tokens have none.
    more = np.concatenate(([0], np.cumsum((raw & 0xC0) == 0x80, dtype=np.int32)))
    start = a - offsets[row] - (more[a] - more[offsets[row]])
    order, mixed = (*KINDS, LEARNED), set()
    for r, x, y in zip(row.tolist(), start.tolist(), (start + b - a).tolist()):
        if not any(s[1] < y and x < s[2] for s in base[r]):
            out[r].append((LEARNED, x, y))
            if base[r]:
                mixed.add(r)
    for r in mixed:
        out[r].sort(key=lambda s: (s[1], order.index(s[0])))
    return out


def credentials(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every credential of the fixed patterns: ``kind``, ``value``."""
    src = docs.select(F.col(text).alias("t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 0):
            hexed, label, *_ = _in_rows(*joined_bytes(b.column(0)))
            found = [(k, v) for t, h, w in zip(b.column(0).to_pylist(), hexed, label) if t for k, _, _, v in base_spans(t, h, w)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return src.mapInArrow(run, "kind string, value string")


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Formats:
    """Learn formats from the credentials that the fixed patterns find in ``docs``."""
    distinct = stored(credentials(docs, text).where(F.length("value") <= LONGEST).distinct(), "credentials")
    picked = {k: [r["value"] for r in distinct.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()] for k in KINDS}
    return learn(picked)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def spans_of(text: str, formats: Formats, hexed: bool = True, token: bool = True, known: dict[str, bool] | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text; ``known`` remembers which tokens an automaton accepts."""
    known = {} if known is None else known
    base = base_spans(text, hexed)
    out = [s[:3] for s in base]
    if token and formats.automata:
        for m in TOKEN.finditer(text):
            t = m[0]
            if t not in known:
                known[t] = formats.best(t) is not None
            if known[t] and not any(s[1] < m.end() and m.start() < s[2] for s in base):
                out.append((LEARNED, *m.span()))
    order = (*KINDS, LEARNED)
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def mask(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, formats: Formats, text: str = "text", keep: Sequence[str] = ("doc_id",), masked: bool = False) -> DataFrame:
    """``keep`` columns, ``secrets`` (kind, start, stop) and, if wanted, the ``masked`` text."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    src = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    at = len(keep)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("secrets", SPANS), *[T.StructField("masked", T.StringType())] * masked])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts, known = shared.value.accepting() if shared.value.automata else None, {}
        for b in slices(it, at):
            found = found_in(b.column(at), accepts, known)
            spans = [s for f in found for s in f]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
            parts = [pa.array([s[i] for s in spans], x.type) for i, x in enumerate(kind.value_type)]
            cols = [*b.columns[:at], pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))]
            if masked:
                cols.append(pa.array([t and mask(t, f) for t, f in zip(b.column(at).to_pylist(), found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
