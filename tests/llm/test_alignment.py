"""Token alignment against plain code on whole texts, and the fragment algebra."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loanforge.llm.alignment import Fragment, Tokenizers, Tokens, align, compose, finish, fragment
from loanforge.llm.queries import REG

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(PATHS[0])
LIBRARY.encode_special_tokens = True


@pytest.fixture(scope="module")
def tok():
    return Tokenizers(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())


def whole(tok, text):
    """Tokens of both as (id, start, end); None without tokens."""
    if not text:
        return None
    raw, out = (" " + text).encode(), []
    for ids, names in ((LIBRARY.encode(" " + text, add_special_tokens=False).ids, tok.a_bytes), (tok.b.encode(text), tok.b_bytes)):
        if b"".join(names[i] for i in ids) != raw:
            return None
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(names[i])))
            at += len(names[i])
        out.append(side)
    return out


def brute(tok, rows):
    docs = [(k, whole(tok, t)) for k, t in rows]
    links = [[] if d is None else [(x[0], y[0]) for x in d[0] for y in d[1] if x[1] < y[2] and y[1] < x[2]] for _, d in docs]
    count = Counter(p for x in links for p in x)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (k, d), x in zip(docs, links):
        if d is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in d[0]} & {e for _, _, e in d[1]})
        groups = [[",".join(str(i) for i, s, e in side if a <= s and e <= b) for side in d] for a, b in zip([0, *ends], ends)]
        text = ";".join("|".join(g) for g in groups)
        out.append((k, len(d[0]), len(d[1]), len(groups), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), text))
    return sorted(out, key=str)


def texts(rnd, n):
    parts = ["the ", "internationalisation", " don't", "  two", "\n\n", "\t", "42abc7", "naïve", "日本語", "　", "\xa0", "...", "<s>", "<|endoftext|>", "é", "é", "😀", " ", "x", "'s1", "\r\n ", "\x00", "\x1c a", "foo(bar", "1999was"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(n)]


def test_against_plain_code(spark, tok):
    rnd = random.Random(5)
    rows = list(enumerate(texts(rnd, 120)))
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁ b c"), (204, "▁"), (205, "same text here"), (205, "same text here"), (None, "no key 12ab"), (206, "word " * 300 + "end7up 8down"), (207, "z" * 700), (208, "good " * 200 + "▁ bad" + " more" * 100)]
    rows += [(210 + i, t) for i, t in enumerate(["".join(texts(rnd, 12)) for _ in range(6)])]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], "doc_id bigint, text string, row int, chunks string")
    want = brute(tok, rows)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = lambda frame: sorted((tuple(r) for r in frame.select(*cols).collect()), key=str)
    assert got(align(df, *PATHS)) == want
    assert got(align(df.repartition(5), *PATHS, chunk_bytes=100, batch_bytes=500)) == want
    assert got(align(df.repartition(3), *PATHS, chunk_bytes=7, batch_bytes=3000)) == want
    assert align(df.limit(0), *PATHS).count() == 0
    keyed = align(df, *PATHS, keep=("row", "doc_id"), digests=True)
    assert keyed.columns[:2] == ["row", "doc_id"]
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in keyed.collect())


def as_text(f: Fragment):
    return [x.tolist() for x in (*f.prefix.parts(), *f.suffix.parts())], f.joined, f.closed, f.n_groups


def test_fragments_compose_in_any_order():
    """Random token streams, cut at random bytes by where tokens start, in any nesting."""
    rnd = random.Random(9)
    for _ in range(300):
        size = rnd.randint(1, 40)
        side = lambda: np.array(sorted({size, *(rnd.randint(1, size) for _ in range(rnd.randint(0, 12)))}), np.int64)  # noqa: E731, B023
        a, b = side(), side()
        tokens = Tokens(np.arange(len(a)), a, np.arange(len(b)) + 100, b)
        cuts = sorted({0, size, *(rnd.randint(0, size) for _ in range(rnd.randint(0, 5)))})
        start = lambda e: np.r_[0, e[:-1]]
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            i, j = (start(a) >= lo) & (start(a) < hi), (start(b) >= lo) & (start(b) < hi)
            parts.append(fragment(Tokens(tokens.a[i], a[i], tokens.b[j], b[j]))[0])
        left = parts[0]
        for p in parts[1:]:
            left = compose(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = compose(p, right)
        assert as_text(left) == as_text(right)
        done = finish(left)
        assert done.closed.split(";") == tokens.groups()
        assert done.n_groups == len(np.intersect1d(a, b))


def test_ids_of_both_libraries(tok):
    rnd = random.Random(8)
    entries = [x.decode("utf-8", "ignore") for x in tok.a_bytes]
    for _ in range(3000):
        text = " " + "".join(rnd.choices(entries, k=rnd.randint(1, 12)))
        assert tok.a.encode_ordinary(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query(spark, sf, tok):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    out = {r.doc_id: r for r in REG.queries["op12_token_alignment"](spark, sf).collect()}
    for k, n_a, n_b, n_groups, n_links, _, _, groups in brute(tok, rows):
        r = out[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, n_links)
        assert r.groups_sha256 == hashlib.sha256(groups.encode()).hexdigest()
