"""Byte-level BPE: same ids as the public library, exact appends, edits and round trips."""

import random

import public_tokenizers as P
import pytest
import tiktoken

from loanforge.llm import bpe
from loanforge.llm.queries import REG, RANKS

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def strings(n, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        yield "".join(rnd.choice("abcde  01²9\n\t'éß漢🙂ñ.,-\x1c\xa0") if rnd.random() < 0.6 else rnd.choice(["ing", "tion", "'re", "ou"]) for _ in range(rnd.randint(0, 60)))


def test_ids_equal_the_library(vocab, library):
    codec = bpe.Codec(vocab, P.PATTERN)
    for s in [*strings(1500), "", " " * 5000, "a" * 3000, "1" * 3000, "ab\r\n \n"]:
        ids = codec.encode(s)
        assert ids == library.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()
    assert codec.encode(None) == []


def test_appends_and_edits_equal_a_fresh_table(vocab):
    rnd = random.Random(2)
    for s in strings(400, 3):
        b = s.encode() * 3
        i = rnd.randint(0, len(b))
        j = rnd.randint(i, len(b))
        new = bytes(rnd.choices(b"abtheion ", k=rnd.randint(0, 4)))
        assert bpe.PrefixTable(vocab, b[:i]).append(b[i:]).last == bpe.PrefixTable(vocab, b).last
        t = bpe.PrefixTable(vocab, b)
        t.edit(i, j, new)
        assert t.last == bpe.PrefixTable(vocab, b[:i] + new + b[j:]).last


def test_an_edit_touches_few_prefixes(vocab):
    t = bpe.PrefixTable(vocab, b"the thing and the other thing " * 500)
    assert t.edit(7000, 7001, b"x") < 200


def test_frames(spark, library):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", None), (None, "naïve 漢字\n", "z"), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode(df, PATH, P.PATTERN)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in out.collect()))
    assert got == sorted((a or 0, library.encode_ordinary(t or "")) for a, t, _ in rows)
    back = sorted((r.doc_id or 0, bytes(r.decoded)) for r in bpe.decode(out, PATH, P.PATTERN).collect())
    assert back == sorted((a or 0, (t or "").encode()) for a, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN, digests=True).count() == 0


def test_query(spark, sf, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = REG.queries["op4_byte_bpe"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
