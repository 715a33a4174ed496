"""Repeat removal against a table of all 50-byte strings."""

import hashlib
import random

from loanforge.llm.queries import REG
from loanforge.llm.repeats import WINDOW, dedup


def brute(rows):
    order = lambda k: 2**63 if k is None else k
    first, out = {}, []
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - WINDOW + 1):
            g = raw[i : i + WINDOW]
            first[g] = min(first.get(g, 2**64), order(k))
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - WINDOW + 1):
            if first[raw[i : i + WINDOW]] < order(k):
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((order(k), len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((2**63 if r[0] is None else r[0], r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in frame.collect())


def test_against_all_strings(spark):
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("ab é\n") for _ in range(n))
    common = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = [(i, text(rnd.randint(0, 60)) + rnd.choice(common) + text(rnd.randint(0, 70)) + rnd.choice(common)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "a" * 300), (104, "a" * 120), (105, "\0" * 130), (106, "\0" * 90), (None, common[4]), (None, common[3] + "z" * 60), (7, text(30) + common[4])]
    rows += [(200, common[4] * 3), (201, common[4]), (201, common[4])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id bigint, text string, kept int")
    want = brute(rows)
    assert got(dedup(df)) == want
    assert got(dedup(df.repartition(5), bucket_bytes=2000, block_bytes=1000)) == want
    assert dedup(df.limit(0)).count() == 0


def test_many_rows_without_key(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    text = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 90)))
    rows = [(None, text() + (passage[rnd.randint(0, 40) :] if rnd.random() < 0.5 else "") + text()) for _ in range(1000)]
    rows += [(64 * i, passage[: rnd.randint(30, 120)] + text()) for i in range(40)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(dedup(df, bucket_bytes=20_000, block_bytes=5_000)) == brute(rows)


def test_an_anchor_in_a_third_of_all_texts(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    common = text(24)
    rows = [(i, text(60) + (common if i % 3 else "") + text(60)) for i in range(600)] + [(700, rows_text) for rows_text in [text(10) + common + text(40)]] + [(701, common * 8), (702, common * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(dedup(df)) == brute(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = REG.queries["op9_repeated_bytes"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)
