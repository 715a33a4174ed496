"""Language identification: held-out accuracy, rejection and odd inputs."""

import zlib

import pyarrow as pa

from loanforge.llm import language
from loanforge.llm.queries import REG


def test_counts_equal_a_plain_count():
    texts = ["The Quick", "ÉTÉ  42 é!", "", None, "x"]
    got, n = language.counts(pa.array(texts, pa.string()), 64)
    alone = [language.counts(pa.array([t], pa.string()), 64) for t in texts]
    assert [list(x) for x in got] == [list(a[0]) for a, _ in alone]
    assert n[2] == n[3] == 0 and list(n) == [int(m[0]) for _, m in alone]
    assert (language.counts(pa.array(["ÉTÉ"]), 64)[0] == language.counts(pa.array(["été"]), 64)[0]).all()
    assert (language.counts(pa.array(["a 12 b"]), 64)[0] == language.counts(pa.array(["a !!! b"]), 64)[0]).all()
    assert got[0].sum() == 9 + 8 + 7


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = REG.queries["op5_language_id"](spark, sf).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [docs[r.doc_id].lang == r.lang_pred for r in out if r.held_out and docs[r.doc_id].lang]
    assert sum(held) >= 0.95 * len(held)
    assert sum(r.rejected for r in out) <= 0.02 * len(out)


def test_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !!", None), (4, "the and of " * 50_000, "c"), (4, "the and of " * 50_000, "c"), (None, "漢字 漢字 " * 500, "d")]
    out = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()
    assert [r.lang for r in out] == [r[2] for r in rows]
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in out[:3])
    assert out[3] == out[4] and out[3].lang_pred == "en"
    assert out[5].rejected
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs.limit(5), none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
