"""What Python workers and batches hold at most."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from loanforge.llm import bpe, common, language


def test_language_counts_few_bytes_at_once():
    texts = pa.array([f"Word number {i} of a long text. " * 250 for i in range(600)])
    model = language.Model(["a"], np.zeros(3, int), np.ones((3, language.BUCKETS), np.float32), np.ones(language.BUCKETS, np.float32), np.zeros((1, 32)))
    tracemalloc.start()
    rows = sum(len(model.predict(p.column(0))[0]) for p in common.slices(iter([pa.record_batch([texts], names=["t"])]), 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 600
    assert peak < 50 << 20


def test_language_counts_alike_however_texts_are_cut(monkeypatch):
    texts = pa.array(["one two", " three", None, "", "  Four\xc9 ", "five", " six"] * 20)
    whole = language.counts(texts)
    monkeypatch.setattr(language, "COUNT_BYTES", 9)
    cut = language.counts(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_a_worker_frees_the_codec_when_it_turns_to_another_operator():
    class Shared:
        value = ("bytes", bpe.Vocabulary({bytes([i]): i for i in range(256)}))

    codec = bpe._codec(Shared, public_tokenizers.PATTERN)
    common.working_for("bpe")
    assert bpe._codec(Shared, public_tokenizers.PATTERN) is codec and codec.encode("ab") == [97, 98]
    common.working_for()
    assert not bpe._CODECS and not codec
    assert bpe._codec(Shared, public_tokenizers.PATTERN).encode("ab") == [97, 98]
    common.working_for()


def test_stages_of_texts_lower_the_rows_of_a_batch(spark):
    before = spark.conf.get(common.ARROW_ROWS)
    docs = spark.createDataFrame([(1, "a text of some words", "en", "s", 20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    try:
        for name, held, then in (("language", "10000", "1000"), ("tokens", "0", "1000"), ("tokens", "200", "200")):
            spark.conf.set(common.ARROW_ROWS, held)
            assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 1
            assert spark.conf.get(common.ARROW_ROWS) == then
    finally:
        spark.conf.set(common.ARROW_ROWS, before)
