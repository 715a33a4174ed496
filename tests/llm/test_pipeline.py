"""The pipeline against plain code, stage after stage."""

import importlib.util
import pathlib
import re

import corpus_pipeline
import public_tokenizers as P
import tiktoken

from loanforge.llm import bpe, language
from loanforge.llm.decontaminate import words_of
from loanforge.llm.queries import RANKS


def helper(name):
    spec = importlib.util.spec_from_file_location(f"plain_{name}", pathlib.Path(__file__).parent / f"test_{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.brute


def without_windows(text, items):
    """Text without hit words and what is between neighbouring ones; None when most words are hit."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    words, hit = words_of(text), [False] * len(at)
    for x in items:
        k = min(10, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for j in range(len(words) - k + 1 if k else 0):
            if tuple(words[j : j + k]) in windows:
                hit[j : j + k] = [True] * k
    if sum(hit) > 0.8 * len(hit):
        return None
    out, last = [], 0
    for i, (a, b) in enumerate(at):
        if hit[i]:
            if not (i and hit[i - 1]):
                out.append(raw[last:a])
            last = b
    return b"".join([*out, raw[last:]]).decode()


def test_run_equals_plain_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = language.identify(docs, language.fit(docs)).collect()
    rows = [(r.doc_id, r.text, r.source, 0) for r in judged if not r.rejected]
    rows = [r[:2] for r in helper("lines")(rows, 10)]
    keep = {k for k, _, c in helper("near")(rows) if k == c}
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {k: without_windows(t, items) for k, t in rows if k in keep}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(RANKS)), special_tokens={})
    want = {k: library.encode_ordinary(t) for k, t in want.items() if t is not None}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "Some text of the en kind", "en", "s", 24), (9003, "and the of " * 20_000, "en", "s", 1)], docs.schema)
    for table in (docs.limit(30).unionByName(odd).unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert name == "tokens" or out.columns == docs.columns
            out.collect()
