"""Decontamination against windows compared one by one."""

import random

from loanforge.llm.decontaminate import Items, contamination, decontaminate, words_of


def brute(text, items, window):
    w, hit, ids = words_of(text), set(), set()
    for item, t in items:
        x = words_of(t)
        k = min(window, len(x))
        for i in range(len(x) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit.update(range(j, j + k))
                    if item is not None:
                        ids.add(item)
    return len(w), len(hit), sorted(ids)


def sample(rnd, n):
    return " ".join(rnd.choice(["a", "B", "c,", "é", "Dd\n", "9"]) for _ in range(n))


def test_automaton_holds_exactly_the_substrings():
    rnd = random.Random(1)
    items = [(str(k), words_of(sample(rnd, rnd.randint(1, 12)))) for k in range(6)]
    auto = Items(items, 3)
    for _ in range(300):
        w = words_of(sample(rnd, 8))
        got = {(a, z, k) for a, z, held in auto.matches(w) for k in held}
        want = {(j, j + m, k) for k, (_, x) in enumerate(items) for m in [min(3, len(x))] for i in range(len(x) - m + 1) for j in range(len(w) - m + 1) if w[j : j + m] == x[i : i + m]}
        assert got == want


def test_against_brute_force(spark):
    rnd = random.Random(2)
    for window, low in ((4, 4), (4, 1), (3, 2)):
        items = [(str(k), sample(rnd, rnd.randint(low, 9))) for k in range(8)] + [("0", sample(rnd, 5)), (None, sample(rnd, 6)), ("x", None), ("y", " ,.")]
        docs = [(k, sample(rnd, rnd.randint(0, 40)), "e") for k in range(60)] + [(90, None, "e"), (91, "", None), (None, sample(rnd, 30), "e"), (5, sample(rnd, 20), "e")]
        d = spark.createDataFrame(docs, "doc_id bigint, text string, spans string")
        b = spark.createDataFrame(items, "item_id string, text string")
        want = sorted((k or -1, *brute(t, items, window)) for k, t, _ in docs)
        for block in (1000, 12):
            got = contamination(d, b, window=window, block_words=block).collect()
            assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in got) == want


def test_removal_and_empty_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Start, {passage.upper()}! end of it", 1), (2, passage, 2), (3, None, 3), (4, "clean words " * 9, 4)], "doc_id bigint, text string, n_hit int")
    b = spark.createDataFrame([(1, passage)], "item_id int, text string")
    out = {r.doc_id: r for r in decontaminate(d, b).collect()}
    assert out[1].text == "Start, ! end of it" and out[1].n_hit == 1
    assert set(out) == {1, 3, 4} and out[4].text == "clean words " * 9
    assert decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}
    long = "filler " * 100_000 + passage
    assert contamination(spark.createDataFrame([(1, long)], "doc_id int, text string"), b).first().n_hit == 11


def test_removal_takes_one_python_worker_a_task(spark):
    d = spark.createDataFrame([(1, "Ünd one two, three ß one two three", "e"), (2, "\u4e00 x one Two  three\n", None)], "doc_id bigint, text string, lang string")
    b = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    out = decontaminate(d, b, max_coverage=1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "Ünd  ß ", "e"), (2, "\u4e00 x \n", None)]
