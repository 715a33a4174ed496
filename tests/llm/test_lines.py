"""Line removal against plain sets."""

import random
import time

from loanforge.llm.lines import remove_boilerplate


def brute(rows, least):
    sites = {}
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).update({s} - {None})
    out = []
    for k, t, s, e in rows:
        if t is not None:
            ls = t.split("\n")
            kept = [x for x in ls if len(sites.get(x.strip(" "), ())) < least]
            if len(kept) < len(ls) and any(x.strip(" ") for x in kept):
                out.append((k, "\n".join(kept), s, e, len(ls), len(ls) - len(kept)))
                continue
        out.append((k, t, s, e, 0 if t is None else len(t.split("\n")), 0))
    return sorted(out, key=str)


def test_against_plain_sets(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta  ", " beta", "gamma é", "", "  ", "delta", "the long common line of all"]
    rows = [(i, "\n".join(rnd.choice([*words, f"own {i} {rnd.random()}"]) for _ in range(rnd.randint(0, 9))), rnd.choice(["a", "b", "c", "d", "e", None]), i % 3) for i in range(120)]
    rows += [(500, None, "a", 0), (501, "", "b", 0), (None, "alpha\nnull key line here", "a", 1), (None, "delta\nother null key line", "b", 1), (7, "alpha\nx" * 3, "c", 2), (502, "alpha\n" + "long line " * 50_000, "a", 0)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint")
    for least in (4, 5, 2):
        got = remove_boilerplate(df, min_sites=least, lg_k=4, counts=True).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, least)
    assert remove_boilerplate(df.limit(0)).count() == 0


def test_page_of_mostly_boilerplate_loses_it(spark):
    common = [f"common line {i} that every site shows" for i in range(8)]
    rows = [(i, "\n".join([*common, f"own {i}"]), f"site{i}") for i in range(12)] + [(50, "\n".join(common), "copy")]
    df = spark.createDataFrame(rows, "k int, at string, line string").toDF("row", "t", "gone")  # names that the operator uses itself
    out = {r.row: r.t for r in remove_boilerplate(df, key="row", text="t", site="gone").collect()}
    assert out == {i: f"own {i}" for i in range(12)} | {50: "\n".join(common)}


def test_one_text_of_200_000_lines(spark):
    lines = [f"line {i % 1000}" if i % 2 else f"own {i}" for i in range(200_000)]
    rows = [(0, "\n".join(lines), "s0")] + [(i, "\n".join(f"line {j}" for j in range(1000)) + f"\nmine {i}", f"s{i}") for i in range(1, 11)]
    begin = time.time()
    out = {r.doc_id: r for r in remove_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string"), counts=True).collect()}
    assert time.time() - begin < 60
    assert out[0].text == "\n".join(lines[::2])
    assert (out[0].n_lines, out[0].n_removed) == (200_000, 100_000)
