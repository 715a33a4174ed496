"""Near-duplicate components against all pairs."""

import random
import re

from loanforge.llm import near


def brute(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    label[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted(((k, len(s), None if k is None else least[top(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def got(frame):
    out = frame.collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"x{rnd.random()}"
    return w


def test_against_all_pairs(spark):
    rnd = random.Random(1)
    new = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    passage, hot = new(60), new(150)
    docs = []
    for _ in range(25):  # chains of edits around the limit
        base = new(rnd.randint(6, 120))
        for _ in range(rnd.randint(1, 4)):
            docs.append(base)
            base = edited(rnd, base, rnd.randint(0, 3))
    docs += [edited(rnd, hot, rnd.randint(0, 2)) for _ in range(90)]  # more than a small node holds
    docs += [new(rnd.randint(10, 40)) + passage for _ in range(90)]  # share a passage only
    docs += [["a"], ["A"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    rnd.shuffle(docs)
    rows = [(i * 3 % 997, "\t ".join(w)) for i, w in enumerate(docs)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "a"), (None, "q"), rows[0], (2003, "long text here now " * 40_000), (2004, "LONG text\x0bhere now " * 39_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, component_id int")
    assert got(near.components_of(df)) == brute(rows)
    assert near.components_of(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    out = {r.id: r.component for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {x: out.get(x, x) for x in label} == label
