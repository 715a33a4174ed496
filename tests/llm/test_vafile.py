"""Vector search against all scores."""

import math
import random

from loanforge.llm.vafile import top_k


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in dict.fromkeys((i, tuple(v)) for i, v in ok if i % 5 == 0):
        s = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in ok if i != q[0] and len(v) == len(q[1]))[:k]
        out += [(q[0], r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def check(spark, rows, k, **blocks):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = top_k(df, df.where("vec_id % 5 = 0"), k, **blocks).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k)


def test_against_all_scores(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)], 0) for i in range(150)]
    check(spark, rows, 7, per_block=40, queries_per_block=9)
    ties = [(i, [round(rnd.gauss(0, 0.02), 2) for _ in range(3)], 0) for i in range(120)] + [(500 + i, [0.5, 0.5, 0.5], 0) for i in range(60)]
    check(spark, ties, 10, per_block=50)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (5, [1.0, None], 1), (10, None, 1), (15, [float("nan"), 1.0], 1), (20, [float("inf"), 1.0], 1), (25, [], 1), (None, [1.0, 1.0], 1), (1, [3.0, -1.0], 1), (2, [1.0], 1), (30, [2.0], 1), (3, [1e6, 1e6], 1), (3, [1e6, 1e6], 1), (35, [3e7, 3e7], 1)]
    check(spark, rows, 3)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    assert top_k(df.limit(0), df.limit(0), 3).count() == 0
