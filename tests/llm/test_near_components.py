"""Components of links: few shuffles an iteration, and no table left that nothing reads."""

import random
from pathlib import Path

from loanforge.llm import near
from loanforge.session import checkpoint_dir


def least_reachable(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root if find(x) != x}


def links(rnd):
    """Chains in id order and in any order, hubs of small and of large id, pairs given twice and backwards, loops."""
    chain, mixed = list(range(0, 60)), rnd.sample(range(1_000, 1_060), 60)
    edges = [*zip(chain, chain[1:]), *zip(mixed, mixed[1:])]
    edges += [(2_000, 2_000 + k) for k in range(1, 80)] + [(3_100, 3_000 + k) for k in range(80)]
    edges += [(2_005, 3_007), (-5, 1_030), (7, 7), (9_000, 9_000)]
    edges += [rnd.sample(range(4_000, 4_200), 2) for _ in range(110)]
    edges += [(b, a) for a, b in rnd.sample(edges, 40)]
    return [tuple(e) for e in edges]


def test_components_shuffle_the_edges_twice_an_iteration(spark, monkeypatch):
    edges = links(random.Random(7))
    shuffles, real = [], near.stored

    def counted(df, *args, **more):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return real(df, *args, **more)

    monkeypatch.setattr(near, "stored", counted)
    folder = Path(checkpoint_dir(spark).removeprefix("file://"))
    before = set(folder.glob("llm-edges-*"))
    rows = near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in rows} == least_reachable(edges)
    assert len(rows) == len(least_reachable(edges))
    assert len(shuffles) > 2 and max(shuffles) <= 2
    assert len(set(folder.glob("llm-edges-*")) - before) == 1


def test_components_of_no_links(spark):
    assert near.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_pairs_that_hang_together_share_cells(spark):
    pairs = sorted({tuple(sorted(e)) for e in links(random.Random(8)) if e[0] != e[1]})
    dealt = near._in_cells(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 6
    rows = dealt.collect()
    assert sorted((r["a"], r["b"]) for r in rows) == pairs
    around = {x: min({x} | {a + b - x for a, b in pairs if x in (a, b)}) for e in pairs for x in e}
    assert all(r["rep"] == min(around[r["a"]], around[r["b"]]) and r["p"] <= r["q"] for r in rows)
