"""Dense groups near the limit: their pairs are compared in cells, and no row is made per pair."""

import random

import pytest

from loanforge.llm import near
from test_near import brute, edited, got


def dense_group(rnd, n, words=60):
    """Edits of one text; the median similarity of two is about 0.63."""
    new = lambda k: [f"w{rnd.randint(0, 5000)}" for _ in range(k)]
    base = new(words)
    docs = [edited(rnd, base, rnd.choice([0, 1, 1, 2, 2, 2, 3])) for _ in range(n)]
    docs += [edited(rnd, d, 1) for d in rnd.sample(docs, n // 10)]
    return docs + [new(rnd.randint(10, 40)) + base[:30] for _ in range(n // 5)] + [new(30) for _ in range(n // 5)]


def frame(spark, docs):
    rows = [(i * 7 % 10_007, " ".join(w)) for i, w in enumerate(docs)]
    rows += [rows[3], (None, rows[5][1]), (20_000, None)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def watch(monkeypatch, name):
    made, real = [], getattr(near, name)

    def counted(*args):
        out = near.stored(real(*args), "counted")
        made.append(out.count())
        return out

    monkeypatch.setattr(near, name, counted)
    return made


def test_a_dense_group_makes_no_row_per_pair(spark, monkeypatch):
    docs = dense_group(random.Random(3), 500)
    rows, df = frame(spark, docs)
    proposed, joined = watch(monkeypatch, "all_pairs"), watch(monkeypatch, "joined")
    assert got(near.components_of(df)) == brute(rows)
    assert sum(proposed) < 4 * len(rows)
    assert 0 < sum(joined) < 4 * len(rows)


@pytest.mark.parametrize("joint, node", [(1, 2), (0, 0)])
def test_blocks_and_branches(spark, monkeypatch, joint, node):
    """Groups of many blocks, nodes by themselves, and nodes that branch until what is left is compared in full."""
    monkeypatch.setattr(near, "BLOCK_SETS", 24)
    monkeypatch.setattr(near, "JOINT_BLOCKS", joint)
    monkeypatch.setattr(near, "NODE_BLOCKS", node)
    monkeypatch.setattr(near, "MAX_LEVELS", 3)
    rows, df = frame(spark, dense_group(random.Random(4), 220))
    joined = watch(monkeypatch, "joined")
    assert got(near.components_of(df)) == brute(rows)
    assert joined
