"""Tables of few rows take few tasks and files, however many partitions the session shuffles into."""

import random
from pathlib import Path

import pytest

from loanforge.llm import near
from test_near import brute, got
from test_near_components import least_reachable, links
from test_near_dense import dense_group, frame

MANY = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """Name and part files of every written table."""
    made, real = [], near.stored

    def counted(df, name, *args, **more):
        out = real(df, name, *args, **more)
        made.append((name, len(list(Path(out._stored_at.removeprefix("file://")).glob("part-*")))))
        return out

    monkeypatch.setattr(near, "stored", counted)
    return made


@pytest.mark.parametrize("rows, most", [(50_000, 1), (100, 5)])
def test_edges_take_the_tasks_of_their_rows(spark, many_partitions, files, monkeypatch, rows, most):
    monkeypatch.setattr(near, "TASK_ROWS", rows)
    edges = links(random.Random(9))
    assert len(edges) <= rows * most
    out = near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in out} == least_reachable(edges)
    assert len(files) > 2 and max(n for _, n in files) <= most


@pytest.mark.parametrize("rows", [50_000, 60])
def test_groups_and_cells_in_one_task_or_several(spark, many_partitions, files, monkeypatch, rows):
    monkeypatch.setattr(near, "TASK_ROWS", rows)
    data, df = frame(spark, dense_group(random.Random(10), 120, 40))
    assert got(near.components_of(df)) == brute(data)
    if rows == 50_000:
        of = ("nodes", "cells", "edges", "groups", "members", "dense", "large")
        assert max(n for name, n in files if name in of) == 1


def test_only_large_nodes_are_asked_for_pivots(spark, monkeypatch):
    plans, real = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df, *args, **more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *args, **more))
    schema = "tree int, node bigint, id bigint, n bigint, s1 bigint, s2 bigint, comp bigint"
    row = lambda node, i: (0, node, i, 9, i * 7, i * 11, i)
    small = [row(node, 10 * node + i) for node in range(1, 20) for i in range(3)] + [row(50, 900), row(51, 901)]
    out = near._nodes(spark.createDataFrame(small, schema), 1, 1).collect()
    assert len(out) == 57 and all(r.few and r.pivots is None and r.size == 3 for r in out)
    assert plans and not any("xxhash64" in p for p in plans)
    size = near.SMALL + 30
    df = spark.createDataFrame(small + [row(99, 1000 + i) for i in range(size)], schema)
    out = near._nodes(df, 1, 1).collect()
    large = [r for r in out if r.node == 99]
    assert len(out) == 57 + size and len(large) == size and all(r.pivots is None for r in out if r.node != 99)
    hashed = df.where("node = 99").select("id", *[near.F.xxhash64(near.F.lit(near.PIVOTS + j), "node", "id").alias(f"h{j}") for j in range(near.PIVOTS)]).collect()
    want = [min((r[f"h{j}"], r.id) for r in hashed)[1] for j in range(near.PIVOTS)]
    assert all([p.id for p in r.pivots] == want and r.size == size and not r.few for r in large)
