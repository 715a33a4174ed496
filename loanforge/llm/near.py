"""Near-duplicate documents by a chosen-path set similarity join, and their components.

A document's set is its distinct ``SHINGLE``-word strings. Equal sets become one
representative first. Each of ``TREES`` independent trees deals representatives to nodes
by a minwise token, so two sets stay together with the probability of their
similarity. A node of at most ``SMALL`` sets is compared exhaustively; in a larger node
all sets are compared with a few of them, the pivots, and the node branches again by one
further token per set and, for one token in three, a second: 4/3 branches keep a pair at the
limit together in one node a level on average while nodes of less similar sets fall apart. Sketches of 128 bits drop pairs that are six standard deviations
below the limit; what remains is confirmed on full sets.

Pairs already in one component need no comparing. So ``ROUNDS`` rounds first ask each set
only for its most similar one in another component, which joins groups by a number of
pairs that grows with the sets; after that all pairs across the components that then stand
are compared: a node of one component is done, a small node proposes its pairs.

Dense nodes propose no pairs. Nodes that share sets, over all trees, are one group, and
the full sets of a group are compared block by block: a cell holds two blocks, counts all
intersections and returns the components that links join, at most one row per set. The
largest component fills blocks of its own, which do not meet each other. A set travels once
per block of sets outside that component, at most ``JOINT_BLOCKS`` times; of a group with more
of them, each node is a group of its own up to ``NODE_BLOCKS``, and larger nodes branch.

A pair at similarity 0.75 misses all 20 trees with probability below 1e-11 where nodes
are small at once or in groups compared as a whole, below 1e-4 through four branchings of larger nodes, and below 2e-3 through eight;
pivots and the components that stand by then make up for most of that.

Results: keys are whole numbers; documents without words or with null text have no set and stand alone; fewer
words than a shingle are one shingle; rows without key stand alone with a null component;
repeated rows share a component and are kept alike; other columns are left out of
``components_of``; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.llm.common import discard, joined_bytes, slices, stored, word_table

SHINGLE = 5
PERCENT = 75
TREES = 20
SMALL = 64
TOKENS = 128
#: Equal sketch bits, of 128, that a pair must have: 112 are expected at similarity 0.75, with deviation 3.7.
LIKE = 90
#: One token in so many opens a second branch: 4/3 branches a set keep a pair at similarity 0.75 together in one node a level on average.
SECOND = 3
MAX_LEVELS = 24
#: Members of a block of documents whose pairs are confirmed together.
CELL = 64
#: Rows of a node that one task compares with the others.
SHARE = 512
#: Sets and shingles of a block whose full sets are compared with those of another; blocks outside the largest component up to which a group, and a node alone, is compared in full.
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 18
JOINT_BLOCKS = 32
NODE_BLOCKS = 2
#: Rows of edges, pairs or members of nodes that one task takes at most: these tables have the tasks and files that their
#: rows need, where a shuffle has as many as the session says.
TASK_ROWS = 50_000
#: Shingles that a cell counts at once.
COLUMNS = 4096
#: Sets of a large node that all others are compared with, and rounds in which every set looks for its most similar one.
PIVOTS = 6
ROUNDS = 3

_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_R = np.random.default_rng(5)
_WORD = _R.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_HASH = _R.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_FLIP = _R.integers(1, 2**63, TOKENS, dtype=np.uint64)
#: Which tokens a tree uses, level by level; every tree starts with another one.
_ORDER = [[t, *(int(x) for x in np.random.default_rng(100 + t).permutation(TOKENS) if x != t)] for t in range(TREES)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw, offsets = joined_bytes(texts)
    _, _, h, row = word_table(_LOW[raw], _INSIDE[raw], offsets)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    word = _mix(h)
    n = max(len(word) - SHINGLE + 1, 0)
    full = _mix(reduce(np.add, (word[k : k + n] * _WORD[k] for k in range(SHINGLE)))) if n else word[:0]
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            yield np.unique(full[a : b - SHINGLE + 1])
        elif b > a:
            yield _mix((word[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield word[:0]


def _measures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, set size ``n``, 128-bit digest of the set, minwise tokens and their low bits as a sketch."""
    src = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1):
            n, a, d, tokens, bits = [], [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                a.append(int(_mix(s).sum()))
                d.append(int(_mix(s ^ _FLIP[0]).sum()))
                least = np.full(TOKENS, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 4096):
                    part = s[i : i + 4096, None]
                    least = np.minimum(least, (part * _HASH + ((part >> np.uint64(32)) * _FLIP)).min(axis=0))
                least = _mix(least)
                tokens.append(least.astype(np.uint32).tobytes())
                bits.append(np.packbits((least >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64))
            big = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64) if v else np.zeros(0, np.int64))
            bits = np.array(bits).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), big(a), big(d), pa.array(tokens, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["id", "n", "d1", "d2", "tokens", "s1", "s2"])

    return src.mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, tokens binary, s1 bigint, s2 bigint")


def _equal_bits(a: Column, b: Column) -> Column:
    return 128 - F.bit_count(a["s1"].bitwiseXOR(b["s1"])) - F.bit_count(a["s2"].bitwiseXOR(b["s2"]))


def _token(which: Column) -> Column:
    """Token number ``which`` of the packed tokens."""
    return F.substring(F.col("tokens"), which * 4 + 1, F.lit(4))


def _dealt(rows: DataFrame, level: int, keep: list[str]) -> DataFrame:
    """``rows`` at their nodes of the next level: one node per tree at first, below each large node one more and, for one token in ``SECOND``, a second."""
    order = F.array(*[F.array(*[F.lit(x) for x in o]) for o in _ORDER])
    if level == 0:
        each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, _token(order[t][0])).alias("node"))))
    else:
        at = lambda j: F.col("order")[F.pmod(F.lit(2 * level - 1 + j), F.lit(TOKENS))]
        rows = rows.withColumn("order", order[F.col("tree")])
        child = [F.struct(F.col("tree"), F.xxhash64("node", F.lit(j), _token(at(j))).alias("node")) for j in (0, 1)]
        # Who shares the second child shares its hash, and so decides alike.
        each = F.explode(F.when(F.pmod(F.xxhash64(child[1]["node"], F.lit(3)), F.lit(SECOND)) == 0, F.array(*child)).otherwise(F.array(child[0])))
    return rows.select(each.alias("e"), *keep).select("e.tree", "e.node", *keep)


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


_ROW = ["id", "n", "s1", "s2", "comp"]


def _nodes(rows: DataFrame, seed: int, tasks: int) -> DataFrame:
    """``rows`` of nodes that hold more than one component, with what a node decides by, and the pivots of large ones; ``seed`` picks those."""

    def least(j: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(seed * PIVOTS + j), "node", "id").alias("h"), *_ROW)).alias(f"p{j}")

    parts = rows.groupBy("tree", "node", "comp").agg(F.count("*").alias("rows"), F.min("id").alias("head")).coalesce(tasks)
    nodes = parts.groupBy("tree", "node").agg(F.sum("rows").alias("size"), F.count("*").alias("parts"), F.max(F.struct("rows", "comp")).alias("top"), F.min("head").alias("head"))
    nodes = nodes.where("parts > 1").select("tree", "node", "size", "top", "head").coalesce(tasks)
    both = rows.join(nodes, ["tree", "node"]).withColumn("few", F.col("size") - F.col("top.rows") <= SMALL)
    open_ = stored(both.select("tree", "node", *_ROW, "size", "top", "head", "few").coalesce(tasks), "open", drop_shuffle=True)
    # Pivots are six rows for each row of a node until the last shuffle: only large nodes, which use them, are asked.
    large = open_.where(~F.col("few"))
    some = _tasks(rows_of := large.count())
    pivots = large.groupBy("tree", "node").agg(*[least(j) for j in range(PIVOTS)]).select("tree", "node", F.array(*[f"p{j}" for j in range(PIVOTS)]).alias("pivots")).coalesce(some)
    out = open_.where("few").withColumn("pivots", F.lit(None).cast(pivots.schema["pivots"].dataType))
    if rows_of == 0:
        out._stored_at = open_._stored_at
        return out
    out = stored(out.unionByName(large.join(pivots, ["tree", "node"])).coalesce(tasks), "nodes", drop_shuffle=True)
    discard(open_)
    return out


def _met(nodes: DataFrame, percent: int) -> DataFrame:
    """``x`` with the sets of other components that look ``like`` it: small nodes in full; where one component holds nearly all, the others against all; large nodes with their pivots.

    Sets with the same ``met``, where there is such a column, have been compared elsewhere.
    """
    row = [*_ROW, "met"] if "met" in nodes.columns else _ROW
    few = nodes.where("few")
    parts = F.ceil(F.col("size") / SHARE).cast("int")  # a node of many rows is dealt to several tasks, the few others go to each
    some = few.where((F.col("size") <= SMALL) | (F.col("comp") != F.col("top.comp"))).groupBy("tree", "node").agg(F.collect_list(F.struct(*row)).alias("others"), F.first(parts).alias("parts"))
    some = some.select("tree", "node", "others", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = few.select("tree", "node", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.struct(*row).alias("x")).join(some, ["tree", "node", "part"]).select("x", "others")
    star = nodes.where(~F.col("few")).select(F.struct(*row).alias("x"), F.transform("pivots", lambda p: F.struct(*[(p[c] if c in _ROW else F.lit(None).cast("bigint")).alias(c) for c in row])).alias("others"))
    x = F.col("x")
    size = lambda y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    apart = lambda y: F.coalesce(y["met"] != x["met"], F.lit(True)) if "met" in row else F.lit(True)
    like = F.filter("others", lambda y: (y["comp"] != x["comp"]) & (y["id"] != x["id"]) & apart(y) & size(y) & (_equal_bits(x, y) >= LIKE))
    return met.unionByName(star).select("x", like.alias("like"))


def best_pairs(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each set with the most similar one of another component that its nodes offer: at most one pair per set."""
    best = F.aggregate(
        "like", F.lit(None).cast("struct<bits:bigint,y:bigint>"),
        lambda m, y: F.greatest(m, F.struct(_equal_bits(F.col("x"), y).cast("bigint").alias("bits"), (-y["id"]).alias("y"))),
    )
    each = _met(nodes, percent).select(F.col("x.id").alias("id"), best.alias("m")).where("m is not null").groupBy("id").agg(F.max("m").alias("m"))
    return each.select(F.least("id", -F.col("m.y")).alias("a"), F.greatest("id", -F.col("m.y")).alias("b")).distinct()


def all_pairs(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair of different components that the nodes propose."""
    pairs = _met(nodes, percent).select("x.id", F.explode("like").alias("y"))
    return pairs.select(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")).distinct()


def _in_cells(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """``pairs`` with the cell where each is confirmed: ``rep``, ``p``, ``q``.

    Pairs that hang together by a common least neighbour share a ``rep``. Where that has many members they are
    dealt into blocks, and a cell holds the pairs between two blocks; so the members of a dense group travel once per
    pair of blocks and not once per pair.
    """
    tasks = tasks or _tasks(pairs.count())
    end = lambda x, o: F.struct(F.col(x).alias("x"), F.col(o).alias("o"))
    ends = pairs.coalesce(tasks).select("a", "b", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("a", "b", F.least(F.min("e.o").over(Window.partitionBy("e.x")), "e.x").alias("m"))
    named = ends.coalesce(tasks).groupBy("a", "b").agg(F.min("m").alias("rep")).coalesce(tasks)
    members = named.select("rep", F.explode(F.array("a", "b")).alias("id")).groupBy("rep").agg(F.ceil(F.approx_count_distinct("id") / CELL).cast("int").alias("blocks")).coalesce(tasks)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    return named.join(members, "rep").select("a", "b", "rep", F.least(block("a"), block("b")).alias("p"), F.greatest(block("a"), block("b")).alias("q")).coalesce(tasks)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets (``id``, ``set``) have ``100 * intersection >= percent * union``."""
    cell = ["rep", "p", "q"]
    tasks = _tasks(pairs.count())
    dealt = stored(_in_cells(pairs.select("a", "b"), tasks), "cells", drop_shuffle=True)
    held = dealt.coalesce(tasks).select(*cell, F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "set"), "id")

    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        of = {i: np.frombuffer(s.as_py(), np.uint64) for i, s in zip(held.column("id").to_pylist(), held.column("set"))}
        ok = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
            p, q = of.get(a), of.get(b)
            if p is None or q is None or min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                ok.append(False)
                continue
            small, big = (p, q) if len(p) < len(q) else (q, p)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            same = int((big[at] == small).sum())
            ok.append(100 * same >= percent * (len(p) + len(q) - same))
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = held.select(*[F.col(c).alias(f"of_{c}") for c in cell], "id", "set")
    return dealt.groupBy(*cell).cogroup(held.groupBy(*held.columns[:3])).applyInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and the smallest id of its component, for every id of an edge, by alternating large and small stars.

    A star is a window over the neighbours of an id, so an iteration shuffles the edges twice; every edge gives one edge.
    Edges that one task takes are not shuffled.
    """
    tasks = _tasks(edges.count())
    least = F.min("v").over(Window.partitionBy("u"))
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").coalesce(tasks).distinct().withColumn("moved", F.lit(True)).coalesce(tasks), "edges", drop_shuffle=True)
    while True:
        both = e.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = both.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved")).coalesce(tasks)
        low = (large if tasks == 1 else large.repartition("u")).groupBy("u", "v").agg(F.max("moved").alias("moved")).withColumn("m", least)
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") > F.col("m"))).alias("moved"))
        before, e = e, stored(small.coalesce(tasks), "edges", drop_shuffle=True)
        discard(before)
        if e.where("moved").isEmpty():
            out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._stored_at = e._stored_at
            return out


def _sized(members: DataFrame, tasks: int) -> DataFrame:
    """Per group (``tree``, ``node``) its ``main``, the largest component, and the blocks of it (``mains``) and of the other sets (``others``)."""
    parts = members.groupBy("tree", "node", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).coalesce(tasks)
    sums = parts.groupBy("tree", "node").agg(F.max(F.struct("rows", "comp", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n")).coalesce(tasks)
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK_SETS, n / BLOCK_SHINGLES)).cast("int")
    rest = F.col("rows") - F.col("top.rows")
    return sums.select("tree", "node", F.col("top.comp").alias("main"), rest.alias("rest"), blocks(rest, F.col("n") - F.col("top.n")).alias("others"), blocks(F.col("top.rows"), F.col("top.n")).alias("mains"))


def _groups(dense: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """The sets (``id``, ``comp``) of the groups to compare in full, with their blocks, and the rows of nodes that are too large for that.

    A group of several nodes has tree -1. ``every``: no group is too large.
    """
    tasks = _tasks(dense.count())
    joint = components(dense.select(F.col("id").alias("a"), F.col("head").alias("b")))
    dense = dense.join(joint.withColumnRenamed("component", "joint"), "id", "left").withColumn("joint", F.coalesce("joint", "id"))
    dense = stored(dense.coalesce(tasks), "dense", drop_shuffle=True)
    discard(joint)
    whole = dense.select(F.lit(-1).alias("tree"), F.col("joint").alias("node"), "id", "comp", "n").coalesce(tasks).distinct().coalesce(tasks)
    fits = _sized(whole, tasks)
    if not every:
        fits = fits.where(F.col("others") <= JOINT_BLOCKS)
    fits = stored(fits, "groups", drop_shuffle=True)
    rest = dense.join(fits.select(F.col("node").alias("joint")), "joint", "left_anti").coalesce(tasks)
    alone = stored(_sized(rest, tasks).where((F.col("others") <= NODE_BLOCKS) | (F.col("rest") <= SMALL)), "groups", drop_shuffle=True)
    members = whole.unionByName(rest.select(*whole.columns)).drop("n").coalesce(tasks).distinct().coalesce(tasks).join(fits.unionByName(alone), ["tree", "node"]).coalesce(tasks)
    large = rest.join(alone.select("tree", "node"), ["tree", "node"], "left_anti").drop("joint").coalesce(tasks)
    members, large = stored(members, "members", drop_shuffle=True), stored(large, "large", drop_shuffle=True)
    discard(dense, fits, alone)
    return members, large


def joined(groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of ``groups`` (``a``, ``b``) that hang together by links on full sets (``id``, ``set``): cells of two blocks are compared in full."""
    cell = ["tree", "node", "p", "q"]
    main = F.col("comp") == F.col("main")
    hashed = F.xxhash64("id")
    block = F.when(main, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    # A block of the main component meets the others only.
    with_ = F.sequence(F.lit(0), F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rows = groups.withColumn("block", block).select("tree", "node", "id", "comp", "block", F.explode(with_).alias("with"))
    rows = rows.select("tree", "node", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "id", "comp", "block")

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        of = [np.frombuffer(s.as_py(), np.uint64) for s in held.column("set")]
        n = np.array([len(s) for s in of])
        comp, block = held.column("comp").to_numpy(), held.column("block").to_numpy()
        left, right = np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py())
        word, owner = np.unique(np.concatenate(of), return_inverse=True)[1], np.repeat(np.arange(len(of)), n)
        both = np.zeros((len(left), len(right)))
        sides = []
        for side in (left, right):
            place = np.full(len(of), -1)
            place[side] = np.arange(len(side))
            here = place[owner] >= 0
            sides.append((word[here], place[owner[here]], len(side)))
        shared = np.zeros(len(word) + 1, bool)
        shared[np.intersect1d(sides[0][0], sides[1][0])] = True
        if key[2] == key[3]:  # what only one set holds is in no intersection of two
            shared[: len(word)] &= np.bincount(word, minlength=len(word)) > 1
        column = np.cumsum(shared) - 1
        last = int(shared.sum())
        sides = [(column[w[shared[w]]], r[shared[w]], k) for w, r, k in sides]
        sides = [(c[o], r[o], k) for c, r, k in sides for o in (np.argsort(c, kind="stable"),)]
        for i in range(0, last, COLUMNS):
            parts = []
            for c, r, k in sides:
                a, b = np.searchsorted(c, (i, i + COLUMNS))
                part = np.zeros((k, min(COLUMNS, last - i)), np.float32)
                part[r[a:b], c[a:b] - i] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        link = (100 * both >= percent * (n[left][:, None] + n[right] - both)) & (comp[left][:, None] != comp[right])
        x, y, none = comp[left], comp[right], np.iinfo(np.int64).max
        while True:
            least_x = np.minimum(x, np.where(link, y, none).min(axis=1, initial=none))
            least_y = np.minimum(y, np.where(link, least_x[:, None], none).min(axis=0, initial=none))
            if (least_x == x).all() and (least_y == y).all():
                break
            x, y = least_x, least_y
        edges = np.unique(np.stack([np.concatenate([comp[left], comp[right]]), np.concatenate([x, y])], axis=1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return rows.join(sets.select("id", "set"), "id").groupBy(*cell).applyInArrow(run, "a bigint, b bigint")


def _labelled(rows: DataFrame, label: DataFrame | None, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column`` so far."""
    rows = rows.drop(name, "size", "top", "head", "pivots", "few") if name in rows.columns else rows
    if label is None:
        return rows.withColumn(name, F.col(column))
    of = label.select(F.col("id").alias(column), F.col("component").alias("__c"))
    return rows.join(of, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: the key, ``n_shingles``, ``component_id`` and whether the row is the one ``kept``."""
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    rows = stored(_measures(docs, key, text), "sets")
    reps = rows.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "tokens", "s1", "s2")).alias("r"))
    reps = stored(reps.select("n", "d1", "d2", "r.*"), "representatives", drop_shuffle=True)
    label: DataFrame | None = None

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], names=["id", "set"])

    def full_sets(ids: DataFrame) -> DataFrame:
        held = texts.hint("merge").join(ids.distinct(), "id", "left_semi").mapInArrow(pack, "id bigint, set binary")
        return stored(held, "full-sets", drop_shuffle=True)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    def grown(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
        """Components with those that ``links`` join."""
        links = stored(links, "links", drop_shuffle=True)
        old = [links] if label is None else [links, label]
        if links.isEmpty():
            discard(links)
            return label
        label = components(links if label is None else links.unionByName(label.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        discard(*old)
        return label

    own = ["id", "n", "s1", "s2"]
    rows_at, sets = stored(_dealt(reps, 0, own), "dealt"), None
    before = rows_at
    for r in range(ROUNDS):
        tasks = _tasks(rows_at.count())
        nodes = _nodes(_labelled(rows_at, label, "id", "comp"), r, tasks)
        pairs = stored(best_pairs(nodes, percent).coalesce(tasks), "pairs", drop_shuffle=True)
        # Components only grow: a node of one component is done, so later rounds read what this one found.
        discard(before)
        rows_at = before = nodes
        if pairs.isEmpty():
            break
        sets = full_sets(ends(pairs)) if sets is None else sets  # later rounds take the pairs whose sets are there; the last comparison takes all
        label = grown(label, linked(pairs, sets, percent))
        discard(pairs)
    for level in range(1, MAX_LEVELS + 1):
        tasks = _tasks(rows_at.count())
        nodes = _nodes(_labelled(rows_at, label, "id", "comp"), ROUNDS + level, tasks)
        small, dense, large = nodes.where(F.col("size") <= SMALL), nodes.where(F.col("size") > SMALL), None
        dense = None if dense.isEmpty() else dense
        if dense is not None:
            groups, large = _groups(dense, level == MAX_LEVELS)
            # All sets of a joint group are compared, whatever their nodes.
            met = groups.where("tree = -1").select("id", F.col("node").alias("met")).distinct()
            small = small.join(met, "id", "left").unionByName(large.withColumn("met", F.lit(None).cast("bigint")))
        pairs = stored(all_pairs(small, percent).coalesce(tasks), "pairs", drop_shuffle=True)
        found, ids = [], []
        if not pairs.isEmpty():
            found.append(lambda sets: linked(pairs, sets, percent))
            ids.append(ends(pairs))
        if dense is not None:
            found.append(lambda sets: joined(groups, sets, percent))
            ids.append(groups.select("id"))
        if found:
            discard(*([] if sets is None else [sets]))
            sets = full_sets(reduce(DataFrame.unionByName, ids))
            label = grown(label, reduce(DataFrame.unionByName, [links(sets) for links in found]))
        discard(pairs, *([] if dense is None else [groups]))
        if large is None or large.isEmpty():
            break
        # Tokens are fetched once per set, whatever the number of its nodes.
        places = large.groupBy("id").agg(F.collect_list(F.struct("tree", "node")).alias("places"))
        at = places.join(reps.select(*own, "tokens"), "id").select(*own, "tokens", F.explode("places").alias("p")).select("p.*", *own, "tokens")
        rows_at = stored(_dealt(at, level, own), "dealt", drop_shuffle=True)
        discard(nodes, before, large)
        before = rows_at
    group = _labelled(reps.select("id", "n", "d1", "d2"), label, "id", "component").select("n", "d1", "d2", "component")
    out = rows.where("n > 0 and id is not null").join(group, ["n", "d1", "d2"]).select("id", "n", "component")
    out = out.unionByName(rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component; rows of equal key stay or go together, rows without key stay."""
    gone = components_of(docs, key, text, percent).groupBy(key).agg(F.max("kept").alias("__kept")).where(~F.col("__kept"))
    return docs.join(gone.select(key), key, "left_anti").select(*docs.columns)
