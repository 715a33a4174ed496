"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into *blocks*, runs of text between block-level tags, each under the
element that holds it. Two costs pull at a block. A logistic model of its shape (length,
links, punctuation, place, neighbours) costs one label or the other; the model is fitted on
the corpus itself, on a bounded sample (``SAMPLE_PAGES``, ``TRAIN_BLOCKS``) of blocks that stand in elements
which say what they hold (``article``, ``nav``, ``footer`` ...). Where a block stands in
such an element, that is a second, larger cost.

Both become capacities to the terminals of a graph. Smoothness edges join neighbouring
blocks, weaker the more tags lie between them, and every block with its element and every
element with its parent, so that what stands close in the page's tree keeps together. Maximum flow
gives the cheapest cut; blocks on the content side are the text. Capacities are whole
numbers. Nodes whose terminal outweighs all their edges are decided first, which no
minimum cut contradicts, and their edges become costs of their neighbours.

Never text: markup, comments, scripts, styles, embedded objects, the head, and controls of
forms. A ``header`` inside an ``article`` is part of it.

Results: a null or empty page gives the empty text; unclosed tags, cut pages and pages without
any known element are read as far as they go; repeated rows give repeated results; a column
of ``keep`` that is named as a result column gives way; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.llm.common import slices

#: Pages and blocks that the model is fitted on, at most.
SAMPLE_PAGES = 4_000
TRAIN_BLOCKS = 20_000
#: Capacities are costs times this, rounded.
UNIT = 1000
#: Cost of a label against what an element says; against what a content-like class name says; limit of the model's cost.
SEED, HINT, MOST = 9.0, 4.0, 4.0
#: Share of a cost that ``main`` may still overrule: some sites wrap the whole page in a form or in an element of a misleading class.
LOOSE = 0.9
#: Smoothness of neighbouring blocks, halved by each tag between them, and along the tree; share of it across elements that say different things.
NEXT, TREE, ACROSS = 1.0, 0.7, 0.1

# HTML elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp"}
NO_TEXT = {"template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "head", "map", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = HEADINGS | {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup",
    "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTENT_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
CONTENT_ROLES = {"main", "article"}
OTHER_ROLES = {"navigation", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "banner"}
# Words of class names and ids.
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "prose", "story"}
OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "discussion", "disqus",
    "footer", "form", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "popup", "promo", "promotion",
    "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
HEADER_WORDS = {"header"}
#: A frame around text and other parts names both, as in has-sidebar or content-sidebar-wrap.
WITH_WORDS = {"has", "with"}
FRAME_WORDS = {"container", "layout", "wrap", "wrapper"}
FRAMED_WORDS = {"content", "main"}
#: Elements that a start tag of the same group ends, up to the element that holds the group.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("element", "linked", "seed", "tag", "tags_before", "text")

    def __init__(self, text: str, element: int, tag: str, seed: float, linked: int, tags_before: int) -> None:
        self.text, self.element, self.tag, self.seed, self.linked, self.tags_before = text, element, tag, seed, linked, tags_before


def _says(tag: str, attributes: str, within: float) -> float:
    """What an element says of its text, as a cost: positive for content, negative for other parts, ``within`` if nothing."""
    roles, words = set(), set()
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            if name.lower() == "role":
                roles.update(value.lower().split())
            else:
                words.update(w.lower() for w in _NAME_WORD.findall(value))
    if within == -SEED:
        return within
    frame = words & WITH_WORDS or words & FRAME_WORDS and words & FRAMED_WORDS
    if tag in OTHER_TAGS or roles & OTHER_ROLES or (words & OTHER_WORDS and not frame):
        return -SEED * LOOSE if within < SEED and (tag == "form" or tag in BLOCK - OTHER_TAGS and not roles) else -SEED
    if tag == "main" or "main" in roles or within != -SEED * LOOSE and (tag in CONTENT_TAGS or roles & CONTENT_ROLES):
        return SEED
    if abs(within) > HINT:
        return within
    if tag == "header" or words & HEADER_WORDS:
        return -SEED
    return HINT if words & CONTENT_WORDS else within


def read(page: str) -> tuple[list[Block], list[int], list[float]]:
    """Blocks of a page in order, and of every element its parent and what it says."""
    blocks: list[Block] = []
    parents, tags, seeds = [-1], ["body"], [0.0]  # elements; the first is the page
    stack = [0]
    run: list[str] = []
    linked = crossed = skip = 0
    link_depth = -1
    skip_tag = ""

    def flush() -> None:
        nonlocal linked, crossed
        if run:
            text = " ".join("".join(run).split())
            if text:
                e = stack[-1]
                blocks.append(Block(text, e, tags[e], seeds[e], min(linked, len(text)), crossed))
                crossed = 0
            run.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal link_depth
        del stack[depth:]
        if link_depth > depth:
            link_depth = -1

    def open_at(names: set[str], until: set[str]) -> int:
        """Depth of the innermost open element of ``names``, 0 where one of ``until`` is nearer or none is open."""
        for d in range(len(stack) - 1, 0, -1):
            if tags[stack[d]] in names:
                return d
            if tags[stack[d]] in until:
                return 0
        return 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        upto = m.start() if m else size
        if upto > at and not skip:
            part = page[at:upto]
            if "&" in part:
                part = html.unescape(part)
            run.append(part)
            if link_depth >= 0:
                linked += len(part)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            if m.group().startswith("<![CDATA[") and not skip:
                run.append(m.group()[9:].removesuffix("]]>"))
            continue
        name, ending = name.lower(), bool(m.group(1))
        if skip:
            if name == skip_tag:
                skip += -1 if ending else not m.group(3).rstrip().endswith("/")
            elif skip_tag == "head" and name == "body":
                skip = 0
            elif name in RAW and not ending:
                e = _END[name].search(page, at)
                at = e.start() if e else size
            continue
        if name in RAW:
            if not ending:
                e = _END[name].search(page, at)
                at = e.start() if e else size
            continue
        if name in NO_TEXT:
            if not ending and not m.group(3).rstrip().endswith("/"):
                skip, skip_tag = 1, name
            continue
        if name == "a":
            link_depth = -1 if ending else len(stack)
            continue
        if name == "br":
            run.append("\n")
            continue
        if name not in BLOCK:
            continue
        flush()
        crossed += 1
        if name in VOID or name in ("html", "body"):
            continue
        if ending:
            if d := open_at(HEADINGS if name in HEADINGS else {name}, {"table"} if name not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else set()):
                close_to(d)
            continue
        if d := open_at({"p"}, {"table", "td", "th", "caption"}):
            close_to(d)
        if name in ENDS and (d := open_at(*ENDS[name])):
            while d > 1 and tags[stack[d - 1]] in ENDS[name][0]:
                d -= 1
            close_to(d)
        elif name in HEADINGS and tags[stack[-1]] in HEADINGS:
            close_to(len(stack) - 1)
        seeds.append(_says(name, m.group(3), seeds[stack[-1]]))
        parents.append(stack[-1])
        tags.append(name)
        stack.append(len(tags) - 1)
    flush()
    return blocks, parents, seeds


# Features of a block's shape, and the weights from which the fit starts and to which it is drawn.
PRIOR = {
    "bias": -0.5, "length": 2.0, "linked": -3.0, "ends_sentence": 1.0, "commas": 0.3, "heading": 0.5, "item": -0.5, "paragraph": 0.5, "few_words": -0.5,
    "digits": -0.5, "copyright": -1.0, "place": 0.0, "edge": -0.3, "mass": 1.0, "linked_near": -0.5, "length_near": 0.5,
}
NAMES = list(PRIOR)


def shapes(blocks: list[Block]) -> np.ndarray:
    """One row of ``NAMES`` per block."""
    n = len(blocks)
    size = np.array([len(b.text) for b in blocks], float)
    linked = np.array([b.linked for b in blocks], float) / size
    length = np.log1p(size) / np.log(1000)
    mass: dict[int, float] = {}
    for b, s, k in zip(blocks, size, linked):
        mass[b.element] = mass.get(b.element, 0.0) + s * (1 - k)
    words = np.array([len(_WORD.findall(b.text)) for b in blocks], float)
    near = lambda v: (np.r_[v[:1], v[:-1]] + np.r_[v[1:], v[-1:]]) / 2
    place = (np.arange(n) + 0.5) / n
    flag = lambda f: np.fromiter((f(b) for b in blocks), float, n)
    cols = {
        "bias": np.ones(n), "length": length, "linked": linked, "ends_sentence": flag(lambda b: b.text[-1] in ".!?…。」\"”"), "commas": np.minimum(flag(lambda b: b.text.count(",")) / (words + 1) * 5, 1),
        "heading": flag(lambda b: b.tag in HEADINGS), "item": flag(lambda b: b.tag in ("li", "dt", "dd", "td", "th", "option")), "paragraph": flag(lambda b: b.tag in ("p", "blockquote", "pre")), "few_words": (words < 6).astype(float),
        "digits": flag(lambda b: sum(map(str.isdigit, b.text))) / size, "copyright": flag(lambda b: "©" in b.text), "place": place, "edge": 4 * (place - 0.5) ** 2,
        "mass": flag(lambda b: np.log1p(mass[b.element])) / np.log(10_000), "linked_near": near(linked), "length_near": near(length),
    }
    return np.column_stack([cols[c] for c in NAMES])


def min_cut(costs: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut, the one of fewest such nodes.

    Node ``i`` off the source's side costs ``costs[i]`` if that is positive, on it ``-costs[i]`` if
    negative; an edge ``(i, j, w)`` between the sides costs ``w``.
    """
    n = len(costs)
    t, near = list(costs), [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    around = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is not None or not (t[v] > around[v] or -t[v] >= around[v]):
            continue
        side[v] = t[v] > around[v]
        for u, w in near[v].items():
            if side[u] is None:
                t[u] += w if side[v] else -w
                around[u] -= w
                todo.append(u)
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        for v, s in zip(rest, _flow_side([t[v] for v in rest], [(a, b, near[x][y]) for at in [{v: i for i, v in enumerate(rest)}] for a, x in enumerate(rest) for y in near[x] if (b := at.get(y, -1)) > a])):
            side[v] = s
    return [bool(s) for s in side]


def _flow_side(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Maximum flow by level graphs; the nodes that the source still reaches."""
    n = len(costs)
    s, e = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(i: int, j: int, forth: int, back: int) -> None:
        for a, b, c in ((i, j, forth), (j, i, back)):
            out[a].append(len(to))
            to.append(b)
            cap.append(c)

    for v, c in enumerate(costs):
        if c > 0:
            add(s, v, c, 0)
        elif c < 0:
            add(v, e, -c, 0)
    for i, j, w in edges:
        add(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            for k in out[v]:
                if cap[k] and level[to[k]] < 0:
                    level[to[k]] = level[v] + 1
                    todo.append(to[k])
        if level[e] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == e:
                push = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= push
                    cap[k ^ 1] += push
                cut = next(i for i, k in enumerate(path) if not cap[k])
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[v] < len(out[v]):
                k = out[v][tried[v]]
                if cap[k] and level[to[k]] == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(out[v][tried[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                tried[v] += 1
            else:
                break


def graph(blocks: list[Block], parents: list[int], seeds: list[float], model: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Costs and edges: blocks first, then the elements that hold them."""
    n = len(blocks)
    logit = np.clip(shapes(blocks) @ model, -MOST, MOST)
    costs = [round(UNIT * (x + b.seed)) for x, b in zip(logit, blocks)]
    weight = lambda w, a, b: round(UNIT * w * (1 if a == b else ACROSS))
    edges = [(i, i + 1, weight(NEXT * 0.5 ** min(b.tags_before, 8), a.seed, b.seed)) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    at: dict[int, int] = {}
    for b in blocks:
        e = b.element
        while e >= 0 and e not in at:
            at[e] = n + len(at)
            e = parents[e]
    edges += [(i, at[b.element], weight(TREE, 0, 0)) for i, b in enumerate(blocks)]
    edges += [(k, at[parents[e]], weight(TREE, seeds[e], seeds[parents[e]])) for e, k in at.items() if parents[e] >= 0]
    return costs + [0] * len(at), edges


def main_text(page: str | None, model: np.ndarray) -> str:
    blocks, parents, seeds = read(page or "")
    if not blocks:
        return ""
    content = min_cut(*graph(blocks, parents, seeds, model))
    return "\n\n".join(b.text for b, c in zip(blocks, content) if c)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Logistic weights by Newton steps, both labels of equal weight in all, drawn to the prior ones."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    if not 0 < y.sum() < len(y):
        return w
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (y - p)) - ridge * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, page: str = "html", sample_pages: int = SAMPLE_PAGES, train_blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights of the block model, from blocks whose element says what they are, in about ``sample_pages`` different pages chosen by hash."""
    n = pages.count()
    h = F.xxhash64(F.col(page).cast("string"))
    some = pages.where(F.pmod(h, F.lit(max(n, 1))) < sample_pages).groupBy(h.alias("h")).agg(F.any_value(F.col(page).cast("string")).alias("page"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1):
            h, y, x = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, _, _ = read(t or "")
                if not blocks:
                    continue
                for i, (row, block) in enumerate(zip(shapes(blocks), blocks)):
                    if abs(block.seed) == SEED:
                        h.append(hash((k, i)))
                        y.append(int(block.seed > 0))
                        x.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.binary())], names=["h", "y", "x"])

    rows = some.select("h", "page").mapInArrow(run, "h bigint, y int, x binary")
    half = [rows.where(F.col("y") == y).orderBy("h", "x").limit(train_blocks // 2) for y in (0, 1)]
    found = half[0].unionByName(half[1]).select("y", "x").collect()
    return fitted(np.array([np.frombuffer(r.x) for r in found]).reshape(-1, len(NAMES)), np.array([r.y for r in found], float))


def extract(pages: DataFrame, model: np.ndarray, page: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, the main ``text`` of each page and its length ``n_chars`` in code points."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    src = pages.select(*[F.col(c) for c in keep], F.col(page).cast("string").alias("__page"))
    fields = [*src.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, len(keep)):
            texts = [main_text(t, model) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))
