"""Main text of pages: cuts against all labellings, hand-made pages, the given pages, and pages whose elements say nothing."""

import html
import itertools
import random
import re

import numpy as np

from loanforge.llm import extract
from loanforge.llm.extract import _flow_side, main_text, min_cut, read
from loanforge.llm.queries import REG

PRIOR = np.array(list(extract.PRIOR.values()))


def cost(costs, edges, side):
    return sum(c if c > 0 and not s else -c if c < 0 and s else 0 for c, s in zip(costs, side)) + sum(w for i, j, w in edges if side[i] != side[j])


def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 9)
        costs = [rnd.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, rnd.randint(0, 5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        least = min((cost(costs, edges, s), sum(s)) for s in itertools.product((False, True), repeat=n))
        for side in (min_cut(costs, edges), _flow_side(costs, edges)):
            assert (cost(costs, edges, side), sum(side)) == least


PAGE = """<!DOCTYPE html><html><head><title>T &lt; U</title><style>p{x}</style><script>if(a<b){"</p>"}</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, and this is a long sentence about them, for all of our readers.</p></div>
<main><div class="adBanner"><p>Buy now, it is cheap, and it is good, and you will like it.</p></div>
<article><header><h1>The  title &amp; more</h1></header>
<p>First <b>bold</b>&nbsp;para<i>graph</i>,<br>second line.
<p>De.</p><!-- <p>hidden</p> --><h2>Part</h2><ul><li>one</li><li>two <a href="x">link</a></ul>
<table><tr><td>cell<td>other</table><blockquote>Quote</blockquote>tail text
<form><label>Your mail</label><input value="v"><button>Go</button></form>
<aside><p>A pulled quote, long enough to look like any other sentence of the text.</p></aside>
<section id="comments"><h3>2 comments</h3><article><p>I liked this article, it was good, and I read it twice.</p></article></section>
<footer>Filed under: news</footer><textarea>typed</textarea></article></main>
<div role="complementary"><p>Something else to read, which is longer than most of the things around it.</p></div>
<footer>&copy; 2020 Site</footer></body></html>"""
TEXT = ["The title & more", "First bold paragraph, second line.", "De.", "Part", "one", "two link", "cell", "other", "Quote", "tail text"]


def test_hand_made_pages():
    assert main_text(PAGE, PRIOR).split("\n\n") == TEXT
    for odd in (None, "", " \n ", "<", "<p", "<!--", "</p></div>", "<script>x", "&", "<a <b>"):
        main_text(odd, PRIOR)
    assert main_text("<article>a<p>b&am;&#65;&#x42;&eacute;</article>", PRIOR) == "a\n\nb&am;ABé"
    assert main_text("<ARTICLE><P CLASS='x>y'>one<P>two", PRIOR) == "one\n\ntwo"
    assert main_text(PAGE[: PAGE.index("Quote")], PRIOR).split("\n\n") == TEXT[:-2]
    assert [b.text for b in read("<div>a<div>b</div>c<td>d")[0]] == ["a", "b", "c", "d"]
    long = "<article>" + "<p>x y</p><div><ul><li>z</ul></div>" * 5000 + "</article>"
    assert main_text(long, PRIOR).count("\n\n") == 9999
    deep = "<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000
    assert main_text(deep, PRIOR) == "deep"


def test_frames_and_parts_by_class_name():
    text = "<p>A sentence of the text, which is long enough, and has commas, as texts have.</p>" * 3
    other = "".join(f'<div class="{c}"><p>Something that is no text at all, though it reads like one, and goes on.</p></div>' for c in ("site-footer", "ad-container", "page_sidebar", "commentsWrapper", "NavWrapper", "cookie notice"))
    for frame in ("content-sidebar-wrap", "page with-sidebar", "layout main-sidebar-container"):
        got = main_text(f'<body class="search form"><div class="{frame}"><article>{text}</article>{other}</div></body>', PRIOR)
        assert got.split("\n\n") == ["A sentence of the text, which is long enough, and has commas, as texts have."] * 3
    wrapped = main_text(f'<form id="aspnetForm"><header><p>Site</p></header><main>{text}</main></form>', PRIOR)
    assert wrapped.count("\n\n") == 2


def plain(page):
    """The article of a given page by its known shape."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    parts = re.split(r"</?(?:h1|p)>", body.replace("<br>", " ").replace("<b>", ""))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = REG.queries["op11_main_text"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_elements_that_say_nothing(spark):
    """Held-out pages with ``div`` in place of every telling element: blocks found by the model and the cut."""
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = extract.fit(frame.where("page_id % 2 = 0"))
    held = [r.html for r in frame.where("page_id % 2 = 1").collect()]
    right = total = 0
    for page in held:
        mute = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        want, got = set(plain(page).split("\n\n")), set(main_text(mute, model).split("\n\n"))
        every = {b.text for b in read(mute)[0]}
        right += sum((b in want) == (b in got) for b in every)
        total += len(every)
    assert right / total > 0.9  # adverts of one sentence look like text


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "t", 2), (2, "", "t", 2), (2, "<main>a</main>", "t", 2), (2, "<main>a</main>", "t", 2), (None, "plain", "t", 2)], "page_id int, html string, text string, n_chars int")
    model = extract.fit(df)
    out = extract.extract(df, model, keep=("page_id", "text"))
    assert out.columns == ["page_id", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.where("page_id is not null").collect()) == [(1, "", 0), (2, "", 0), (2, "a", 1), (2, "a", 1)]
    assert extract.extract(df.limit(0), extract.fit(df.limit(0)), keep=("page_id",)).count() == 0
