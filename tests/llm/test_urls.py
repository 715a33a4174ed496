"""URL verdicts: rules against plain string work, the models against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from loanforge.llm.queries import REG, URL_RULES
from loanforge.llm.urls import ALPHABET, LAMBDA, Rule, fit, judge


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_of_the_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = REG.queries["op6_url_filter"](spark, sf).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)


def test_odd_urls(spark):
    urls = ["http://A.ORG", "http://a.org/", "HTTPS://Example.Org/es/?x", "example.org/es/", "", None, "x://y://example.org/en/1", "http://sub.EXAMPLE.org/en/12#z", "http://notexample.org/es/", "://com/fr/", "http://É.com/de/", "http://a.org/\n?x", "http://b.net/" + "a" * 100_000]
    rows = [(i, u, f"s{i}") for i, u in enumerate(urls)] + [(None, "http://a.org/", "s"), (1, "http://a.org/", "s1")]
    df = spark.createDataFrame(rows, "page_id int, url string, score string")
    got = judge(df, URL_RULES).collect()
    for (i, u, _), r in zip(rows, got):
        host, path, rule, verdict = plain(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule)
        assert verdict in (None, r.verdict)
    assert judge(df.limit(0), URL_RULES).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    word = lambda bad: "".join(rnd.choice("xqzv7" if bad else "aeinst") for _ in range(8))
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        rows.append((i, f"http://{word(bad)}.{['bad.com', 'good.com', 'x.net'][2 if i % 3 == 0 else 1 - bad]}/{word(bad)}", bad))
    return rows


def test_models_against_plain_counts(spark, pages):
    rules = [Rule("block", "bad.com", "/"), Rule("allow", "good.com", "/")]
    df = spark.createDataFrame(pages, "page_id int, url string, bad boolean")
    out = judge(df, rules).collect()
    counts = {True: Counter(), False: Counter()}

    def grams(u):
        t = ["", "", "", *u.split("://", 1)[1]]
        return [tuple(t[i - 3 : i + 1]) for i in range(3, len(t))]

    for _, u, bad in pages:
        if ".x.net" not in u and zlib.crc32(u.encode()) % 4:
            for g in grams(u):
                for k in range(5):
                    counts[bad][g[4 - k :] if k else ()] += 1
                for k in (2, 3, 4):
                    counts[bad]["before", *g[4 - k : 3]] += 1

    def p(c, g, k):
        if k == 1:
            return (c[g[3:]] + 1) / (c[()] + ALPHABET)
        return (c[g[4 - k :]] + LAMBDA * p(c, g, k - 1)) / (c["before", *g[4 - k : 3]] + LAMBDA)

    def ratio(g):
        return math.log(p(counts[False], g, 4) / p(counts[True], g, 4))

    for r in out:
        gs = grams(r.url)
        assert abs(r.score - sum(map(ratio, gs)) / len(gs)) < 1e-6
    assert all(r.verdict == ("block" if r.bad else "allow") for r in out)


def test_without_examples(spark, pages):
    df = spark.createDataFrame(pages[:20], "page_id int, url string, bad boolean")
    assert {r.verdict for r in judge(df, []).collect()} == {"allow"}
    assert fit(df.selectExpr("url", "'allow' v"), "url", "v").counts is None


def test_scores_are_exact_without_parameters(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    rows = [(i, f"http://{word()}.{('bad.com', 'good.com', 'x.net')[i % 3]}/{word()}", i % 3) for i in range(1500)]
    rows += [(9000 + i, "http://same.x.net/aaaa", 2) for i in range(50)] + [(9999, None, 2)]
    out = judge(spark.createDataFrame(rows, "page_id int, url string, kind int"), [Rule("block", "bad.com", "/"), Rule("allow", "good.com", "/")]).collect()
    grams = lambda u: [tuple(["", "", "", *u.split("://", 1)[1]][i : i + 4]) for i in range(len(u.split("://", 1)[1]))]
    counts = [Counter(), Counter()]
    for _, u, kind in rows:
        if kind < 2 and zlib.crc32(u.encode()) % 4:
            for g in grams(u):
                counts[kind].update([g[4 - k :] for k in range(1, 5)] + ["all"] + [("before", *g[4 - k : 3]) for k in (2, 3, 4)])
    assert len({g for c in counts for g in c if len(g) == 4 and g[0] != "before"}) > 1 << 16  # more strings than the old table had slots

    def p(c, g, k):
        return (c[g[3:]] + 1) / (c["all"] + ALPHABET) if k == 1 else (c[g[4 - k :]] + LAMBDA * p(c, g, k - 1)) / (c["before", *g[4 - k : 3]] + LAMBDA)

    def ratio(g):
        return math.log(p(counts[1], g, 4) / p(counts[0], g, 4))

    assert len(out) == len(rows)
    for r in out:
        gs = grams(r.url) if r.url else []
        assert abs(r.score - sum(map(ratio, gs)) / max(len(gs), 1)) < 1e-6


def test_unseen_characters_after_seen_contexts(spark):
    """A context that only one class has speaks for it, whatever comes after; each class's probabilities sum to one."""
    rows = [(i, f"http://b{i}.bad.com/qqq{i % 10}") for i in range(200)] + [(1000 + i, f"http://g{i}.good.com/eee{i % 10}") for i in range(200)]
    rows += [(5000, "http://x.net/qqq~"), (5001, "http://x.net/eee~")]
    df = spark.createDataFrame(rows, "page_id int, url string")
    rules = [Rule("block", "bad.com", "/"), Rule("allow", "good.com", "/")]
    out = {r.page_id: r for r in judge(df, rules).collect()}
    assert out[5000].score < out[5001].score
    model = fit(df.selectExpr("url", "case when url like '%bad%' then 'block' when url like '%good%' then 'allow' end v"), "url", "v")
    letters = spark.createDataFrame([("qqq" + chr(c),) for c in range(33, 127)], "g string")
    kinds = {(r.kind, r.g): (r.a, r.b) for r in model.counts.collect()}

    def p(g, k, x):
        n = lambda kind, t: kinds.get((kind, t), (0, 0))[x]
        return (n("s1", g[-1]) + 1) / (model.totals[x] + ALPHABET) if k == 1 else (n(f"s{k}", g[-k:]) + LAMBDA * p(g, k - 1, x)) / (n(f"c{k}", g[-k:-1]) + LAMBDA)

    for x in (0, 1):
        total = sum(p("qqq" + chr(c), 4, x) for c in range(ALPHABET))
        assert abs(total - 1) < 1e-9
    got = {r.g: r.r * 1e-9 for r in model.strings(letters).collect()}
    assert all(abs(v - math.log(p(g, 4, 0) / p(g, 4, 1))) < 1e-6 for g, v in got.items())
