"""Source divergence against plain code with exact integers."""

import random
import re
from collections import Counter

from loanforge.llm import divergence
from loanforge.llm.divergence import ADD, SCALE, audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, docs, out = {}, {}, []
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + SCALE * (c[t] + ADD) // (sum(c[x] for x in kept) + ADD * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                for r, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, v, r))
    return sorted(out)


def test_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rnd = random.Random(3)
    words = ["the", "THE", "of", "Äpfel", "äpfel", "x1y", "naïve-Σ", "▁", "don't", "\x85a", "zz", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "de", None]), f"s{rnd.randint(0, 90)}") for _ in range(400)]
    rows += [("the of " * 50, "en", "hot")] * 200 + [(None, "en", "empty"), ("", "fr", "a"), ("123 --", "fr", "b"), ("solo", "it", None), ("word " * 30000, "de", "long")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i % 7, *r, "x", 1) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string, n int")
    got = lambda frame: sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got(audit(df, 5, 6)) == brute(rows, 5, 6)
    assert got(audit(df.repartition(7), 5, 6, chunk_terms=4)) == brute(rows, 5, 6)
    assert got(audit(df, 10**6)) == brute(rows, 10**6, 50)
    assert audit(df.limit(0)).count() == 0
