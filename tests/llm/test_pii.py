"""Personal data: patterns against plain regular expressions, terms against plain counts."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from loanforge.llm import pii
from loanforge.llm.queries import REG


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    t, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


def found(spans):
    return [(s["kind"], s["start"], s["stop"]) for s in spans if s["kind"] != pii.TERM]


def test_patterns_against_plain_ones(spark):
    rnd = random.Random(1)
    bits = ["a@b.c", "@", ".", "_", "x", "-", "+", "1", "22", "333", "1.2.3.4", "255", "256", "0007", "4111 1111 1111 1111", "4111-1111", " ", "  ", "é🙂", "+49 (0)30 ", "\n", "user.name%x@mail-1.org"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))), i) for i in range(600)]
    rows += [(900, None, 1), (901, "", 2), (None, "mail a@b.c", 3), (902, "1 " * 60_000, 4), (903, "1." * 50_000 + "1", 5), (904, "a@" + "b." * 40_000 + "c", 6), (905, "x" * 150_000, 7), (1, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").withColumn("pii", F.lit(1)).withColumn("spans", F.lit("x"))
    got = pii.sanitise(df, mask=False).orderBy("n").collect()
    want = sorted(rows, key=lambda r: r[2])
    by_key = {}
    for k, t, n in want:
        by_key.setdefault((k, n), []).append(brute(t))
    for r in got:
        assert found(r.pii) in by_key[r.doc_id, r.n]
    assert len(got) == len(rows)
    assert pii.sanitise(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rnd = random.Random(2)
    filler = [f"{a}{b}" for a in ("mead", "wind", "gard", "silv", "yell") for b in ("ow", "en", "er", "on", "ix")]
    words = lambda: " ".join(rnd.choice(filler) for _ in range(6))
    docs = [(i, f"{words()} Zebulon {words()} zeb@corp.com {words()}") for i in range(5)]
    docs += [(50 + i, f"{words()} falconer {words()} zeb@corp.com") for i in range(3)] + [(60 + i, f"falconer {words()}") for i in range(2)]
    docs += [(100 + i, f"{words()} p{i}@corp.com {words()}") for i in range(90)] + [(200 + i, words()) for i in range(40)] + [(250, None)]
    docs += [(300, "Quagga once p1@corp.com"), (301, "Quagga once p1@corp.com")]  # copies are one surrounding
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found_rows = pii.found_in(df)
    terms = {(r.value, r.term): r for r in pii.disclosing_terms(df, found_rows).collect()}
    assert set(terms) == {("zeb@corp.com", "zebulon"), ("zeb@corp.com", "falconer")}
    z, f = terms["zeb@corp.com", "zebulon"], terms["zeb@corp.com", "falconer"]
    assert (z.action, f.action) == ("remove", "generalise") and z.share == 1.0 and f.share == 0.6
    assert abs(z.bits - math.log2(len(docs) / 8)) < 1e-9
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in out[0].text and "<email>" in out[0].text and out[250].text is None
    assert "<term>" in out[50].text and out[60].text == dict(docs)[60]


def test_shared_passage_counts_every_different_text(spark):
    own = lambda i: " ".join(f"own{chr(97 + i % 26)}{chr(97 + j)}" for j in range(25))
    rows = [(i, f"{own(i)} -- {' ' * 80} Ottoline Vandermeer zed@corp.com") for i in range(6)] + [(100 + i, own(i)) for i in range(60)]
    rows += [(300, "Quagga once p@corp.com"), (301, "Quagga once p@corp.com")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.value, r.term): r for r in pii.disclosing_terms(df, pii.found_in(df)).collect()}
    assert {("zed@corp.com", "ottoline"), ("zed@corp.com", "vandermeer")} <= set(got)
    assert not any(v == "p@corp.com" for v, _ in got)  # exact copies are one text


def test_terms_of_whole_texts_of_any_length(spark):
    body = lambda i: " ".join(f"f{chr(97 + (i * 7 + j * 3) % 26)}{chr(97 + (i + j * j) % 26)}" for j in range(60))
    rows = [(i, f"Ng {body(i)} a@corp.com {body(i + 1)} K7-9021") for i in range(3)]
    rows += [(100 + i, f"{body(i + 3)} q{i}@corp.com {body(i + 9)}") for i in range(60)] + [(200, f"{body(2)} b@corp.com")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.term: r.share for r in pii.disclosing_terms(df, pii.found_in(df)).where("value = 'a@corp.com'").collect()}
    assert {"ng": 1.0, "k7": 1.0, "9021": 1.0}.items() <= got.items()
    assert "a" not in got and "corp" not in got  # parts of the entity itself
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(w not in text[1] for w in ("Ng", "K7", "9021", "@"))
    assert "<email>" in text[1] and text[200].startswith(body(2))


def test_one_text_of_100_000_spans(spark):
    n = 100_000
    text = " ".join(f"q{i}@corp.com" if i % 2 else f"word{i % 50}" for i in range(2 * n))
    rows = [(0, text), (1, "other text"), (2, None)]
    begin = time.time()
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.time() - begin < 60
    assert found(out[0].pii) == [("email", *m.span()) for m in re.finditer(r"q\d+@corp.com", text)]
    assert out[0].text == re.sub(r"q\d+@corp.com", "<email>", text)


def test_masked_and_clear_against_plain_code(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        text = "".join(rnd.choice("ab 🙂é") for _ in range(rnd.choice([0, 5, 40, 1300])))
        spans = sorted({(a, min(a + rnd.randint(1, 9), len(text))) for a in (rnd.randint(0, max(len(text) - 1, 0)) for _ in range(rnd.randint(0, 30))) if text})
        words = sorted({(a, min(a + rnd.randint(1, 4), len(text))) for a in (rnd.randint(0, max(len(text) - 1, 0)) for _ in range(rnd.randint(0, 30))) if text})
        rows.append((i, text, [("email", a, b, "v") for a, b in spans], [("term", a, b, rnd.choice(["remove", "generalise"])) for a, b in words]))
    kind = "array<struct<kind:string,start:int,stop:int,value:string>>"
    df = spark.createDataFrame(rows, f"i int, text string, spans {kind}, words {kind}")
    out = df.select("i", pii._clear(F.col("words"), F.col("spans")).alias("clear"), pii.masked(F.col("text"), F.concat("spans", "words")).alias("masked")).collect()
    for r in out:
        _, text, spans, words = rows[r.i]
        assert sorted(tuple(w) for w in r.clear) == sorted(w for w in words if not any(a < w[2] and w[1] < b for _, a, b, _ in spans))
        at, want = 0, ""
        for k, a, b, v in sorted(spans + words, key=lambda s: (s[1], s[2], s[0], s[3])):
            if a >= at:
                want += text[at:a] + ("" if v == "remove" else f"<{k}>")
            at = max(at, b)
        assert r.masked == want + text[at:]


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = REG.queries["op10_personal_data"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        base = [s for s in r.spans.split(",") if s and not s.startswith("term")]
        assert base == [f"{k}:{a}:{z}" for k, a, z in brute(docs[r.doc_id])]
        assert r.n_email == sum(s.startswith("email") for s in base)
