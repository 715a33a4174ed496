"""Secret scan against plain regular expressions; learned automata on planted formats."""

import random
import re

import pyarrow as pa

from loanforge.llm import secrets
from loanforge.llm.queries import REG


def brute(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def listed(spans):
    return ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in spans if s["kind"] != secrets.LEARNED)


def test_base_spans_against_plain_patterns(spark):
    rnd = random.Random(1)
    bits = ["token", "SECRET", "api_key", "apikey", "paſſword", "toKen", "=", ":", " ", '"', "'", "AKIA", "Z9" * 8, "abc", "0f" * 12, "é🙂", "x", "\n", "passwd:ab", "secret:token: abcdefgh"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))), i) for i in range(400)]
    rows += [(900, None, 1), (901, "", 2), (None, "token=abcdefg", 3), (902, "deadbeef" * 40_000, 4), (902, "deadbeef" * 40_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, secrets int")
    out = secrets.scan(df, secrets.learn({})).collect()
    assert [listed(r.secrets) for r in out] == [brute(t) for _, t, _ in rows]
    assert secrets.scan(df.limit(0), secrets.learn({})).count() == 0


def test_automaton_learns_a_format():
    rnd = random.Random(2)
    key = lambda: "sk-" + "".join(rnd.choice("0123456789abcdef") for _ in range(28))
    f = secrets.learn({"assign": [key() for _ in range(200)], "few": ["ab1"] * 3})
    assert list(f.automata) == ["assign"] and len(f.automata["assign"][0].red) < 60
    assert sum(f.best(key()) is not None for _ in range(200)) > 180
    assert not any(f.best(x) for x in ["the-quick-brown-fox-jumps-9", "www.example.com/page/123456", "SK=" + "Z9" * 14, "2024-01-01T00.00.00-2024-02"])
    text = f"see {key()} and word-with-number-12345678"
    assert [s[0] for s in secrets.spans_of(text, f)] == ["hex", "learned"][1:] or [s[0] for s in secrets.spans_of(text, f)] == ["hex"]
    assert secrets.mask("a token=abcdef b", secrets.spans_of("a token=abcdef b", f)) == "a <assign> b"


def test_short_and_letter_only_tokens_are_scored(spark):
    rnd = random.Random(4)
    short = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(16))
    letters = lambda: "".join(rnd.choice("GHJKQRTWXYZ") for _ in range(8))
    f = secrets.learn({"assign": [short() for _ in range(200)], "access": [letters() for _ in range(200)]})
    rows = [(i, f"row | {short() if i % 2 else letters()} | end") for i in range(40)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id int, text string"), f).collect()
    assert sum([s["kind"] for s in r.secrets] == ["learned"] for r in out) > 30
    assert f.best("ordinary") is None and f.best("sentence-like") is None


def test_batches_give_the_spans_of_texts_and_score_a_token_once(monkeypatch):
    rnd = random.Random(5)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(18))
    f = secrets.learn({"assign": [key() for _ in range(100)], "access": ["AKIA" + "".join(rnd.choice("QRSTUV789") for _ in range(16)) for _ in range(100)]})
    bits = [key() for _ in range(6)] + ["token", "SECRET", "api_key", "paſſword", "to\u212aen", "=", ":", " ", " ", '"', "AKIA", "Z9" * 8, "0f" * 12, "é🙂", "\n", "ordinary", "sentence-like"]
    texts = [None if i % 40 == 0 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for i in range(600)]
    asked, accepts, known, out = [], f.accepting(), {}, []
    for i in range(0, len(texts), 100):
        out += secrets.found_in(pa.array(texts, pa.string()).slice(i, 100), lambda t: asked.append(t) or accepts(t), known)
    assert out == [secrets.spans_of(t, f) if t else [] for t in texts]
    assert sum(s[0] == secrets.LEARNED for spans in out for s in spans) > 100
    short = [t for t in asked if len(t) <= secrets.MEMO_LENGTH]
    assert len(short) == len(set(short)) > 200
    assert all(accepts(t) == (f.best(t) is not None) for t in asked)
    # No label, no search: a text with a colon but none of the words is passed over.
    searched = []
    monkeypatch.setattr(secrets, "ASSIGN", type("Counted", (), {"finditer": lambda self, t: searched.append(t) or iter(())})())
    secrets.found_in(pa.array(["plain: text", "a Token: abcdefgh", "ap: x", ""]), None, {})
    assert searched == ["a Token: abcdefgh"]


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = REG.queries["op2_secret_scan"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        base = [s for s in r.spans.split(",") if s and not s.startswith("learned")]
        assert ",".join(base) == brute(docs[r.doc_id])
        assert r.n_assign == sum(s.startswith("assign") for s in base)
