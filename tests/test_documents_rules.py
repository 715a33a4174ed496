"""Chunking against a plain re-statement, keyword rules, rule evaluation and verdicts."""

import re

import pytest
from pyspark.sql import functions as F

from loanforge.operators import documents as dc
from loanforge.operators import rules as ru
from loanforge.plans.governance_queries import model_docs


def packed(text, size, overlap):
    """What paragraph packing must give, one document at a time."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n|\r", "\n", text))
    out, cur = [], ""
    for para in [p.strip() for p in text.split("\n\n") if p.strip()]:
        long = len(para) > size
        pieces = [(s, " ") for s in re.split(r"(?<=[.!?])\s+", para)] if long else [(para, "\n\n")]
        for i, (s, sep) in enumerate(pieces):
            if not (long and i == 0) and len(cur) + len(s) + len(sep) <= size:
                cur = (cur + sep + s).strip()
            else:
                if cur:
                    out.append(cur)
                cur = s
    out = out + [cur] if cur else out
    return [c if i == 0 or not overlap else (out[i - 1][-overlap:] + "\n\n" + c).strip() for i, c in enumerate(out)]


def test_paragraph_chunks(spark, sf):
    docs = model_docs(spark, sf)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in dc.paragraph_chunks(docs, size=300, overlap=40).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert len(got) == len(text)
    for k, chunks in got.items():
        assert chunks == packed(text[k], 300, 40)


def test_sections_and_windows(spark):
    body = "x" * 1300
    df = spark.createDataFrame([(1, f"intro line\nSection 4 Scope\nshort\n## Next\n{body}"), (2, "   ")], "doc_id int, text string")
    rows = dc.section_chunks(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r["chunk_index"], r["section"]) for r in rows] == [(0, "intro line"), (1, "Section 4 Scope"), (2, "## Next"), (3, "## Next"), (4, "## Next")]
    assert [len(r["chunk"]) for r in rows[2:]] == [600, 600, len("## Next\n" + body) - 1000]


def test_relevance(spark):
    df = spark.createDataFrame(
        [(0, "The bank must review PD and LGD under IFRS 9."), (1, "Page 3\nMust"), (2, "nothing here"), (3, "roc.auc rocauc credit risk default")], "chunk_index int, chunk string"
    )
    got = {r["chunk_index"]: r["score"] for r in dc.scored_chunks(df).collect()}
    assert got == {0: 0.75, 1: 0.15, 2: 0.0, 3: 0.3}


def test_keyword_rule_statuses(spark):
    rule = dc.KeywordRule("X", "s", "p", "st", "high", ("alpha", "beta"))
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alphabet"), (3, "none")], "doc_id int, text string")
    assert [r["status"] for r in dc.keyword_matches(df, [rule]).orderBy("doc_id").collect()] == ["PASS", "WARN", "FAIL"]


def test_stated_metric_order_and_range(spark):
    df = spark.createDataFrame([(1, "Recall: 1.70. Sensitivity: 0.61. AUC = 0.81, ROC-AUC: 0.82")], "doc_id int, text string")
    r = dc.stated_metrics(df).first()
    assert (r["roc_auc"], r["recall"], r["gini"]) == (0.82, 0.61, None)


def test_nearest_matches_brute_force(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = dc.centroids(e, "label")
    for found in (dc.nearest(e.repartition(5), q, 4), dc.nearest(e.repartition(5), q, 4, at_once=3), dc.nearest(e, [tuple(r) for r in q.collect()], 4, at_once=4)):
        got = found.collect()
        for label, v in q.collect():
            s = x @ (np.array(v) / np.linalg.norm(v))
            want = [rows[i]["vec_id"] for i in np.argsort(-s)[:4]]
            assert [r["vec_id"] for r in sorted((r for r in got if r["query"] == label), key=lambda r: r["rank"])] == want
    assert dc.nearest(e, q.limit(0), 4).count() == 0


@pytest.mark.parametrize(
    "op,value,limit,ok",
    [(">=", 1.0, 1.0, True), ("gte", 0.5, 1.0, False), ("<", 1.0, 1.0, False), ("==", 1.0, 1.0, True), ("!=", 1.0, 1.0, False),
     ("is_true", 0.0, None, False), ("is_false", 0.0, None, True), ("is_present", None, None, False), ("is_present", 3.0, None, True), ("weird", 1.0, 2.0, True)],
)
def test_operators(spark, op, value, limit, ok):
    df = spark.range(1).select(ru.rule_holds(F.lit(op), F.lit(value).cast("double"), F.lit(limit).cast("double")))
    assert df.first()[0] is ok


def test_not_verifiable_is_capped(spark):
    m = spark.createDataFrame([("m", "roc_auc", 0.5)], "entity string, metric string, value double")
    rules = [r for r in ru.RULES if r.stage == "evaluation"]
    rows = ru.evaluate_rules(m, rules, not_verifiable=3).collect()
    assert sum(r["status"] == "NOT_VERIFIABLE" for r in rows) == 3
    assert {r["rule_id"] for r in rows if r["status"] == "FLAG"} == {"R13", "IFRS9_B5.5_NO_PRAUC", "SS1_P3.3_NO_SENSITIVITY", "NO_SHAP"}


def test_all_rules_without_evidence_are_kept(spark):
    m = spark.createDataFrame([("m", "roc_auc", 0.5)], "entity string, metric string, value double")
    rows = ru.evaluate_rules(m, ru.RULES).collect()
    assert len(rows) == len(ru.RULES) and sum(r["status"] == "NOT_VERIFIABLE" for r in rows) > 20


def test_an_entity_without_flags_passes(spark):
    found = spark.createDataFrame([("a", "high")], "entity string, severity string")
    out = {r["entity"]: r for r in ru.compliance_report(found, spark.createDataFrame([("a",), ("b",)], "entity string"), 4).collect()}
    assert (out["b"]["overall_status"], out["b"]["compliance_score"], out["b"]["rules_passed"]) == ("PASS", 100.0, 4)
    assert (out["a"]["overall_status"], out["a"]["compliance_score"], out["a"]["rules_flagged"]) == ("FAIL", 75.0, 1)


def test_status_and_findings_come_from_one_event(spark):
    rows = [("m", "backtesting", 5, "Completed", 0), ("m", "backtesting", 5, "Not Started", 9)]
    df = spark.createDataFrame(rows, "model string, stage string, ts int, status string, f int")
    r = ru.validation_status(df, "model", "stage", "ts", "status", "f").first()
    assert (r["backtesting_status"], r["findings_count"]) in {("Completed", 0), ("Not Started", 9)}


def test_verdicts(spark):
    rows = [("a", "s", "HIGH", "PASS"), ("b", "s", "HIGH", "FAIL"), ("b", "s", "HIGH", "FAIL")] + [("c", "s", "HIGH", "FAIL")] * 3 + [("d", "s", "LOW", "PENDING")]
    f = spark.createDataFrame(rows, "entity string, stage string, severity string, status string")
    assert {r["entity"]: r["verdict"] for r in ru.verdict(f).collect()} == {"a": "PASS", "b": "CONDITIONAL", "c": "FAIL", "d": "CONDITIONAL"}


def test_frameworks(spark):
    df = spark.createDataFrame([("IFRS 9", "B5"), ("SS1/23", "P1"), ("x", "Chapter IV Section 2")], "s string, p string")
    pick = lambda f: [r[0] for r in df.select(ru.matches_frameworks(F.col("s"), F.col("p"), f)).collect()]
    assert pick(["IFRS9"]) == [True, False, False] and pick(["RBI"]) == [False, False, True] and pick([]) == [True] * 3


def test_inventory_prefers_real_values(spark):
    a = spark.createDataFrame([("m1", "Unknown", "x"), ("m2", None, None)], "id string, owner string, use string")
    b = spark.createDataFrame([("m1", "Kim", "y"), ("m2", "TBD", "z")], "id string, owner string, use string")
    got = {r["id"]: (r["owner"], r["use"]) for r in ru.merge_inventory([a, b], "id", ["owner", "use"]).collect()}
    assert got == {"m1": ("Kim", "x"), "m2": ("TBD", "z")}


def test_stability_checks():
    assert ru.stability_checks([0.7, 0.7], {"f": 0.1}) == [("R4.5", "medium", 0.1, "FAIL"), ("R4.6", "medium", 0.0, "PASS")]
    assert ru.stability_checks([], {})[1][3] == "WARN"
