"""Document jobs: section chunks, paragraph chunks, relevance, keyword rules, quotes, stated metrics, retrieval.

Each document is one row and every step is an expression over that row, so
chunking, scoring and matching need no shuffle; only results leave the row,
never copies of the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanforge.functions.expressions import compute_once

CHUNK_SIZE = 600
CHUNK_OVERLAP = 100
TOP_K = 8
# Heading, obligation and noise patterns.
HEADING = (
    r"(?:Principle|Section|Appendix|Annex|Article|Chapter)\s+\d+"
    r"|\d+\.\d*\s+\S"
    r"|[A-Z][A-Z ,\-]{5,}\s*$"
    r"|#{1,3}\s"
)
OBLIGATION = (
    r"\b(shall|must|required to|is required|are required|should|need to|obligated|mandated|prohibited from|"
    r"is prohibited|failure to|non.compliance)\b"
)
NOISE = r"^(table of contents|contents|appendix [a-z]|page \d|\.{5,}|\d+\s*$)"
# Keywords that raise the relevance of a chunk; a dot is an optional dot.
REGULATORY_KEYWORDS = [
    "expected credit loss", "ecl", "ifrs 9", "ifrs9", "stage 1", "stage 2", "stage 3", "staging",
    "significant increase in credit risk", "sicr", "credit impaired", "default", "days past due", "dpd",
    "probability of default", "pd", "loss given default", "lgd", "exposure at default", "ead", "lifetime",
    "ss1/23", "model risk", "model validation", "challenger model", "cross.validation", "overfitting", "data leakage",
    "explainability", "interpretability", "shap", "class imbalance", "smote", "resampling", "roc.auc", "recall",
    "precision", "f1", "threshold", "minimum", "maximum", "limit", "disclosure", "reporting", "provision", "impairment",
    "capital requirement", "regulatory capital", "pillar", "concentration risk", "credit risk", "market risk",
    "past due", "arrears", "forbearance",
]
# Patterns of stated metrics, tried in order per metric.
METRIC_PATTERNS = [
    ("roc_auc", [r"roc[\s\-_]?auc[\s:=of]+([0-9]\.[0-9]{2,4})", r"\bauc[\s:=]+([0-9]\.[0-9]{2,4})",
                 r"area under (?:the )?(?:roc )?curve[\s:=]+([0-9]\.[0-9]{2,4})", r"c[\s\-]?statistic[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("gini", [r"gini[\s\-_]?(?:coefficient|index|score)?[\s:=]+([0-9]\.[0-9]{2,4})", r"gini[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("ks", [r"k[\s\-]?s[\s\-]?(?:statistic|score|test)?[\s:=]+([0-9]\.[0-9]{2,4})", r"kolmogorov[\s\-]?smirnov[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("cv_mean_auc", [r"cv[\s\-_]?(?:mean[\s\-_]?)?auc[\s:=]+([0-9]\.[0-9]{2,4})",
                     r"cross[\s\-]?val(?:idation)?[\s\-_]?(?:mean[\s\-_]?)?auc[\s:=]+([0-9]\.[0-9]{2,4})",
                     r"mean[\s\-_]?cv[\s\-_]?auc[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("accuracy", [r"accuracy[\s:=]+([0-9]\.[0-9]{2,4})", r"overall accuracy[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("precision", [r"precision[\s:=]+([0-9]\.[0-9]{2,4})", r"positive predictive value[\s:=]+([0-9]\.[0-9]{2,4})", r"ppv[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("recall", [r"recall[\s:=]+([0-9]\.[0-9]{2,4})", r"sensitivity[\s:=]+([0-9]\.[0-9]{2,4})",
                r"true positive rate[\s:=]+([0-9]\.[0-9]{2,4})", r"tpr[\s:=]+([0-9]\.[0-9]{2,4})"]),
    ("f1", [r"f[\s\-]?1[\s\-]?(?:score)?[\s:=]+([0-9]\.[0-9]{2,4})", r"f[\s\-]?measure[\s:=]+([0-9]\.[0-9]{2,4})"]),
]


@dataclass(frozen=True)
class KeywordRule:
    """A document rule: PASS from ``min_hits`` keywords, WARN on fewer, FAIL on none."""

    id: str
    source: str
    principle: str
    stage: str
    severity: str
    keywords: tuple[str, ...]
    min_hits: int = 2


# Document rules with their keywords.
KEYWORD_RULES = [
    KeywordRule("V01", "IFRS 9", "B5.5.28", "data_validation", "high", ("default", "days past due", "90 dpd", "dpd", "backstop", "credit impaired")),
    KeywordRule("V02", "IFRS 9", "B5.5.49", "data_validation", "high", ("forward-looking", "macroeconomic", "scenario", "probability-weighted", "multiple scenarios", "macro variable")),
    KeywordRule("V03", "SS11/13", "§10.1", "data_validation", "high", ("observation window", "performance window", "historical data", "training data", "date range", "economic cycle")),
    KeywordRule("V04", "SS1/23", "P3.2", "data_validation", "medium", ("sampling", "exclusion criteria", "population", "selection bias", "survivorship bias", "representative")),
    KeywordRule("V05", "SS1/23", "P3.5", "data_validation", "high", ("leakage", "post-default", "data leakage", "feature selection", "variable selection", "exclusion")),
    KeywordRule("V06", "SS1/23", "P1.1", "conceptual_soundness", "high", ("purpose", "intended use", "scope", "portfolio", "applicability", "objective")),
    KeywordRule("V07", "SS1/23", "P2.1", "conceptual_soundness", "high", ("rationale", "justification", "selected", "chosen", "appropriate", "algorithm", "model choice")),
    KeywordRule("V08", "SS1/23", "P2.2", "conceptual_soundness", "high", ("benchmark", "challenger", "baseline", "comparison", "alternative model", "gini", "auc")),
    KeywordRule("V09", "SS1/23", "P2.4", "conceptual_soundness", "high", ("assumption", "limitation", "caveat", "constraint", "simplifying", "not applicable")),
    KeywordRule("V10", "IFRS 9", "B5.5.17", "conceptual_soundness", "high", ("sicr", "significant increase", "credit risk", "staging", "stage 2", "qualitative backstop", "30 days")),
    KeywordRule("V11", "SS1/23", "P2.5", "conceptual_soundness", "medium", ("explainability", "interpretability", "shap", "feature importance", "explain", "transparent")),
    KeywordRule("V12", "SS1/23", "P1.3", "conceptual_soundness", "medium", ("governance", "version control", "model owner", "review", "inventory", "escalation")),
    KeywordRule("V13", "RBI MRM Guidelines", "Guidance on Regulatory Principles for Model Risk Management, 2026, Chapter – IV, Section 26(1)", "conceptual_soundness", "high", ("model objectives", "rationale", "scope", "application", "intended use")),
    KeywordRule("V14", "RBI MRM Guidelines", "Guidance on Regulatory Principles for Model Risk Management, 2026, Chapter – IV, Section 26(2)", "conceptual_soundness", "high", ("cost-benefit analysis", "ethical considerations", "bias", "fairness", "risks", "adverse outcomes")),
    KeywordRule("V15", "RBI MRM Guidelines", "Guidance on Regulatory Principles for Model Risk Management, 2026, Chapter – IV, Section 27", "conceptual_soundness", "high", ("structured process", "data preprocessing", "model design", "assumptions", "limitations", "performance evaluation")),
]


@dataclass(frozen=True)
class DocumentCheck:
    """Keyword presence check with the status given when nothing is found."""

    id: str
    stage: str
    severity: str
    otherwise: str
    keywords: tuple[str, ...]


# Document checks of the governance, data, conceptual and regulatory stages.
DOCUMENT_CHECKS = [
    DocumentCheck("1.1", "Stage 1: Governance", "HIGH", "FAIL", ("purpose", "intended use", "business objective", "scope")),
    DocumentCheck("1.5", "Stage 1: Governance", "HIGH", "WARN", ("pd", "lgd", "ead", "ifrs 9", "irb", "probability of default")),
    DocumentCheck("1.6", "Stage 1: Governance", "MEDIUM", "FAIL", ("assumption", "limitation")),
    DocumentCheck("1.7", "Stage 1: Governance", "MEDIUM", "WARN", ("scope", "target population", "out of scope", "applicability")),
    DocumentCheck("1.8", "Stage 1: Governance", "MEDIUM", "WARN", ("version", "change log", "revision", "history")),
    DocumentCheck("2.6", "Stage 2: Data Validation", "MEDIUM", "WARN", ("sampling", "selection", "population", "representative")),
    DocumentCheck("2.7", "Stage 2: Data Validation", "MEDIUM", "WARN", ("transform", "encoding", "scaling", "normaliz", "log transform", "binning", "woe")),
    DocumentCheck("3.2", "Stage 3: Conceptual Soundness", "HIGH", "WARN", ("iv", "information value", "woe", "weight of evidence", "feature selection")),
    DocumentCheck("3.5", "Stage 3: Conceptual Soundness", "HIGH", "FAIL", ("bias", "fairness", "discriminat", "protected", "demographic", "equal")),
    DocumentCheck("3.6", "Stage 3: Conceptual Soundness", "MEDIUM", "WARN", ("variable selection", "feature selection", "lasso", "stepwise", "iv", "information value")),
    DocumentCheck("3.7", "Stage 3: Conceptual Soundness", "LOW", "WARN", ("log transform", "binning", "encoding", "scaling", "normaliz", "standardiz")),
    DocumentCheck("3.8", "Stage 3: Conceptual Soundness", "MEDIUM", "WARN", ("operating", "boundary", "boundaries", "score range", "input domain", "extrapolat", "out of sample")),
    DocumentCheck("3.9", "Stage 3: Conceptual Soundness", "MEDIUM", "WARN", ("hyperparameter", "tuning", "grid search", "random search", "n_estimators", "max_depth", "learning rate")),
    DocumentCheck("3.10", "Stage 3: Conceptual Soundness", "LOW", "WARN", ("smote", "oversamp", "undersamp", "class weight", "imbalance", "minority")),
    DocumentCheck("7.1", "Stage 7: Regulatory Compliance", "HIGH", "FAIL", ("calibrat", "platt", "isotonic", "through the cycle", "ttc")),
    DocumentCheck("7.2", "Stage 7: Regulatory Compliance", "HIGH", "FAIL", ("stage 1", "stage 2", "stage 3", "staging", "sicr", "lifetime ecl", "12 month")),
    DocumentCheck("7.3", "Stage 7: Regulatory Compliance", "HIGH", "FAIL", ("sicr", "significant increase", "credit risk", "30 dpd", "pd doubling", "backstop")),
    DocumentCheck("7.4", "Stage 7: Regulatory Compliance", "HIGH", "FAIL", ("lifetime ecl", "lifetime pd", "pd term structure", "expected credit loss", "ecl")),
]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ---- chunks --------------------------------------------------------------


def section_chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (section, chunk): split at headings, long sections in overlapping windows."""
    step = size - overlap
    sections = F.filter(F.transform(F.split(text, rf"(?m)(?=^(?:{HEADING}))", -1), strip), lambda s: F.length(s) > 0)

    def windows(s: Column) -> Column:
        head = F.substring(strip(F.substring_index(s, "\n", 1)), 1, 120)
        last = F.when(F.length(s) <= size, F.lit(0)).otherwise(F.ceil((F.length(s) - size) / F.lit(step)).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: strip(s.substr(i * step + 1, F.lit(size))))
        return F.transform(F.filter(parts, lambda p: F.length(p) > 0), lambda p: F.struct(head.alias("section"), p.alias("chunk")))

    return F.flatten(F.transform(sections, windows))


def section_chunks(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), **kw) -> DataFrame:
    """One row per chunk: kept columns, chunk_index, section, chunk."""
    return docs.select(*keep, F.posexplode(section_chunk_array(F.col(text), **kw)).alias("chunk_index", "c")).select(
        *keep, "chunk_index", "c.section", "c.chunk"
    )


def paragraph_chunk_array(text: Column, size: int = 800, overlap: int = 150) -> Column:
    """Paragraphs packed to ``size`` characters; long ones by sentence; each chunk led by the tail of the one before."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"\n{3,}", "\n\n")
    paras = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda p: F.length(p) > 0)

    def unit(s: Column, sep: str, force: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(sep).alias("sep"), force.alias("force"))

    units = F.flatten(
        F.transform(
            paras,
            lambda p: F.when(F.length(p) <= size, F.array(unit(p, "\n\n", F.lit(False)))).otherwise(
                F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s, i: unit(s, " ", i == 0))
            ),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, u: Column) -> Column:
        cur, s = acc["cur"], u["s"]
        fits = ~u["force"] & (F.length(cur) + F.length(s) + F.length(u["sep"]) <= size)
        return F.when(fits, F.struct(acc["done"].alias("done"), strip(F.concat(cur, u["sep"], s)).alias("cur"))).otherwise(
            F.struct(F.when(cur != "", F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), s.alias("cur"))
        )

    packed = F.aggregate(
        units, start, pack, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
    )
    if overlap <= 0:
        return packed
    tails = F.concat(F.array(F.lit(None).cast("string")), F.transform(packed, lambda c: F.right(c, F.lit(overlap))))
    return F.zip_with(packed, F.slice(tails, 1, F.greatest(F.size(packed), F.lit(0))), lambda c, t: F.when(t.isNull(), c).otherwise(strip(F.concat(t, F.lit("\n\n"), c))))


def paragraph_chunks(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), **kw) -> DataFrame:
    return docs.select(*keep, F.posexplode(paragraph_chunk_array(F.col(text), **kw)).alias("chunk_index", "chunk"))


def relevance(low: Column, tokens: Column, keywords: Sequence[str] = REGULATORY_KEYWORDS, per_hit: float = 0.10) -> Column:
    """Score of lower-cased text: 0.45 for obligation words, ``per_hit`` per keyword up to 0.55,
    minus 0.30 for noise lines; within 0..1.

    Single-word keywords are set membership among the text's ``tokens``; phrases
    are searched only in text that holds the first word of one.
    """
    words = [k for k in keywords if k.isalnum()]
    phrases = [k for k in keywords if not k.isalnum()]
    starts = sorted({w for k in phrases for w in (re.split(r"\W", k)[0], re.sub(r"\W", "", k))})
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    found = F.lit(0)
    for k in phrases:
        found = found + low.rlike(rf"\b{k.replace('.', '[.]?')}\b").cast("int")
    hits = F.lit(0)
    if words:
        hits = hits + F.size(F.array_intersect(tokens, lits(words)))
    if phrases:
        hits = hits + F.when(F.arrays_overlap(tokens, lits(starts)), found).otherwise(0)
    score = (
        F.when(low.rlike(OBLIGATION), 0.45).otherwise(0.0)
        + F.least(hits * F.lit(per_hit), F.lit(0.55))
        - F.when(low.rlike(f"(?m){NOISE}"), 0.30).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6)


def scored_chunks(chunks: DataFrame, **kw) -> DataFrame:
    """Chunk table with its relevance score."""
    low = compute_once(chunks, "__low", F.lower("chunk"))
    tok = compute_once(low, "__tokens", F.split("__low", r"\W+"))
    return tok.withColumn("score", relevance(F.col("__low"), F.col("__tokens"), **kw)).drop("__low", "__tokens")


def relevant_chunks(scored: DataFrame, doc: str = "doc_id", min_score: float = 0.45, top: int | None = None) -> DataFrame:
    """Chunks of at least ``min_score`` with their rank in the document; all, or the ``top`` best."""
    w = Window.partitionBy(doc).orderBy(F.col("score").desc(), "chunk_index")
    ranked = scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def build_chunk_table(docs: DataFrame, path: str, source: str = "source") -> None:
    """Chunk table with an id per chunk, written partitioned by source."""
    c = section_chunks(docs, keep=("doc_id", source))
    c.withColumn("chunk_id", F.concat_ws("::chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).write.mode(
        "overwrite"
    ).partitionBy(source).parquet(path)


# ---- matching ------------------------------------------------------------


def keyword_matches(docs: DataFrame, rules: Sequence[KeywordRule] = tuple(KEYWORD_RULES), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Hits and PASS / WARN / FAIL of every rule on every document."""
    low = compute_once(docs.select(key, F.col(text).alias("__text")), "t", F.lower("__text"))
    table = F.array(
        *[
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.array(*[F.lit(k.lower()) for k in r.keywords]).alias("keywords"), F.lit(r.min_hits).alias("min_hits"))
            for r in rules
        ]
    )
    found = F.transform(
        table,
        lambda r: F.struct(
            r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), F.size(r["keywords"]).alias("n_keywords"),
            r["min_hits"].alias("min_hits"), F.filter(r["keywords"], lambda k: F.col("t").contains(k)).alias("hits"),
        ),
    )
    n = F.size("r.hits")
    return low.select(key, F.explode(found).alias("r")).select(
        key, "r.rule_id", "r.severity", n.alias("n_hits"), "r.n_keywords", F.concat_ws(", ", "r.hits").alias("found"),
        F.when(n >= F.col("r.min_hits"), "PASS").when(n > 0, "WARN").otherwise("FAIL").alias("status"),
    )


def first_sentence(text: Column, keywords: Sequence[str], limit: int = 200) -> Column:
    """First '.'-separated sentence with any keyword, trimmed to ``limit`` characters."""
    words = [k.lower() for k in keywords]
    return sentence_with(F.lower(text), F.array(*[F.lit(w) for w in words]), limit)


def sentence_with(low: Column, words: Column, limit: int = 200) -> Column:
    """First sentence of lower-cased text with any of ``words``; the text is only split when one occurs."""
    hit = lambda s: F.exists(words, lambda w: s.contains(w))
    first = F.try_element_at(F.filter(F.split(low, r"\."), hit), F.lit(1))
    return F.when(hit(low), F.substring(strip(first), 1, limit))


def quotes(docs: DataFrame, keywords: Sequence[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, first_sentence(F.col(text), keywords).alias("quote")).where("quote is not null")


def document_checks(
    docs: DataFrame, checks: Sequence[DocumentCheck] = tuple(DOCUMENT_CHECKS), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Status and quote of every check on every document."""
    low = compute_once(docs.select(key, F.col(text).alias("__text")), "t", F.lower("__text"))
    table = F.array(
        *[
            F.struct(
                F.lit(c.id).alias("check_id"), F.lit(c.stage).alias("stage"), F.lit(c.severity).alias("severity"),
                F.lit(c.otherwise).alias("otherwise"), F.array(*[F.lit(k) for k in c.keywords]).alias("keywords"),
            )
            for c in checks
        ]
    )
    found = F.transform(
        table,
        lambda c: F.struct(
            c["check_id"].alias("check_id"), c["stage"].alias("stage"), c["severity"].alias("severity"), c["otherwise"].alias("otherwise"),
            sentence_with(F.col("t"), c["keywords"]).alias("quote"),
        ),
    )
    return low.select(key, F.explode(found).alias("r")).select(
        key, "r.check_id", "r.stage", "r.severity", F.when(F.col("r.quote").isNotNull(), "PASS").otherwise(F.col("r.otherwise")).alias("status"), "r.quote"
    )


def stated_metrics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Metrics stated in a document: first pattern whose value lies in 0.01..1, null when none."""
    low = compute_once(docs.select(key, F.col(text).alias("__text")), "t", F.lower("__text"))

    def first_value(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)), lambda v: v.try_cast("double"))
        return F.try_element_at(F.filter(found, lambda v: v.between(0.01, 1.0)), F.lit(1))

    return low.select(key, *[F.round(F.coalesce(*[first_value(p) for p in ps]), 4).alias(m) for m, ps in METRIC_PATTERNS])


# ---- retrieval -----------------------------------------------------------

#: Query vectors that travel with a task, and rows of a block of vectors that meets a block of queries.
QUERIES_AT_ONCE = 1000
VECTORS_PER_BLOCK = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Best:
    """The ``k`` most similar ids per query, from batch to batch; ties to the smaller id."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(q), [np.zeros(0)] * len(q)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, k, s = len(ids), self.k, _unit(x) @ self.q.T
        for j in range(s.shape[1]):
            new = np.flatnonzero(s[:, j] >= np.partition(s[:, j], n - k)[n - k]) if n > k else np.arange(n)
            i, v = np.concatenate((self.ids[j], ids[new])), np.concatenate((self.scores[j], s[new, j]))
            order = np.lexsort((i, -v))[:k]
            self.ids[j], self.scores[j] = i[order], v[order]

    def columns(self) -> list[np.ndarray]:
        """Place of the query, id and similarity."""
        at = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        return [at, np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.scores])]


def nearest(
    vectors: DataFrame, queries: DataFrame | Sequence[tuple[object, Sequence[float]]], k: int = TOP_K, key: str = "vec_id", vec: str = "embedding", at_once: int = QUERIES_AT_ONCE
) -> DataFrame:
    """The ``k`` vectors of highest cosine similarity per query vector.

    ``queries`` are a list, or a table of any size (name and vector). Up to ``at_once`` of them travel with the
    tasks: every Arrow batch of vectors is one matrix product, and a task carries its best ``k`` per query from batch to
    batch. More are dealt into blocks that meet blocks of vectors, each pair of blocks with its own best ``k``.
    """
    ranked = Window.partitionBy("query").orderBy(F.col("similarity").desc(), key)
    done = lambda best: best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query", key, F.round("similarity", 6).alias("similarity"), "rank")
    some = queries
    if isinstance(queries, DataFrame):
        name, of = queries.columns
        table = queries.select(F.col(name).alias("query"), F.col(of).cast("array<double>").alias("v"))
        some = [(r["query"], r["v"]) for r in table.limit(at_once + 1).collect()]
    elif len(queries) > at_once:
        parts = [nearest(vectors, queries[i : i + at_once], k, key, vec, at_once) for i in range(0, len(queries), at_once)]
        return reduce(DataFrame.unionByName, parts)
    dim = len(some[0][1]) if some else 0
    ok = vectors.where(F.size(vec) == dim).select(F.col(key).cast("bigint").alias(key), F.col(vec).cast("array<double>").alias(vec))
    if len(some) <= at_once:
        names, q = [x for x, _ in some], _unit(np.array([v for _, v in some], dtype=float).reshape(len(some), dim))

        def local(batches):
            best = _Best(q, k)
            for b in batches:
                if b.num_rows:
                    best.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dim))
            at, ids, scores = best.columns()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(ids), pa.array(scores)], names=["__q", key, "similarity"])

        label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__q") + 1) if names else F.lit(None)
        return done(ok.mapInArrow(local, f"__q int, {key} bigint, similarity double").select(label.alias("query"), key, "similarity"))
    q_blocks, v_blocks = -(-table.count() // at_once), max(1, -(-ok.count() // VECTORS_PER_BLOCK))
    dealt = lambda df, own, n, other, m: df.select("*", F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    kind = table.schema["query"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = lambda t, c: np.array(t.column(c).to_pylist(), dtype=float).reshape(t.num_rows, dim)
        best = _Best(_unit(rows(left, "v")), k)
        if right.num_rows and left.num_rows:
            best.add(right.column(key).to_numpy(), rows(right, vec))
        at, ids, scores = best.columns()
        return pa.table([left.column("query").take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query", key, "similarity"])

    left = dealt(table.where(F.size("v") == dim), "b", q_blocks, "c", v_blocks).groupBy("b", "c")
    right = dealt(ok, "c", v_blocks, "b", q_blocks).groupBy("b", "c")
    return done(left.cogroup(right).applyInArrow(meet, f"query {kind}, {key} bigint, similarity double"))


def centroids(vectors: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group as query vectors: the group and ``centroid``."""
    parts = vectors.select(group, F.posexplode(vec).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
