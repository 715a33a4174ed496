"""URL filter: prefix rules, and for other URLs the ratio of two character language models.

URLs that an allow or block rule decides are the labelled examples. From them two
variable-order Markov models of characters are counted. Each order is smoothed with the next
lower one by the number of times its context was seen, ``(count + LAMBDA * lower) / (context +
LAMBDA)``, down to counts of single characters plus one over ``ALPHABET``. So a character never seen
after a context that is common in one class speaks against that class, and an unseen context
leaves the lower order as it is. The mean log ratio per character, compared with a limit calibrated on labelled URLs
that were held back, is the verdict for URLs without a rule.

DataFrame operations only. The model is one aggregation over character 4-grams and keeps
exact counts per string and per context of every order in a table that grows with the corpus. URLs
are scored by joins: different strings of the different URLs meet the counts, then every
URL meets its strings. Strings that hold at least one in ``HOT`` of all places are at most
``HOT`` rows and travel with the pass, so no join has a hot key.

Results: a null URL or one without ``://`` has empty host and path and no rule; the method
reads whatever text there is, and an empty text scores 0. Without labelled URLs of
both kinds the method allows. Among rules of equal length the first in order wins.
Repeated rows get repeated results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.llm.common import stored

HOT = 10_000
#: Scores are summed as whole numbers of this unit, so the order of a sum does not matter.
_UNIT = 1e-9
LAMBDA = 2.0
ALPHABET = 256
_BINS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(text, _PARTS, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null when none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: -len(r.text))[::-1]:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _characters(url: Column) -> Column:
    """Characters after three start marks, A-Z lower-cased, the scheme left out."""
    text = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), _UPPER, _LOWER)
    return F.concat(F.array(*[F.lit("")] * 3), F.filter(F.split(text, ""), lambda c: c != ""))


def _grams(chars: Column) -> Column:
    """Every character with the three before it, as one string; only at the start it is shorter than four."""
    positions = F.when(F.size(chars) > 3, F.sequence(F.lit(3), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.concat(*[F.get(chars, i - k) for k in (3, 2, 1, 0)]))


def _last(g: Column, order: int) -> Column:
    return g if order == 4 else F.right(g, F.lit(order))


def _before(g: Column, order: int) -> Column:
    """Context of the last character; shorter than ``order - 1`` only at the start."""
    return F.expr("substring(g, 1, length(g) - 1)") if order == 4 else F.right(F.expr("substring(g, 1, length(g) - 1)"), F.lit(order - 1))


#: Parts of a 4-gram that are counted: endings of 1 to 4 characters, and the contexts of the last character.
_KINDS = {f"s{k}": lambda g, k=k: _last(g, k) for k in (1, 2, 3, 4)} | {f"c{k}": lambda g, k=k: _before(g, k) for k in (2, 3, 4)}


@dataclass
class Model:
    """Counts by class (``kind``: s1 to s4 for strings, c2 to c4 for contexts; ``g``, ``a``, ``b``), their totals, and the limit below which the method blocks."""

    counts: DataFrame | None
    totals: tuple[int, int]
    limit: float

    def strings(self, grams: DataFrame) -> DataFrame:
        """``g``, its number ``n`` and the log ratio ``r`` of its last character's probabilities."""
        out = grams.groupBy("g").agg(F.count("*").alias("n"))
        for kind, part in _KINDS.items():
            own = self.counts.where(F.col("kind") == kind).select(F.col("g").alias("__s"), F.col("a").alias(f"a_{kind}"), F.col("b").alias(f"b_{kind}"))
            out = out.join(own, part(F.col("g")) == F.col("__s"), "left").drop("__s")
        p = []
        for x, total in zip("ab", self.totals):
            n = lambda kind: F.coalesce(F.col(f"{x}_{kind}"), F.lit(0))  # noqa: B023, E731
            q = (n("s1") + 1) / F.lit(float(total + ALPHABET))
            for k in (2, 3, 4):
                q = (n(f"s{k}") + LAMBDA * q) / (n(f"c{k}") + LAMBDA)
            p.append(q)
        return out.select("g", "n", F.round(F.log(p[0] / p[1]) / _UNIT).cast("bigint").alias("r"))


def _ids(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(17), text).alias("__b")]


def _scored(urls: DataFrame, url: str, model: Model) -> DataFrame:
    """``urls`` with ``__score``, the mean over the characters."""
    if model.counts is None:
        return urls.withColumn("__score", F.lit(0.0))
    text = F.coalesce(F.col(url), F.lit(""))
    texts = stored(urls.select(text.alias("u")).distinct(), "urls")
    chars = texts.select(*_ids(F.col("u")), _characters(F.col("u")).alias("__chars"))
    grams = chars.select("__a", "__b", F.explode(_grams(F.col("__chars"))).alias("g"))
    known = stored(model.strings(grams), "url-strings")
    places = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= places
    often, rest = known.where(hot).select("g", "r"), known.where(~hot).select("g", "r")
    marked = grams.join(F.broadcast(often), "g", "left")
    parts = marked.where("r is not null").unionByName(marked.where("r is null").drop("r").join(rest, "g"))
    sums = stored(parts.groupBy("__a", "__b").agg(F.sum("r").alias("__sum")), "url-sums")
    a, b = _ids(text)
    rows = urls.withColumns({"__a": a, "__b": b}).join(sums, ["__a", "__b"], "left")
    n = F.greatest(F.size(_characters(F.col(url))) - 3, F.lit(1))
    return rows.withColumn("__score", F.coalesce("__sum", F.lit(0)) * _UNIT / n).drop("__a", "__b", "__sum")


def fit(urls: DataFrame, url: str, verdict: str) -> Model:
    """Learn from rows whose ``verdict`` is allow or block; a quarter of the URLs, by checksum, sets the limit."""
    labelled = urls.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull()).select(F.col(url).alias("u"), (F.col(verdict) == "allow").cast("int").alias("ok"))
    back = F.crc32(F.col("u").cast("binary")) % 4 == 0
    chars = labelled.where(~back).select("ok", _characters(F.col("u")).alias("__chars"))
    rows = chars.select("ok", F.explode(_grams(F.col("__chars"))).alias("g"))
    grams = rows.groupBy("g").agg(F.sum("ok").alias("a4"), F.sum(1 - F.col("ok")).alias("b4"))
    sizes = grams.agg(F.sum("a4").alias("a"), F.sum("b4").alias("b")).first()
    if not sizes["a"] or not sizes["b"]:
        return Model(None, (0, 0), 0.0)
    parts = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), part(F.col("g")).alias("g")) for kind, part in _KINDS.items()]))
    counts = grams.select(parts.alias("s"), "a4", "b4").groupBy("s.kind", "s.g").agg(F.sum("a4").alias("a"), F.sum("b4").alias("b"))
    model = Model(stored(counts, "url-counts"), (sizes["a"], sizes["b"]), 0.0)
    bins = F.floor(F.greatest(F.least(F.col("__score"), F.lit(5.0)), F.lit(-5.0)) * _BINS).cast("int")
    held = {r["b"]: (r["a"], r["r"]) for r in _scored(labelled.where(back), "u", model).groupBy(bins.alias("b")).agg(F.sum("ok").alias("a"), F.sum(1 - F.col("ok")).alias("r")).collect()}
    good, bad = (sum(v[j] for v in held.values()) for j in (0, 1))
    if good and bad:
        gain = lambda t: sum(v[1] for b, v in held.items() if b < t) / bad + sum(v[0] for b, v in held.items() if b >= t) / good
        model.limit = max(range(-5 * _BINS, 5 * _BINS + 1), key=lambda t: (round(gain(t), 9), -abs(t), t)) / _BINS
    return model


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """All columns of ``urls`` and ``host``, ``path``, ``rule``, ``score``, ``verdict``, which replace columns of those names."""
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = host_path(F.col(url))
    parts = urls.withColumns({"__host": host, "__path": path})
    rule, verdict = matching_rule(F.col("__host"), F.col("__path"), rules)
    ruled = parts.withColumns({"__rule": rule, "__verdict": verdict})
    model = fit(ruled, url, "__verdict")
    method = F.when(F.col("__score") < model.limit, "block").otherwise("allow")
    out = _scored(ruled, url, model)
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__score").alias("score"), F.coalesce("__verdict", method).alias("verdict"))
