"""Personal data: fixed patterns, and terms that give a protected entity away.

Patterns find emails, IP addresses, card and phone numbers with their code point
positions. The values found are the protected entities. Every word of a text that holds an
entity, of any length and with letters or digits, is counted with it over the corpus, and a word is measured by the information it
gives: the share ``p(entity | word)`` of the documents with the word, and
its ratio to ``p(entity)`` in bits. A word that is seen with an entity in at least ``SUPPORT``
different texts and passes the limits is a disclosing term in every document that
holds the entity: generalised from ``GENERALISE`` on, removed from ``REMOVE`` on.

DataFrame operations only. Patterns use possessive quantifiers, which match the same
strings without recursion. Entities in fewer than ``SUPPORT`` different texts, or in too many
documents for the bits limit, can have no disclosing term and drop out first. Each different
text is then paired once, with its number of documents; pairs of entity and word are counted
before they meet the document frequencies; texts are joined only with the terms found for them.

Results: a null text is empty; rows with equal key and text share their terms; exact copies of
a text are one text of the support; spans are sorted by kind, then start, end exclusive;
other columns pass through ``sanitise``; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanforge.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SUPPORT = 2
GENERALISE = 0.5
REMOVE = 0.9
LEAST_BITS = 3.0
WORD = r"[\p{L}\p{N}]++"
#: Numbers folded at a time, and code points of a piece of text, so that one long text costs time in proportion to it.
FOLD = 256
PIECE = 512

#: kind: (a character every match has, pattern). A match starts where its run of first characters starts or where the last match ended.
PATTERNS = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["odd"], 1).otherwise(2)
        return F.struct((acc["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~acc["odd"]).alias("odd"))

    one = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    total = F.aggregate(one, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add, lambda a: a["sum"])
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _bound(fn: Callable[[Column], Column], **values: Column) -> Column:
    """``fn`` of a struct whose fields are computed once, also where ``fn`` uses them inside lambdas."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def _before(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For every number what ``combine`` makes of those before it, from ``zero`` on; by blocks, as an array that grows is copied each time."""

    def fold(xs: Column, at: Column, step: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def by_blocks(t: Column) -> Column:
        offsets = fold(t["b"], F.lit(zero), lambda at, b: F.aggregate(b, at, combine))
        return F.flatten(F.zip_with(t["b"], offsets, lambda b, at: fold(b, at, combine)))

    def cut(s: Column) -> Column:
        last = F.greatest(F.floor((F.size(s["v"]) - 1) / FOLD), F.lit(0)).cast("int")
        return _bound(by_blocks, b=F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(s["v"], k * FOLD + 1, F.lit(FOLD))))

    return _bound(cut, v=values)


def _sum(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def located(text: Column, pattern: str, kind: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Matches of ``pattern``, of those ``wanted``, with code point positions: the texts between matches say where they are."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(between, found, lambda p, f: F.struct(F.length(p).alias("skip"), f.alias("value")))

    def placed(s: Column) -> Column:
        at = _before(F.transform(s["x"], lambda x: (x["skip"] + F.coalesce(F.length(x["value"]), F.lit(0))).cast("int")), _sum, 0)
        span = lambda x, a: F.struct(F.lit(kind).alias("kind"), (a + x["skip"]).cast("int").alias("start"), (a + x["skip"] + F.length(x["value"])).cast("int").alias("stop"), x["value"].alias("value"))
        keep = lambda y: y["value"].isNotNull() if wanted is None else y["value"].isNotNull() & wanted(y["value"])
        return F.filter(F.zip_with(s["x"], at, span), keep)

    return _bound(placed, x=both)


def _clear(words: Column, spans: Column) -> Column:
    """Those of ``words`` that overlap none of ``spans``."""
    event = lambda of_word: lambda s: F.struct(s["start"].alias("start"), F.lit(of_word).alias("word"), s["stop"].alias("stop"), s.alias("s"))
    far = 2**31 - 1

    def kept(t: Column) -> Column:
        until = _before(F.transform(t["e"], lambda e: F.when(e["word"], 0).otherwise(e["stop"])), _larger, 0)
        begin = F.reverse(_before(F.reverse(F.transform(t["e"], lambda e: F.when(e["word"], far).otherwise(e["start"]))), _smaller, far))
        free = F.zip_with(t["e"], F.arrays_zip(until.alias("u"), begin.alias("b")), lambda e, n: F.when(e["word"] & (n["u"] <= e["start"]) & (n["b"] >= e["stop"]), e["s"]))
        return F.filter(free, lambda s: s.isNotNull())

    return _bound(kept, e=F.array_sort(F.concat(F.transform(spans, event(False)), F.transform(words, event(True)))))


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by kind, then start."""
    none = F.array().cast(_SPANS)

    def of(kind: str) -> Column:
        has, pattern = PATTERNS[kind]
        return F.when(text.rlike(has), F.filter(located(text, pattern, kind), lambda s: _valid(kind, s["value"]))).otherwise(none)

    return F.concat(*map(of, KINDS))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def found_in(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key ``__k``, text hash ``__t``, pattern ``spans`` and, where there are any, the different words outside them."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("__k"), F.xxhash64(t).alias("__t"), t.alias("__text"), base_spans(t).alias("spans"))
    blank = F.transform("spans", lambda s: F.struct(F.lit(" ").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit("").alias("value")))
    cut = masked(F.col("__text"), blank)
    return stored(rows.select("__k", "__t", "spans", F.when(F.size("spans") > 0, _words(cut)).alias("words")), "pii")


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, least_bits: float = LEAST_BITS) -> DataFrame:
    """``kind``, ``value``, ``term``, ``share``, ``bits`` and ``action`` of terms that pass the limits."""
    entity = ["kind", "value"]
    total = docs.count()
    with_any = found.where("words is not null")
    copies = with_any.select("__k", "__t").distinct().groupBy("__t").agg(F.count("*").alias("m"))
    texts = with_any.select("__t", F.explode("spans").alias("s")).select("__t", "s.kind", "s.value").distinct().join(copies, "__t")
    held = texts.groupBy(*entity).agg(F.sum("m").alias("n_entity"), F.count("*").alias("texts"))
    held = stored(held.where((F.col("texts") >= support) & (F.col("n_entity") <= total / 2.0**least_bits)).drop("texts"), "pii-entities")
    most = held.agg(F.max("n_entity")).first()[0] or 0
    # A term's share is at most n_entity / n_term: words too common for any entity go before words and entities are paired.
    seen = docs.select(F.explode(_words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") * generalise <= most)
    wanted = texts.join(held, entity).groupBy("__t").agg(F.first("m").alias("m"), F.collect_list(F.struct(*entity, "n_entity")).alias("es"))
    words = with_any.select("__t", "words").join(wanted.select("__t"), "__t", "left_semi").dropDuplicates(["__t"])
    rare = words.select("__t", F.explode("words").alias("term")).join(seen, "term")
    pairs = rare.join(wanted, "__t").select("m", "term", "n_term", F.explode(F.filter("es", lambda e: F.col("n_term") * generalise <= e["n_entity"])).alias("e")).select("m", "term", "n_term", "e.*")
    pairs = pairs.groupBy(*entity, "term").agg(F.sum("m").alias("n_both"), F.count("*").alias("texts"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).where(F.col("texts") >= support)
    share = F.col("n_both") / F.col("n_term")
    bits = F.log2(share * total / F.col("n_entity"))
    out = pairs.withColumns({"share": share, "bits": bits}).where((F.col("share") >= generalise) & (F.col("bits") >= least_bits))
    return out.select(*entity, "term", "share", "bits", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with patterns and generalised terms named in angle brackets and removed terms left out."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def part(t: Column, a: Column, b: Column) -> Column:
        """Code points ``a`` to ``b``: only the pieces around them are read."""
        first = F.floor(a / PIECE).cast("int")
        near = F.array_join(F.slice(t["pieces"], first + 1, F.greatest(F.ceil(b / PIECE).cast("int") - first, F.lit(0))), "")
        return F.substring(near, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    def joined(t: Column) -> Column:
        mark = lambda s: F.when(s["value"] == "remove", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(part(t, at, s["start"]), mark(s))).otherwise("")
        end = F.coalesce(F.array_max(F.transform(t["s"], lambda s: s["stop"])), F.lit(0))
        return F.concat(F.array_join(F.zip_with(t["s"], _before(F.transform(t["s"], lambda s: s["stop"]), _larger, 0), piece), ""), part(t, end, t["size"]))

    return _bound(joined, s=by_start, pieces=F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), size=F.length(text))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: bool = True, **limits: float) -> DataFrame:
    """``docs`` with ``pii`` (kind, start, stop, value; for terms the action), which replaces a column of that name, and, with ``mask``, the masked text."""
    docs = docs.drop("pii")
    found = found_in(docs, key, text)
    terms = disclosing_terms(docs, found, text, **limits)
    held = found.where("words is not null").select("__k", "__t", F.explode("spans").alias("s")).select("__k", "__t", "s.kind", "s.value").distinct()
    mine = held.join(terms, ["kind", "value"]).groupBy("__k", "__t", "term").agg(F.max("action").alias("action")).groupBy("__k", "__t").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("__terms"))
    extra = mine.select(F.col("__k").alias("__ek"), F.col("__t").alias("__et"), "__terms")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"__h": F.xxhash64(t), "__spans": base_spans(t)})
    rows = rows.join(extra, F.col(key).eqNullSafe(F.col("__ek")) & (F.col("__h") == F.col("__et")), "left")
    action = lambda w: F.try_element_at("__terms", F.lower(w))
    said = _clear(located(t, WORD, TERM, lambda v: action(v).isNotNull()), F.col("__spans"))
    said = F.transform(said, lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["stop"].alias("stop"), action(w["value"]).alias("value")))
    rows = rows.withColumn("__pii", F.concat("__spans", F.when(F.col("__terms").isNotNull(), said).otherwise(F.array().cast(_SPANS))))
    cols = [F.when(F.size("__pii") > 0, masked(t, F.col("__pii"))).otherwise(F.col(c)).alias(c) if mask and c == text else F.col(c) for c in docs.columns]
    return rows.select(*cols, F.col("__pii").alias("pii"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
