"""Registered queries of the corpus operators; each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanforge.llm import alignment, bpe, decontaminate, divergence, extract, language, lines, near, pii, repeats, secrets, urls, vafile
from loanforge.llm.common import table
from loanforge.plans.registry import Registry

REG = Registry()

RANKS = "byte_bpe_multi_50k.tiktoken"


@REG.query("op4_byte_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=False, digests=True)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP1_SQL = f"""
with it as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
iw as (select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') win
       from (select item, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from it where len(w) > 0)),
d as (select row_number() over () r, doc_id, coalesce({_WORDS}, []) w from documents),
dw as (select r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') win
       from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from iw) where len(w) >= k)),
m as (select dw.r, dw.i, dw.k, iw.item from dw join iw on dw.win = iw.win and dw.k = iw.k),
hit as (select r, count(*) n from (select distinct r, unnest(range(i, i + k)) p from m) group by r),
its as (select r, count(distinct item) n, string_agg(distinct item, ',' order by item) s from m group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items,
       sha256(coalesce(its.s, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit using (r) left join its using (r)"""


@REG.query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@REG.query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@REG.query("op2_secret_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = secrets.scan(docs, secrets.fit(docs))
    of = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    base = F.filter("secrets", lambda s: s["kind"] != secrets.LEARNED)
    return out.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS], F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans")
    )


_OP3_SQL = """
with v as (select vec_id, [floor(64 * cast(x as double)) for x in embedding] e from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
select query, cast(row_number() over (partition by query order by score desc, vec_id) as int) rank, vec_id, score
from s qualify row_number() over (partition by query order by score desc, vec_id) <= 20"""


@REG.query("op3_vector_search", _OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


_OP7_SQL = """
with d as (select row_number() over () r, doc_id, source, text, string_split(text, chr(10)) ls from documents),
l as (select r, source, i, ls[i] t, trim(ls[i], ' ') n from d, unnest(range(1, len(ls) + 1)) u(i)),
b as (select n from l where n <> '' group by n having count(distinct source) >= 10),
m as (select r, i, t, n, n in (select n from b) gone from l),
g as (select r, count(*) filter (gone) n_gone, count(*) filter (not gone and n <> '') own,
             string_agg(t, chr(10) order by i) filter (not gone) kept, count(*) c from m group by r)
select doc_id, cast(coalesce(c, 0) as bigint) n_lines, cast(case when own > 0 then n_gone else 0 end as bigint) n_removed,
       sha256(coalesce(case when own > 0 and n_gone > 0 then kept else text end, '')) kept_sha256
from d left join g using (r)"""


@REG.query("op7_line_dedup", _OP7_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    out = lines.remove_boilerplate(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


URL_RULES = [
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
]


@REG.query("op6_url_filter")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    out = urls.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@REG.query("op9_repeated_bytes")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    out = repeats.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    lost = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", lost.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_OP8_SQL = f"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r as (select doc_id, doc_id o from w union select r.doc_id, l.b from r join l on l.a = r.o),
c as (select doc_id, min(o) m from r group by doc_id)
select doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c.m component_id, c.m = doc_id kept from w left join n using (doc_id) join c using (doc_id)"""


@REG.query("op8_near_duplicates", _OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return near.components_of(table(spark, sf, "documents").select("doc_id", "text"))


@REG.query("op10_personal_data")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf, "documents").select("doc_id", "text"), mask=False)
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("pii", lambda s: s["kind"] != pii.TERM)
    return out.select("doc_id", *[of(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


_OP13_SQL = f"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') t from documents),
w as (select row_number() over () r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
k as (select lang, term, count(*) n from (select lang, term, count(*) c from (select row_number() over () r, * from d) x, unnest(list_distinct(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) u(term) group by lang, term having count(*) >= 30) join w using (lang, term) group by lang, term),
v as (select lang, count(*) v, cast(sum(n) as hugeint) total from k group by lang),
s as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from w join k using (lang, term) group by all),
g as (select s.lang, s.source, cast(coalesce(sum(c.n), 0) as hugeint) total from s left join c on c.lang = s.lang and c.source = s.source group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5) // (g.total + 5 * v.v) p,
             1 + cast(1000000000 as hugeint) * (k.n + 5) // (v.total + 5 * v.v) q
      from g join k on k.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
a as (select x.lang, x.source, 'pair' part, y.source item, cast(coalesce(f.f, 0) as bigint) as "value" from s x join s y on x.lang = y.lang and x.source <> y.source
      left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
      union all select lang, source, 'term', term, cast(p - q as bigint) from p where n > 0 and p > q)
select lang, source, part, item, "value", cast(row_number() over (partition by lang, source, part order by "value" desc, item) as int) rank
from a qualify part = 'pair' or row_number() over (partition by lang, source, part order by "value" desc, item) <= 50"""


@REG.query("op13_source_divergence", _OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents").select("text", "lang", "source"))


@REG.query("op12_token_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf, "documents"), *paths, groups=False, digests=True)


@REG.query("op11_main_text")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extract.extract(pages, extract.fit(pages))
