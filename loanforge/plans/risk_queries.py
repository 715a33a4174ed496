"""Join, macro, exposure and stress queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loanforge.operators import exposure as ex
from loanforge.operators import joins as jn
from loanforge.operators import keys, macro, stress
from loanforge import workflows
from loanforge.plans.data_queries import union
from loanforge.plans.evaluation_queries import _temporal, settle_sql
from loanforge.plans.fixtures import LOANS, MACRO, SCORED, loans, macro_series, scored_loans
from loanforge.plans.prep_queries import SPLIT, split_scored
from loanforge.plans.registry import Registry
from loanforge.sources.readers import load_table

REG = Registry()
#: Whole tables with the types of all their columns.
STAR_TYPES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
}
NUMBERS = ("int", "bigint", "double")


def star(spark, d):
    return {t: load_table(spark, d, t) for t in STAR_TYPES}


_ALL = [(t, c) for t, cols in STAR_TYPES.items() for c in cols]
_OF = {c: x for cols in STAR_TYPES.values() for c, x in cols.items()}
_PK = union(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count(DISTINCT {c}) AS u, count(*)-count({c}) AS m FROM {t}" for t, c in _ALL
)
_DTYPE = "CASE " + " ".join(f"WHEN c='{c}' THEN '{x}'" for c, x in _OF.items()) + " END"


@REG.query(
    "d1_primary_keys",
    f"""WITH p AS ({_PK}) SELECT t AS "table", c AS "column", n AS row_count, u AS unique_count, 1.0::DOUBLE AS unique_pct, m AS missing_count, {_DTYPE} AS dtype FROM p WHERE m=0 AND u=n""",
)
def _(spark, d):
    return keys.primary_key_table(star(spark, d))


_SIM = ",".join(
    f"('{t}','{c}','{pt}','{p}',{keys.name_similarity(c, p)!r}::DOUBLE,{'true' if (_OF[c] in NUMBERS) == (_OF[p] in NUMBERS) else 'false'})"
    for t, c in _ALL for pt, p in _ALL if pt != t
)
_REL = f"""WITH p AS ({_PK}), pk AS (SELECT t, c FROM p WHERE m=0 AND u=n),
 v AS ({union(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3" for t, c in _ALL)}),
 st AS (SELECT t, c, count(*) AS dc, sum(n) AS rc FROM v GROUP BY 1,2),
 h AS (SELECT f.t AS ft, f.c AS fc, k.t AS pt, k.c AS pc, count(*) AS m FROM v f JOIN v k ON f.v=k.v AND f.t<>k.t JOIN pk ON pk.t=k.t AND pk.c=k.c GROUP BY 1,2,3,4),
 sim(ft, fc, pt, pc, s, ok) AS (VALUES {_SIM}),
 sc AS (SELECT h.ft, h.fc, h.pt, h.pc, m/dc::DOUBLE AS overlap, CASE WHEN rc>dc THEN '1:many' ELSE '1:1' END AS cardinality,
   greatest(0, least(1, 0.55::DOUBLE*(m/dc::DOUBLE)+0.20::DOUBLE+CASE WHEN ok THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END+0.10::DOUBLE*s)) AS conf
   FROM h JOIN st ON st.t=h.ft AND st.c=h.fc JOIN sim ON sim.ft=h.ft AND sim.fc=h.fc AND sim.pt=h.pt AND sim.pc=h.pc),
 ok AS (SELECT * FROM sc WHERE conf>=0.2)
"""


@REG.query("d2_foreign_key_scores", _REL + "SELECT ft AS fk_table, fc AS fk_column, pt AS pk_table, pc AS pk_column, round(overlap,4) AS overlap, cardinality, round(conf,4) AS confidence FROM sc")
def _(spark, d):
    tables = star(spark, d)
    s = keys.foreign_key_scores(tables, {t: [c for c, _ in v] for t, v in keys.primary_keys(tables).items() if v})
    return s.withColumns({"overlap": F.round("overlap", 4), "confidence": F.round("confidence", 4)})


@REG.query(
    "d3_relationships",
    _REL + """SELECT ft AS fk_table, fc AS fk_column, pt AS pk_table, pc AS pk_column, round(overlap,4) AS overlap, cardinality, round(conf,3) AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY ft, fc ORDER BY round(conf,9) DESC, pt, pc) AS rn FROM ok) WHERE rn=1""",
)
def _(spark, d):
    return keys.relationships(star(spark, d))[1]


@REG.query(
    "d3_key_confidence",
    _REL + """, r AS (SELECT pt, pc, max(overlap) AS o FROM ok GROUP BY 1,2) SELECT t AS "table", c AS "column", round(coalesce(least(0.99::DOUBLE, 0.80::DOUBLE+0.19::DOUBLE*o),0.80::DOUBLE),3) AS confidence, o IS NOT NULL AS referenced
 FROM pk LEFT JOIN r ON r.pt=pk.t AND r.pc=pk.c""",
)
def _(spark, d):
    return keys.relationships(star(spark, d))[0]


def _join_tables(spark, d):
    o = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"))
    c = load_table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"), F.col("c_nationkey").alias("nationkey"))
    n = load_table(spark, d, "nation").select(F.col("n_nationkey").alias("nkey"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    r = load_table(spark, d, "region").select(F.col("r_regionkey").alias("rkey"), F.col("r_name").alias("name"))
    return o, {"customer": c, "nation": n, "region": r}


_SPECS = [jn.JoinSpec("customer", "custkey", "custkey"), jn.JoinSpec("nation", "nationkey", "nkey"), jn.JoinSpec("region", "regionkey", "rkey", "inner")]


@REG.query(
    "d4_left_join_suffix",
    "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS amount, c_acctbal AS amount_customer, c_nationkey AS nationkey FROM orders LEFT JOIN customer ON o_custkey=c_custkey",
)
def _(spark, d):
    o, t = _join_tables(spark, d)
    return jn.join_step(o, t["customer"], _SPECS[0])


@REG.query(
    "d5_join_report",
    """WITH l AS (SELECT c_custkey AS k, count(*) AS nl FROM customer GROUP BY 1), r AS (SELECT o_custkey AS k, count(*) AS nr FROM orders GROUP BY 1),
 b AS (SELECT l.k AS lk, r.k AS rk, coalesce(nl,0) AS nl, coalesce(nr,0) AS nr FROM l FULL JOIN r ON l.k=r.k),
 s AS (SELECT sum(nl) AS rb, sum(nl*nr) AS m, coalesce(sum(nl) FILTER (rk IS NULL),0) AS u, count(*) FILTER (lk IS NULL AND rk IS NOT NULL) AS o,
   coalesce(sum(nl) FILTER (nl>1),0) AS dl, coalesce(sum(nr) FILTER (nr>1),0) AS dr FROM b)
 SELECT 'orders' AS right_table, 'c_custkey' AS left_key, 'o_custkey' AS right_key, 'left' AS how, CAST(rb AS BIGINT) AS rows_before, CAST(m+u AS BIGINT) AS rows_after, CAST(u AS BIGINT) AS unmatched_left,
 o AS orphan_right, CAST(dl AS BIGINT) AS duplicate_left_keys, CAST(dr AS BIGINT) AS duplicate_right_keys, m+u>rb AS fan_out FROM s""",
)
def _(spark, d):
    return jn.join_report(load_table(spark, d, "customer"), load_table(spark, d, "orders"), jn.JoinSpec("orders", "c_custkey", "o_custkey"))


@REG.query(
    "d6_star_integration",
    """SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS amount, c_acctbal AS amount_customer, c_nationkey AS nationkey, n_nationkey AS nkey, n_name AS name,
 n_regionkey AS regionkey, r_regionkey AS rkey, r_name AS name_region FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)
def _(spark, d):
    o, t = _join_tables(spark, d)
    return jn.integrate(o, t, _SPECS)


def _step_sql(step: int, left: str, lk: str, right: str, table: str, rk: str, named: str, how: str) -> str:
    miss = "u" if how == "left" else "0"
    return f"""SELECT '{named}' AS right_table, '{lk}' AS left_key, '{rk}' AS right_key, '{how}' AS how, CAST(rb AS BIGINT) AS rows_before, CAST(m+{miss} AS BIGINT) AS rows_after, CAST({miss} AS BIGINT) AS unmatched_left,
 o AS orphan_right, CAST(dl AS BIGINT) AS duplicate_left_keys, CAST(dr AS BIGINT) AS duplicate_right_keys, m+{miss}>rb AS fan_out, {step} AS step FROM (
 SELECT sum(coalesce(nl,0)) AS rb, sum(coalesce(nl,0)*coalesce(nr,0)) AS m, coalesce(sum(nl) FILTER (rk IS NULL),0) AS u, count(*) FILTER (lk IS NULL AND rk IS NOT NULL) AS o,
  coalesce(sum(nl) FILTER (nl>1),0) AS dl, coalesce(sum(nr) FILTER (nr>1),0) AS dr FROM (SELECT {lk} AS lk, count(*) AS nl FROM {left} GROUP BY 1) l
 FULL JOIN (SELECT {right} AS rk, count(*) AS nr FROM {table} GROUP BY 1) r ON lk=rk)"""


_JOINED = """j0 AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS amount FROM orders),
 j1 AS (SELECT j0.*, c_acctbal AS amount_customer, c_nationkey AS nationkey FROM j0 LEFT JOIN customer ON custkey=c_custkey),
 j2 AS (SELECT j1.*, n_nationkey AS nkey, n_name AS name, n_regionkey AS regionkey FROM j1 LEFT JOIN nation ON nationkey=n_nationkey)"""
_CHAIN = [*_SPECS[:2], jn.JoinSpec("region", "regionkey", "rkey", "inner")]


@REG.query(
    "d6_integration_report",
    f"WITH {_JOINED} " + union([
        _step_sql(1, "j0", "custkey", "c_custkey", "customer", "custkey", "customer", "left"), _step_sql(2, "j1", "nationkey", "n_nationkey", "nation", "nkey", "nation", "left"),
        _step_sql(3, "j2", "regionkey", "r_regionkey", "region", "rkey", "region", "inner"),
    ]),
)
def _(spark, d):
    o, t = _join_tables(spark, d)
    return jn.integration_report(o, t, _CHAIN)


_JOB = ["orderkey", "custkey", "amount", "orderdate", "amount_customer", "nationkey", "nkey", "name", "regionkey", "rkey", "name_region", "macro_avg_price", "macro_order_count"]


@REG.query(
    "d6_integration_job",
    "WITH " + MACRO + """, b AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS amount, o_orderdate AS orderdate, c_acctbal AS amount_customer, c_nationkey AS nationkey, n_nationkey AS nkey, n_name AS name,
  n_regionkey AS regionkey, r_regionkey AS rkey, r_name AS name_region FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
 mo AS (SELECT DISTINCT CAST(date_trunc('month', orderdate) AS DATE) AS mo FROM b),
 a AS (SELECT mo, (SELECT arg_max(value, obs_date) FROM macro WHERE series='avg_price' AND obs_date<=mo) AS macro_avg_price, (SELECT arg_max(value, obs_date) FROM macro WHERE series='order_count' AND obs_date<=mo) AS macro_order_count FROM mo),
 t AS (SELECT b.*, macro_avg_price, macro_order_count FROM b JOIN a ON mo=CAST(date_trunc('month', orderdate) AS DATE)) """
    + union(f"SELECT '{c}' AS \"column\", count(*)-count({c}) AS missing, round((count(*)-count({c}))/count(*)::DOUBLE*100,2) AS missing_pct, count(DISTINCT {c}) AS \"unique\" FROM t" for c in _JOB),
)
def _(spark, d):
    o, t = _join_tables(spark, d)
    o = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("orderdate"))
    made = workflows.integrate_sources(o, t, _CHAIN, macro_series(spark, d), ["avg_price", "order_count"], "orderdate", lookback_days=None)
    return made["profile"].select("column", "missing", "missing_pct", "unique")


_ASOF = "WITH " + MACRO + """, pr AS (SELECT obs_date, value FROM macro WHERE series='avg_price'), oc AS (SELECT obs_date, value FROM macro WHERE series='order_count'),
 m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS mo FROM lineitem)"""


@REG.query(
    "d7_as_of_month",
    _ASOF + """, a AS (SELECT mo, (SELECT arg_max(value, obs_date) FROM pr WHERE obs_date<=mo) AS p, (SELECT arg_max(value, obs_date) FROM oc WHERE obs_date<=mo) AS c FROM m)
 SELECT l_orderkey, l_linenumber, strftime(l_shipdate,'%Y-%m-%d') AS ship, round(p,4) AS macro_avg_price, c AS macro_order_count FROM lineitem JOIN a ON mo=CAST(date_trunc('month', l_shipdate) AS DATE)""",
)
def _(spark, d):
    li = load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    out = macro.attach(li, "l_shipdate", macro_series(spark, d), ["avg_price", "order_count"], lookback_days=None)
    return out.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"), F.round("macro_avg_price", 4).alias("macro_avg_price"), "macro_order_count")


@REG.query(
    "d8_series_as_of",
    _ASOF + """, a AS (SELECT mo, (SELECT arg_max(value, obs_date) FROM oc WHERE obs_date<=mo) AS c FROM m)
 SELECT l_orderkey, l_linenumber, c AS macro_order_count FROM lineitem JOIN a ON mo=CAST(date_trunc('month', l_shipdate) AS DATE)""",
)
def _(spark, d):
    li = load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return macro.attach_one(li, "l_shipdate", macro_series(spark, d), "order_count").drop("l_shipdate")


@REG.query(
    "d9_latest_value",
    "WITH " + MACRO + " SELECT series, round(arg_max(value, obs_date),4) AS value, strftime(max(obs_date),'%Y-%m-%d') AS obs_date FROM macro WHERE obs_date<=DATE '1998-06-30' GROUP BY series",
)
def _(spark, d):
    v = macro.latest_values(macro_series(spark, d), dt.date(1998, 6, 30))
    return v.select("series", F.round("value", 4).alias("value"), F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"))


@REG.query(
    "d10_macro_assembly",
    "WITH " + MACRO + """, dd AS (SELECT DISTINCT obs_date FROM macro) SELECT strftime(obs_date,'%Y-%m-%d') AS obs_date,
 round((SELECT arg_max(value, m.obs_date) FROM macro m WHERE series='avg_price' AND m.obs_date<=dd.obs_date),4) AS avg_price,
 (SELECT arg_max(value, m.obs_date) FROM macro m WHERE series='order_count' AND m.obs_date<=dd.obs_date) AS order_count FROM dd""",
)
def _(spark, d):
    a = macro.assemble(macro_series(spark, d), ["avg_price", "order_count"])
    return a.select(F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"), F.round("avg_price", 4).alias("avg_price"), "order_count")


@REG.query(
    "d11_macro_attach",
    "WITH " + MACRO + """, a AS (SELECT series, obs_date, value FROM macro) SELECT o_orderkey,
 round(p.value,4) AS macro_avg_price, c.value AS macro_order_count FROM orders
 JOIN a p ON p.series='avg_price' AND p.obs_date=CAST(date_trunc('month', o_orderdate) AS DATE)
 JOIN a c ON c.series='order_count' AND c.obs_date=CAST(date_trunc('quarter', o_orderdate) AS DATE)""",
)
def _(spark, d):
    o = load_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = macro.attach(o, "o_orderdate", macro_series(spark, d), ["avg_price", "order_count"])
    return out.select("o_orderkey", F.round("macro_avg_price", 4).alias("macro_avg_price"), "macro_order_count")


# ---- exposure ------------------------------------------------------------

_LID = "l_orderkey, l_linenumber, loan_amount"


def money(c):
    """Half-up to four digits on the eight-digit decimal, the same in both engines."""
    return F.round(F.round(c, 8), 4)


def money_sql(x: str) -> str:
    return f"round(CAST({x} AS DECIMAL(28,8)),4)::DOUBLE"


_BAL = "WITH " + LOANS + """, b AS (SELECT *, months_on_book/12.0::DOUBLE AS t, term_months/12.0::DOUBLE AS n FROM loans),
 c AS (SELECT *, least(t,n) AS m, pow(1+interest_rate,n) AS fn FROM b),
 bal AS (SELECT *, greatest(CASE WHEN interest_rate>1e-9 AND fn<>1 THEN loan_amount*(fn-pow(1+interest_rate,m))/(fn-1) ELSE loan_amount*(1-least(greatest(m/n,0),1)) END,0) AS balance FROM c)"""


@REG.query("h1_outstanding_balance", _BAL + f" SELECT {_LID}, {money_sql('balance')} AS balance FROM bal")
def _(spark, d):
    L = loans(spark, d)
    out = ex.with_outstanding_balance(L, "loan_amount", "interest_rate", F.col("months_on_book") / F.lit(12.0), F.col("term_months") / F.lit(12.0), out="balance")
    return out.select("l_orderkey", "l_linenumber", "loan_amount", money("balance").alias("balance"))


@REG.query(
    "h2_balance_after_payments",
    "WITH " + LOANS + f""", b AS (SELECT *, interest_rate/12.0::DOUBLE AS i, least(months_on_book,term_months)::DOUBLE AS k, term_months::DOUBLE AS n FROM loans)
 SELECT {_LID}, {money_sql("CASE WHEN i>1e-12 AND pow(1+i,n)<>1 THEN loan_amount*(pow(1+i,n)-pow(1+i,k))/(pow(1+i,n)-1) ELSE loan_amount*(1-k/n) END")} AS balance FROM b""",
)
def _(spark, d):
    from loanforge.functions.finance import balance_after_payments

    L = loans(spark, d)
    k = F.least(F.col("months_on_book"), F.col("term_months")).cast("double")
    b = balance_after_payments(F.col("loan_amount"), F.col("interest_rate") / F.lit(12.0), F.col("term_months").cast("double"), k)
    return L.select("l_orderkey", "l_linenumber", "loan_amount", money(b).alias("balance"))


EAD = "WITH " + LOANS + """, b AS (SELECT *, months_on_book/12.0::DOUBLE AS t, term_months/12.0::DOUBLE AS ny,
   CASE payment_frequency WHEN 'monthly' THEN 12.0 WHEN 'quarterly' THEN 4.0 WHEN 'semi-annual' THEN 2.0 ELSE 1.0 END::DOUBLE AS per FROM loans),
 c AS (SELECT *, greatest(round_even(ny*per,0),1) AS n, interest_rate/per AS i FROM b), e AS (SELECT *, least(t*per,n) AS el FROM c),
 k AS (SELECT *, floor(el) AS k, el-floor(el) AS fr FROM e),
 pr AS (SELECT *, greatest(CASE WHEN i>1e-12 AND pow(1+i,n)<>1 THEN loan_amount*(pow(1+i,n)-pow(1+i,k))/(pow(1+i,n)-1) ELSE loan_amount*(1-k/n) END,0) AS principal FROM k),
 ead AS (SELECT *, principal*i*fr AS accrued, principal+principal*i*fr AS ead FROM pr)"""


@REG.query(
    "h3_ead_schedule",
    EAD + f""" SELECT {_LID}, payment_frequency, per AS periods_per_year, n AS n_periods, round(el,6) AS periods_elapsed, k AS completed_periods, round(fr,6) AS period_fraction_elapsed,
 round(i,8) AS periodic_rate, interest_rate AS annual_rate, {money_sql('principal')} AS outstanding_principal, {money_sql('accrued')} AS accrued_interest, {money_sql('ead')} AS ead FROM ead""",
)
def _(spark, d):
    L = loans(spark, d)
    e = ex.with_ead_schedule(L, "loan_amount", "interest_rate", F.col("months_on_book") / F.lit(12.0), F.col("term_months") / F.lit(12.0), F.col("payment_frequency"))
    digits = {"periods_elapsed": 6, "period_fraction_elapsed": 6, "periodic_rate": 8}
    cash = ("outstanding_principal", "accrued_interest", "ead")
    names = ["payment_frequency", "periods_per_year", "n_periods", "periods_elapsed", "completed_periods", "period_fraction_elapsed",
             "periodic_rate", "annual_rate", "outstanding_principal", "accrued_interest", "ead"]
    return e.select("l_orderkey", "l_linenumber", "loan_amount", *[money(c).alias(c) if c in cash else F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in names])


@REG.query(
    "h4_ead_summary",
    _BAL + " SELECT 'estimate' AS mode, 'loan_amount,interest_rate,months_on_book,term_months' AS source, round(avg(balance),2) AS mean, round(quantile_cont(balance,0.5),2) AS median, round(min(balance),2) AS min, round(max(balance),2) AS max FROM bal",
)
def _(spark, d):
    return ex.ead_summary(loans(spark, d), term_months=True)


_STAGE = """, st AS (SELECT *, pd/orig_pd>1.5::DOUBLE OR pd-orig_pd>0.03::DOUBLE OR dpd>=30 AS sicr_flag,
 CASE WHEN dpd>=90 THEN 3 WHEN pd/orig_pd>1.5::DOUBLE OR pd-orig_pd>0.03::DOUBLE OR dpd>=30 THEN 2 ELSE 1 END AS ifrs9_stage FROM ead)"""


@REG.query("h5_stage_assignment", EAD + _STAGE + f" SELECT {_LID}, dpd, sicr_flag, ifrs9_stage FROM st")
def _(spark, d):
    return ex.with_stage(loans(spark, d)).select("l_orderkey", "l_linenumber", "loan_amount", "dpd", "sicr_flag", "ifrs9_stage")


_LGD_MAP = {"1-URGENT": 0.60, "2-HIGH": 0.50, "3-MEDIUM": 0.45}


@REG.query(
    "h6_lgd",
    "WITH " + LOANS + f""" SELECT {_LID}, 0.45::DOUBLE AS lgd_fixed, CASE product WHEN '1-URGENT' THEN 0.60 WHEN '2-HIGH' THEN 0.50 ELSE 0.45 END::DOUBLE AS lgd_type,
 round(least(greatest(1-0.8::DOUBLE/ltv,0.05),0.95),6) AS lgd_ltv FROM loans""",
)
def _(spark, d):
    L = loans(spark, d)
    a = ex.with_lgd(L, "fixed").withColumnRenamed("lgd", "lgd_fixed")
    b = ex.with_lgd(a, "by_type", type_col="product", table=_LGD_MAP).withColumnRenamed("lgd", "lgd_type")
    c = ex.with_lgd(b, "ltv", ltv_col="ltv")
    return c.select("l_orderkey", "l_linenumber", "loan_amount", "lgd_fixed", "lgd_type", F.round("lgd", 6).alias("lgd_ltv"))


ECL = EAD + _STAGE + """, lg AS (SELECT *, least(greatest(1-0.8::DOUBLE/ltv,0.05),0.95) AS lgd, pd AS pd_12m, 1-pow(1-pd,greatest(ny-t,1)) AS pd_lifetime FROM st),
 ecl AS (SELECT *, pd_12m*lgd*ead AS ecl_12m, CASE WHEN ifrs9_stage=1 THEN pd_12m ELSE pd_lifetime END*lgd*ead AS ecl FROM lg)"""


def ecl_table(spark, d):
    L = loans(spark, d)
    t, n = F.col("months_on_book") / F.lit(12.0), F.col("term_months") / F.lit(12.0)
    e = ex.with_ead_schedule(L, "loan_amount", "interest_rate", t, n, F.col("payment_frequency"))
    e = ex.with_lgd(ex.with_stage(e), "ltv", ltv_col="ltv").withColumn("maturity_years", n - t)
    return ex.with_ecl(e)


@REG.query(
    "h7_ecl_per_loan",
    ECL + f" SELECT {_LID}, ifrs9_stage, round(pd_12m,6) AS pd_12m, round(pd_lifetime,6) AS pd_lifetime, round(lgd,6) AS lgd, {money_sql('ead')} AS ead, {money_sql('ecl_12m')} AS ecl_12m, {money_sql('ecl')} AS ecl FROM ecl",
)
def _(spark, d):
    rates, cash = ("pd_12m", "pd_lifetime", "lgd"), ("ead", "ecl_12m", "ecl")
    return ecl_table(spark, d).select(
        "l_orderkey", "l_linenumber", "loan_amount", "ifrs9_stage", *[F.round(c, 6).alias(c) for c in rates], *[money(c).alias(c) for c in cash]
    )


@REG.query(
    "h8_ecl_by_stage",
    ECL + ", g AS (" + union(
        f"SELECT {s} AS stage, count(*) AS loans, sum(ead) AS e, sum(ecl) AS l, count(*) FILTER (sicr_flag) AS sicr_count, avg(pd_12m) AS p, avg(pd_lifetime) AS q FROM ecl {g}"
        for s, g in (("'stage_'||ifrs9_stage", "GROUP BY 1"), ("'total'", ""))
    ) + ") SELECT stage, loans, round(CAST(e AS DECIMAL(28,6)),2)::DOUBLE AS total_ead, round(CAST(l AS DECIMAL(28,6)),2)::DOUBLE AS total_ecl, round(l/e*100,4) AS coverage_pct, sicr_count, round(CAST(p AS DECIMAL(28,10)),6)::DOUBLE AS avg_pd_12m, round(CAST(q AS DECIMAL(28,10)),6)::DOUBLE AS avg_pd_lifetime FROM g",
)
def _(spark, d):
    return ex.ecl_by_stage(ecl_table(spark, d))


@REG.query(
    "h8_ecl_by_pd_band",
    ECL + """ SELECT CASE WHEN pd_12m<0.01::DOUBLE THEN '0%-1%' WHEN pd_12m<0.03::DOUBLE THEN '1%-3%' WHEN pd_12m<0.05::DOUBLE THEN '3%-5%' WHEN pd_12m<0.1::DOUBLE THEN '5%-10%' WHEN pd_12m<0.2::DOUBLE THEN '10%-20%' ELSE '20%+' END AS pd_band,
 count(*) AS loans, round(CAST(sum(ead) AS DECIMAL(28,6)),2)::DOUBLE AS total_ead, round(CAST(sum(ecl) AS DECIMAL(28,6)),2)::DOUBLE AS total_ecl FROM ecl GROUP BY 1""",
)
def _(spark, d):
    return ex.ecl_by_pd_band(ecl_table(spark, d))


@REG.query(
    "h8_top_loans",
    ECL + f" SELECT {_LID}, ifrs9_stage, {money_sql('ead')} AS ead, {money_sql('ecl')} AS ecl FROM ecl ORDER BY ecl.ecl DESC, l_orderkey, l_linenumber LIMIT 20",
)
def _(spark, d):
    t = ex.top_loans(ecl_table(spark, d), ["l_orderkey", "l_linenumber"], 20)
    return t.select("l_orderkey", "l_linenumber", "loan_amount", "ifrs9_stage", money("ead").alias("ead"), money("ecl").alias("ecl"))


# ---- stress --------------------------------------------------------------

_Z = "-1.5::DOUBLE+12.0::DOUBLE*unemployment_rate-20.0::DOUBLE*gdp_growth-(credit_score-600.0::DOUBLE)/150.0::DOUBLE-income/200000.0::DOUBLE-house_price/4000000.0::DOUBLE"


def _shock_sql(name: str, **cols: str) -> str:
    base = {c: c for c in ("unemployment_rate", "gdp_growth", "credit_score", "income", "house_price")} | cols
    return f"SELECT '{name}' AS v, " + ", ".join(f"{e} AS {c}" for c, e in base.items()) + " FROM drv"


DRIVERS = "WITH " + SCORED + """, drv AS (SELECT key, 0.04::DOUBLE+acctbal/400000.0::DOUBLE AS unemployment_rate, price/10000000.0::DOUBLE AS gdp_growth, 600.0::DOUBLE+acctbal/40.0::DOUBLE AS credit_score,
 20000.0::DOUBLE+price/4.0::DOUBLE AS income, price*2.0::DOUBLE AS house_price FROM scored)"""


def driver_table(spark, d):
    s = scored_loans(spark, d)
    return s.select(
        "key",
        (F.lit(0.04) + F.col("acctbal") / F.lit(400000.0)).alias("unemployment_rate"),
        (F.col("price") / F.lit(10000000.0)).alias("gdp_growth"),
        (F.lit(600.0) + F.col("acctbal") / F.lit(40.0)).alias("credit_score"),
        (F.lit(20000.0) + F.col("price") / F.lit(4.0)).alias("income"),
        (F.col("price") * F.lit(2.0)).alias("house_price"),
    )


def formula_score(df):
    z = (
        F.lit(-1.5) + F.lit(12.0) * F.col("unemployment_rate") - F.lit(20.0) * F.col("gdp_growth")
        - (F.col("credit_score") - F.lit(600.0)) / F.lit(150.0) - F.col("income") / F.lit(200000.0) - F.col("house_price") / F.lit(4000000.0)
    )
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-z)))


def _variants(parts: list[str]) -> str:
    return DRIVERS + ", vs AS (" + union([_shock_sql("base"), *parts]) + f"), ms AS (SELECT v, avg(1.0::DOUBLE/(1.0::DOUBLE+exp(-({_Z})))) AS m FROM vs GROUP BY v), bs AS (SELECT m AS b FROM ms WHERE v='base')"


@REG.query(
    "l1_feature_shocks",
    _variants([_shock_sql("credit_score decrease 10%", credit_score="credit_score*0.9::DOUBLE"), _shock_sql("income increase 20%", income="income*1.2::DOUBLE")])
    + " SELECT v AS shock, round(b,6) AS base_pd, round(m,6) AS shock_pd, round(m-b,6) AS pd_change, round((m-b)/b*100,4) AS pd_change_pct FROM ms, bs WHERE v<>'base'",
)
def _(spark, d):
    return stress.feature_shocks(driver_table(spark, d), [("credit_score", "decrease", 10), ("income", "increase", 20)], formula_score)


_SCN = [
    _shock_sql("Adverse Scenario", gdp_growth="gdp_growth*0.98::DOUBLE", unemployment_rate="unemployment_rate+0.03::DOUBLE", house_price="house_price*0.9::DOUBLE"),
    _shock_sql("Severe Scenario", gdp_growth="gdp_growth*0.95::DOUBLE", unemployment_rate="unemployment_rate+0.06::DOUBLE", house_price="house_price*0.75::DOUBLE"),
    _shock_sql("COVID-style Shock", income="income*0.75::DOUBLE"),
]


def _scenario_sql(parts) -> str:
    return _variants(parts) + """, x AS (SELECT v, b, least(m*CASE WHEN v='COVID-style Shock' THEN 2.5::DOUBLE ELSE 1 END,1) AS m FROM ms, bs WHERE v<>'base')
 SELECT v AS scenario, round(b,6) AS base_pd, round(m,6) AS shock_pd, round(m-b,6) AS pd_change, round((m-b)/b*100,4) AS pd_change_pct FROM x"""


@REG.query("l2_macro_scenario", _scenario_sql(_SCN[:1]))
def _(spark, d):
    return stress.macro_scenarios(driver_table(spark, d), formula_score, stress.SHOCKS[:3])


@REG.query("l3_all_scenarios", _scenario_sql(_SCN))
def _(spark, d):
    return stress.macro_scenarios(driver_table(spark, d), formula_score)


PSI = SPLIT + """, b AS (SELECT min(p) AS lo, max(p) AS hi FROM split WHERE split IN ('train','test')),
 c AS (SELECT CAST(least(floor((p-lo)/(hi-lo)*10),9) AS INTEGER) AS bin, count(*) FILTER (split='train') AS e, count(*) FILTER (split='test') AS a FROM split, b WHERE split IN ('train','test') GROUP BY 1),
 t AS (SELECT sum(e)::DOUBLE AS te, sum(a)::DOUBLE AS ta FROM c),
 s AS (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN coalesce(e,0)=0 THEN 0.0001::DOUBLE ELSE e/te END AS e, CASE WHEN coalesce(a,0)=0 THEN 0.0001::DOUBLE ELSE a/ta END AS a FROM range(0,10) r(i) LEFT JOIN c ON c.bin=i, t)"""


@REG.query("l4_psi_bins", PSI + " SELECT bin, round(e,6) AS train_pct, round(a,6) AS test_pct, round((a-e)*ln(a/e),6) AS psi FROM s")
def _(spark, d):
    return stress.psi_bins(split_scored(spark, d)).select("bin", *[F.round(c, 6).alias(c) for c in ("train_pct", "test_pct", "psi")])


@REG.query(
    "l4_psi",
    PSI + ", z AS (SELECT sum((a-e)*ln(a/e)) AS p FROM s) SELECT round(p,6) AS psi_total, CASE WHEN p>=0.25 THEN 'FAIL' WHEN p>=0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM z",
)
def _(spark, d):
    return stress.psi_report(split_scored(spark, d))


def _bt(freqs) -> str:
    return _temporal(freqs)


_FREQS = ["Monthly", "Quarterly", "Half-yearly", "Yearly"]


@REG.query("l5_backtest", _bt(_FREQS) + f" SELECT freq, period, {settle_sql('a', 6)} AS actual_dr, {settle_sql('q', 6)} AS avg_pred_pd, {settle_sql('abs(gap)', 6)} AS gap, abs(gap)>0.05 AS flagged FROM t")
def _(spark, d):
    return stress.backtest(scored_loans(spark, d), _FREQS)


@REG.query(
    "l5_backtest_report",
    _bt(_FREQS) + """ SELECT freq, round(avg(abs(gap)),6) AS mean_gap, round(max(abs(gap)),6) AS max_gap, count(*) FILTER (abs(gap)>0.05) AS flagged_periods,
 CASE WHEN avg(abs(gap))>=0.06 THEN 'FAIL' WHEN avg(abs(gap))>=0.03 THEN 'WARN' ELSE 'PASS' END AS status FROM t GROUP BY freq""",
)
def _(spark, d):
    return stress.backtest_report(scored_loans(spark, d), _FREQS)


@REG.query(
    "l6_directional_tests",
    _variants([
        _shock_sql("6.9a", unemployment_rate="unemployment_rate*1.1::DOUBLE"), _shock_sql("6.9b", gdp_growth="gdp_growth*0.9::DOUBLE"),
        _shock_sql("6.9c", credit_score="credit_score*0.9::DOUBLE"),
    ]) + """ SELECT v AS id, CASE v WHEN '6.9a' THEN 'Unemployment' WHEN '6.9b' THEN 'GDP' ELSE 'Credit score' END AS driver,
 CASE v WHEN '6.9a' THEN 'unemployment_rate' WHEN '6.9b' THEN 'gdp_growth' ELSE 'credit_score' END AS "column",
 CASE WHEN abs(m-b)<1e-4 THEN 'WARN' WHEN m>b THEN 'PASS' ELSE 'FAIL' END AS status, round(b,6) AS base_pd, round(m,6) AS new_pd, round(m-b,6) AS delta FROM ms, bs WHERE v<>'base'""",
)
def _(spark, d):
    return stress.directional_tests(driver_table(spark, d), formula_score)
