"""Column roles: numeric, categorical, datetime, boolean or id; targets, task type, date columns, target binning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanforge.functions.expressions import bin_right_closed, name_key
from loanforge.operators.ordering import exact_quantiles

# Names and name patterns that decide a column's role.
BOOLEAN_NAME_PARTS = ["flag", "is_", "has_", "bool", "indicator"]
BOOLEAN_WORDS = ["yes", "no", "Yes", "No", "true", "false", "True", "False"]
ID_NAME_PATTERNS = [
    r"^id$", r"_id$", r"^id_", r"^customer_id", r"^loan_id", r"^account_id", r"^borrower_id", r"^facility_id",
    r"^application_id", r"^policy_id", r"^member_id", r"^ref_", r"^reference", r"^cust_", r"^acct_",
]
TARGET_NAMES = {
    "default", "defaulted", "isdefault", "defflag", "deflag", "bad", "isbad", "badflag", "target", "label", "y",
    "arrears", "npl", "chargedoff", "chargeoff", "writeoff", "writtenoff", "nonperforming", "churn", "fraud",
    "outcome", "dpdflg", "dpdflag", "dpd90", "dpd90flag", "ever90", "forbearance",
}
PAST_DUE_NAMES = ["dpd", "dayspastdue"]
ORIGINATION_PD_NAMES = ["origpd", "originationpd", "pdorig", "pdatorigination", "pdorigination", "initialpd", "basepd", "originalpd", "pdinitial"]
POST_DEFAULT_NAMES = [
    "recoveryrate", "recoveryamount", "recoveryamt", "recoveredamount", "recovery", "lgd", "lossgivendefault",
    "lossseverity", "realizedlgd", "eadatdefault", "exposureatdefault", "balanceatdefault", "defaultbalance", "ccf",
    "creditconversionfactor", "realizedccf", "defaultdate", "dateofdefault", "defaultdt", "chargeoffdate",
    "writeoffdate", "delinquencydate",
]
ORIGINATION_DATE_NAMES = [
    "origination_date", "orig_date", "disbursement_date", "loan_date", "open_date", "sanction_date", "application_date",
    "booking_date", "start_date", "funding_date", "issue_date", "account_open_date",
]
OBSERVATION_DATE_NAMES = ["as_of_date", "reporting_date", "observation_date", "snapshot_date"]
# Date layouts, year first or year last.
YEAR_FIRST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})([ T]\d{1,2}:\d{2}(:\d{2})?.*)?$"
YEAR_LAST = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})([ T]\d{1,2}:\d{2}(:\d{2})?.*)?$"


def is_id_name(name: str) -> bool:
    return any(re.search(p, name.lower()) for p in ID_NAME_PATTERNS)


def late_origin_columns(columns: Sequence[str]) -> list[str]:
    """Days-past-due and origination-PD columns: known by definition of the outcome."""
    return [c for c in columns if any(s in name_key(c) for s in (*PAST_DUE_NAMES, *ORIGINATION_PD_NAMES))]


def post_default_columns(columns: Sequence[str]) -> list[str]:
    """Recovery, loss and default-date columns: observed only after default."""
    return [c for c in columns if any(s in name_key(c) for s in POST_DEFAULT_NAMES)]


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Date from year-first text, else month-first (or day-first) text; null when neither fits.

    The layout test comes first, so text that is no date costs one regular expression.
    """
    s = F.trim(c.cast("string"))
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    iso = F.concat_ws("-", part(YEAR_FIRST, 1), F.lpad(part(YEAR_FIRST, 2), 2, "0"), F.lpad(part(YEAR_FIRST, 3), 2, "0"))
    month, day = (2, 1) if day_first else (1, 2)
    local = F.concat_ws("-", part(YEAR_LAST, 3), F.lpad(part(YEAR_LAST, month), 2, "0"), F.lpad(part(YEAR_LAST, day), 2, "0"))
    return F.when(s.rlike(YEAR_FIRST), iso.try_cast("date")).when(s.rlike(YEAR_LAST), local.try_cast("date"))


def date_parse_rates(c: Column) -> tuple[Column, Column]:
    """Share of non-null values parsed month-first and day-first."""
    seen = c.isNotNull()
    share = lambda d: F.avg(F.when(seen, parse_date(c, d).isNotNull().cast("double")))
    return share(False), share(True)


def _is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    r = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


def column_facts(df: DataFrame) -> dict[str, dict]:
    """Per-column evidence for role detection from one wide aggregate.

    Distinct counts are estimated first; only columns whose estimate could lie on
    either side of the 0.9 share or of 50 values are counted exactly.
    """
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for f in df.schema.fields:
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"n__{f.name}"), F.approx_count_distinct(c).alias(f"u__{f.name}")]
        if _is_string(f.dataType):
            us, eu = date_parse_rates(c)
            aggs += [
                F.count(F.trim(c).try_cast("double")).alias(f"num__{f.name}"),
                F.count_if(~c.isin(BOOLEAN_WORDS)).alias(f"nb__{f.name}"),
                F.avg(F.when(c.isNotNull(), c.rlike("[-/:]").cast("double"))).alias(f"sep__{f.name}"),
                us.alias(f"us__{f.name}"),
                eu.alias(f"eu__{f.name}"),
            ]
        elif isinstance(f.dataType, T.NumericType):
            aggs.append(F.count_if(~c.isin(0, 1)).alias(f"nb__{f.name}"))
    r = df.agg(*aggs).first().asDict()
    facts = {}
    close = []
    for f in df.schema.fields:
        n, u = r[f"n__{f.name}"], r[f"u__{f.name}"]
        if _is_string(f.dataType) or (isinstance(f.dataType, T.NumericType) and is_id_name(f.name)):
            if n and (0.6 * n <= u or 30 <= u <= 80):
                close.append(f.name)
        facts[f.name] = {k: r.get(f"{k}__{f.name}") for k in ("num", "nb", "sep", "us", "eu")} | {"n": n, "unique": u, "rows": r["__rows"]}
    for c, u in distinct_counts(df, close).items():
        facts[c]["unique"] = u
    return facts


def detect_column_types(df: DataFrame, facts: dict[str, dict] | None = None) -> dict[str, list[str]]:
    """Role lists ``numeric, categorical, datetime, boolean, id`` of a table."""
    facts = facts or column_facts(df)
    out: dict[str, list[str]] = {k: [] for k in ("numeric", "categorical", "datetime", "boolean", "id")}
    for f in df.schema.fields:
        x = facts[f.name]
        n, u = x["n"], x["unique"]
        named_bool = any(k in f.name.lower() for k in BOOLEAN_NAME_PARTS)
        if isinstance(f.dataType, T.BooleanType):
            out["boolean"].append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out["datetime"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            if named_bool and x["nb"] == 0:
                out["boolean"].append(f.name)
            elif is_id_name(f.name) and u > 0.9 * n:
                out["id"].append(f.name)
            else:
                out["numeric"].append(f.name)
        elif _is_string(f.dataType):
            if x["nb"] == 0:
                out["boolean"].append(f.name)
            elif n and x["num"] / n >= 0.95:
                out["id" if is_id_name(f.name) and u > 0.9 * n else "numeric"].append(f.name)
            elif n and x["sep"] >= 0.8 and max(x["us"], x["eu"]) >= 0.95:
                out["datetime"].append(f.name)
            elif n and ((u > 0.9 * n and u > 50) or u / n > 0.95):
                out["id"].append(f.name)
            else:
                out["categorical"].append(f.name)
    return out


def column_type_table(df: DataFrame) -> DataFrame:
    """Detected role, dtype, exact distinct values and non-null count per column."""
    roles = detect_column_types(df)
    role_of = {c: r for r, cs in roles.items() for c in cs}
    types = dict(df.dtypes)
    a = df.agg(*[x for c in df.columns for x in (F.count_distinct(F.col(c)).alias(f"u__{c}"), F.count(F.col(c)).alias(f"n__{c}"))])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(role_of.get(c, "unknown")).alias("detected_type"), F.lit(types[c]).alias("dtype"),
            F.col(f"u__{c}").alias("unique_values"), F.col(f"n__{c}").alias("non_null_count"),
        )
        for c in df.columns
    ]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def detected_types(df: DataFrame) -> DataFrame:
    """``(column, detected_type)`` of a table."""
    rows = [(c, r) for r, cs in detect_column_types(df).items() for c in cs]
    return df.sparkSession.createDataFrame(rows, "column string, detected_type string")


def more_distinct_than(df: DataFrame, cols: Sequence[str], k: int) -> set[str]:
    """Columns with more than ``k`` distinct values: estimates decide clear cases, exact counts the rest."""
    if not cols:
        return set()
    est = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    exact = distinct_counts(df, [c for c in cols if k / 3 <= est[c] <= 3 * k])
    return {c for c in cols if exact.get(c, est[c]) > k}


def two_valued(df: DataFrame, cols: Sequence[str]) -> set[str]:
    """Columns with exactly two distinct non-null values, by two scans and no shuffle of values."""
    if not cols:
        return set()
    r = df.agg(*[x for c in cols for x in (F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}"))]).first()
    live = [c for c in cols if r[f"lo__{c}"] is not None and r[f"lo__{c}"] != r[f"hi__{c}"]]
    if not live:
        return set()
    s = df.agg(*[F.count_if(~F.col(c).isin(r[f"lo__{c}"], r[f"hi__{c}"])).alias(c) for c in live]).first()
    return {c for c in live if s[c] == 0}


def target_candidates(df: DataFrame, roles: dict[str, list[str]] | None = None) -> list[str]:
    """Likely target columns, best first: exact names, else 0/1 columns with 1% to 50% positives."""
    roles = roles or detect_column_types(df)
    out = set(roles["id"]) | set(roles["datetime"]) | set(late_origin_columns(df.columns)) | set(post_default_columns(df.columns))
    cols = [c for c in df.columns if c not in out]
    named = [c for c in cols if name_key(c) in TARGET_NAMES]
    binary = two_valued(df, named)
    if binary:
        return [c for c in named if c in binary]
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(types[c], (T.NumericType, T.BooleanType)) or _is_string(types[c])]
    if not num:
        return []
    x = {c: (F.col(c).cast("double") if not _is_string(types[c]) else F.col(c).try_cast("double")) for c in num}
    r = df.agg(*[y for c in num for y in (F.avg(x[c]).alias(f"m__{c}"), F.count_if(~x[c].isin(0.0, 1.0)).alias(f"o__{c}"))]).first()
    hits = [c for c in num if r[f"m__{c}"] is not None and r[f"o__{c}"] == 0 and 0.01 <= r[f"m__{c}"] <= 0.50]
    return sorted(hits, key=lambda c: 0 if "default" in c.lower() or "bad" in c.lower() else 1)


def target_candidate_table(df: DataFrame) -> DataFrame:
    rows = [(i + 1, c) for i, c in enumerate(target_candidates(df))]
    return df.sparkSession.createDataFrame(rows, "rank int, column string")


def task_type_map(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """binary, multiclass (ten or fewer integer-like values) or regression per column, in two scans."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n__{c}"), F.approx_count_distinct(x).alias(f"u__{c}"),
            F.count_if(x != F.round(x)).alias(f"f__{c}"), F.min(x).alias(f"lo__{c}"), F.max(x).alias(f"hi__{c}"),
        ]
    r = df.agg(*aggs).first()
    small = [c for c in cols if r[f"n__{c}"] and r[f"u__{c}"] <= 20]
    exact = distinct_counts(df, small)
    out = {}
    for c in cols:
        u = exact.get(c)
        if u is None:
            out[c] = "regression"
        elif u <= 2 and r[f"lo__{c}"] > -1 and r[f"hi__{c}"] < 2:
            out[c] = "binary"
        else:
            out[c] = "multiclass" if u <= 10 and r[f"f__{c}"] == 0 else "regression"
    return out


def task_type(df: DataFrame, col: str) -> str:
    return task_type_map(df, [col])[col]


def task_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(task_type_map(df, cols).items()), "column string, task_type string")


def date_columns(df: DataFrame, min_rate: float = 0.80) -> list[tuple[str, bool]]:
    """Columns that hold dates, origination-like ones first (flagged True)."""
    native = (T.DateType, T.TimestampType, T.TimestampNTZType)
    fields = [f for f in df.schema.fields if isinstance(f.dataType, native) or _is_string(f.dataType)]
    if not fields:
        return []
    r = df.agg(
        *[
            F.avg((F.col(f.name) if isinstance(f.dataType, native) else parse_date(F.col(f.name))).isNotNull().cast("double")).alias(f.name)
            for f in fields
        ]
    ).first()
    good = [f.name for f in fields if (r[f.name] or 0.0) >= min_rate]
    orig = [c for c in good if any(name_key(s) in name_key(c) for s in ORIGINATION_DATE_NAMES)]
    return [(c, True) for c in orig] + [(c, False) for c in good if c not in orig]


def date_column_table(df: DataFrame) -> DataFrame:
    rows = [(i + 1, c, p) for i, (c, p) in enumerate(date_columns(df))]
    return df.sparkSession.createDataFrame(rows, "rank int, column string, preferred boolean")


def pick_date_column(columns: Sequence[str]) -> str | None:
    """Default date column for macro alignment; never a default or charge-off date."""
    keys = {c: name_key(c) for c in columns}
    exact = [c for s in ORIGINATION_DATE_NAMES for c, k in keys.items() if k == name_key(s)]
    part = [c for s in ORIGINATION_DATE_NAMES + OBSERVATION_DATE_NAMES for c, k in keys.items() if name_key(s) in k]
    return (exact + part + [None])[0]


def continuous_bins(
    df: DataFrame, col: str, n_bins: int = 5, method: str = "quantile", edges: Sequence[float] | None = None
) -> list[float]:
    """Bin edges for a continuous target."""
    if edges:
        return [float(e) for e in edges]
    if method == "quantile":
        q = exact_quantiles(df, [col], [i / n_bins for i in range(n_bins + 1)])[col]
        return sorted({v for v in q if v is not None})
    r = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    return [lo - (hi - lo) * 0.001 if i == 0 else lo + (hi - lo) * i / n_bins if i < n_bins else hi for i in range(n_bins + 1)]


def bin_target(
    df: DataFrame, col: str, n_bins: int = 5, method: str = "quantile",
    edges: Sequence[float] | None = None, labels: Sequence[str] | None = None, out: str = "band",
) -> tuple[DataFrame, list[float]]:
    """Table with a right-closed band label per row, and the edges used."""
    e = continuous_bins(df, col, n_bins, method, edges)
    names = list(labels or [f"Band_{i + 1}" for i in range(len(e) - 1)])
    idx = bin_right_closed(F.col(col).cast("double"), e)
    return df.withColumn(out, F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)), e


def bin_counts(df: DataFrame, col: str, **kw) -> DataFrame:
    banded, _ = bin_target(df, col, **kw)
    return banded.where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))
