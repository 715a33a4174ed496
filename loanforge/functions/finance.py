"""Loan balance, exposure and loss formulas as Columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payment periods per year by frequency label.
PERIODS_PER_YEAR = {"monthly": 12, "quarterly": 4, "semi-annual": 2, "annual": 1}
DEFAULT_FREQUENCY = "monthly"


def at_least_zero(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def outstanding_balance(amount: Column, rate: Column, years: Column, term: Column | None = None) -> Column:
    """Balance after ``years`` at annual ``rate``: amortising with a term, accruing without one.

    With a term the balance is P((1+r)^N - (1+r)^m)/((1+r)^N - 1), m = min(years, N).
    """
    p, r, t = at_least_zero(amount), at_least_zero(rate), at_least_zero(years)
    if term is None:
        return p * F.pow(1 + r, t)
    n = F.when(term.cast("double") > 0, term.cast("double")).otherwise(F.greatest(t, F.lit(1.0)))
    m = F.least(t, n)
    fn, fm = F.pow(1 + r, n), F.pow(1 + r, m)
    straight = p * (1 - F.least(F.greatest(m / n, F.lit(0.0)), F.lit(1.0)))
    return F.greatest(F.when((r > 1e-9) & (fn != 1), p * (fn - fm) / (fn - 1)).otherwise(straight), F.lit(0.0))


def balance_after_payments(p: Column, i: Column, n: Column, k: Column) -> Column:
    """Principal after ``k`` of ``n`` level payments at period rate ``i``; straight line at zero rate."""
    fn, fk = F.pow(1 + i, n), F.pow(1 + i, k)
    straight = p * (1 - F.least(F.greatest(k / n, F.lit(0.0)), F.lit(1.0)))
    return F.when((i > 1e-12) & (fn != 1), p * (fn - fk) / (fn - 1)).otherwise(straight)


def frequency_label(freq: Column | None) -> Column:
    """Known payment frequency label; anything else is monthly."""
    if freq is None:
        return F.lit(DEFAULT_FREQUENCY)
    f = F.lower(F.trim(freq.cast("string")))
    return F.when(f.isin(list(PERIODS_PER_YEAR)), f).otherwise(F.lit(DEFAULT_FREQUENCY))


def ead_stages(amount: Column, rate: Column, years: Column, term: Column, freq: Column | str | None = None) -> list[dict[str, Column]]:
    """Exposure by payment schedule: principal after the last payment plus interest accrued since.

    Returned as successive column sets, each built on the one before, so that no
    intermediate is written out twice in generated code. ``rate`` is an annual
    fraction; periods round half to even.
    """
    if isinstance(freq, str):
        if freq.strip().lower() not in PERIODS_PER_YEAR:
            raise ValueError(f"unknown payment frequency {freq!r}")
        freq = F.lit(freq)
    col = F.col
    per = F.element_at(F.create_map(*[F.lit(x) for kv in PERIODS_PER_YEAR.items() for x in kv]), col("payment_frequency")).cast("double")
    years_term = F.when(col("__term") > 0, col("__term")).otherwise(F.greatest(col("__years"), F.lit(1.0)))
    i, n, k = col("periodic_rate"), col("n_periods"), col("completed_periods")
    grow = F.when((i > 1e-12) & (col("__fn") != 1), col("__amount") * (col("__fn") - col("__fk")) / (col("__fn") - 1))
    straight = col("__amount") * (1 - F.least(F.greatest(k / n, F.lit(0.0)), F.lit(1.0)))
    return [
        {
            "__amount": at_least_zero(amount), "annual_rate": at_least_zero(rate), "__years": at_least_zero(years),
            "__term": term.cast("double"), "payment_frequency": frequency_label(freq),
        },
        {"periods_per_year": per},
        {"n_periods": F.greatest(F.bround(years_term * col("periods_per_year")), F.lit(1.0)), "periodic_rate": col("annual_rate") / col("periods_per_year")},
        {"periods_elapsed": F.least(col("__years") * col("periods_per_year"), n)},
        {"completed_periods": F.floor("periods_elapsed").cast("double")},
        {"period_fraction_elapsed": col("periods_elapsed") - k, "__fn": F.pow(1 + i, n), "__fk": F.pow(1 + i, k)},
        {"outstanding_principal": F.greatest(grow.otherwise(straight), F.lit(0.0))},
        {"accrued_interest": col("outstanding_principal") * i * col("period_fraction_elapsed")},
        {"ead": col("outstanding_principal") + col("accrued_interest")},
    ]


def ifrs9_stage(
    pd: Column, orig_pd: Column | None, dpd: Column | None, rel: float = 1.5, absolute: float = 0.03, dpd_sicr: int = 30, dpd_default: int = 90
) -> tuple[Column, Column]:
    """(significant-increase flag, stage): stage 3 from ``dpd_default`` days, stage 2 on an increase, else 1."""
    sicr = F.lit(False)
    if orig_pd is not None:
        sicr = sicr | F.coalesce((orig_pd > 0) & (pd / orig_pd > rel), F.lit(False)) | F.coalesce(pd - orig_pd > absolute, F.lit(False))
    late = F.lit(False)
    if dpd is not None:
        sicr = sicr | F.coalesce(dpd >= dpd_sicr, F.lit(False))
        late = F.coalesce(dpd >= dpd_default, F.lit(False))
    return sicr | late, F.when(late, 3).when(sicr, 2).otherwise(1)


def lgd_by_type(loan_type: Column, table: Mapping[str, float], default: float = 0.45) -> Column:
    lut = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(lut, loan_type.cast("string")), F.lit(default))


def lgd_from_ltv(ltv: Column, haircut: float = 0.20, default: float = 0.45) -> Column:
    """Loss share after selling collateral at a haircut, kept within 5% to 95% (own choice of formula)."""
    raw = 1 - F.lit(1 - haircut) / ltv
    return F.when(ltv > 0, F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.95))).otherwise(F.lit(default))


def lifetime_pd(pd: Column, maturity_years: Column | None) -> Column:
    """1 - (1 - PD)^max(T, 1); the 12-month PD without a maturity (own choice of formula)."""
    if maturity_years is None:
        return pd
    return F.when(maturity_years.isNull(), pd).otherwise(1 - F.pow(1 - pd, F.greatest(maturity_years.cast("double"), F.lit(1.0))))
