"""Small Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later expressions read many times.

    A one-element generator keeps the optimizer from inlining ``value`` into a
    lambda body, where it would be computed again for every array element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Every row of ``df`` beside the columns of a one-row aggregate, as a scalar subquery (no join)."""
    row = totals.select(F.struct(*totals.columns).alias("__row")).scalar()
    return df.withColumn("__row", row).select(*df.columns, *[F.col("__row")[c].alias(c) for c in totals.columns])


def safe_div(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def bin_right_closed(c: Column, edges: Sequence[float], open_ends: bool = False) -> Column:
    """0-based index of the right-closed bin, lowest edge included; null outside and for null.

    With ``open_ends`` the first and last bin also take everything beyond them.
    """
    n = len(edges) - 1
    if n < 1:
        return F.when(c.isNotNull(), F.lit(0))
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    if not open_ends:
        out = out.when(c < F.lit(edges[0]), F.lit(None).cast("int"))
    for i in range(1, n):
        out = out.when(c <= F.lit(edges[i]), F.lit(i - 1))
    if open_ends:
        return out.otherwise(F.lit(n - 1))
    return out.when(c <= F.lit(edges[n]), F.lit(n - 1))


def bin_left_closed(c: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    """0-based equal-width bin, left-closed with the last bin closed."""
    pos = F.floor((c - lo) / (hi - lo) * F.lit(float(n_bins))).cast("int")
    # least() skips nulls, so the null test comes first
    return F.when(c.isNull(), F.lit(None).cast("int")).when(hi == lo, F.lit(0)).otherwise(F.least(pos, F.lit(n_bins - 1)))


def corrected_skew(c: Column) -> Column:
    """Bias-corrected sample skewness as an aggregate; null below three values."""
    n = F.count(c).cast("double")
    return F.when(
        n > 2, F.coalesce(F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2), F.lit(0.0))
    )


def settle(c: Column, digits: int) -> Column:
    """Round half up on a decimal four digits longer, so summation order cannot move an exact half."""
    return F.round(F.round(c, digits + 4), digits)


def cents(c: Column) -> Column:
    return settle(c, 2)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant column.

    The built-in ``corr`` raises on a constant column under ANSI arithmetic.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def status_above(value: Column, warn_at: float, fail_at: float) -> Column:
    """PASS / WARN / FAIL for a measure where higher is worse."""
    return F.when(value >= fail_at, "FAIL").when(value >= warn_at, "WARN").otherwise("PASS")


def name_key(name: str) -> str:
    """Lower-case letters and digits of a column name."""
    return "".join(ch for ch in str(name).lower() if ch.isascii() and ch.isalnum())


def row_repeats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``n_rows`` and ``repeats``, the rows equal to an earlier one in ``cols``.

    Two 64-bit hashes per row are counted first; only rows whose hashes come
    again are grouped by their values, so the shuffle does not carry whole rows.
    """
    cols = list(cols)
    hashed = df.select(*cols, F.xxhash64(*cols).alias("__h1"), F.xxhash64(F.lit(7), *cols).alias("__h2"))
    seen = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"))
    rows = hashed.join(seen.where(F.col("__n") > 1).select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
    again = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("repeats"))
    return with_totals(seen.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows")), again)
