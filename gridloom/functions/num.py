"""Rounding, null-safe arithmetic and row-wise reductions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Half-away-from-zero on the scaled value: the same answer in every engine, never -0.0."""
    k = float(10**digits)
    return F.round(col(c).cast("double") * k) / k + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def div(a: str | Column, b: str | Column) -> Column:
    """a / b with NULL for a zero divisor."""
    d = col(b).cast("double")
    return F.when(d != 0, col(a).cast("double") / d)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the complete pairs; NULL where a side has no spread (``corr`` raises there)."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))


def mean_skipnull(*cs: str | Column) -> Column:
    """Row-wise mean over the columns that are present."""
    xs = [col(c).cast("double") for c in cs]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    cnt = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.when(cnt > 0, total / cnt)


def log_floor(c: str | Column, floor: float = 1.0) -> Column:
    return F.log(F.greatest(col(c).cast("double"), F.lit(floor)))


def log1p_floor(c: str | Column) -> Column:
    return F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0)))


def half_life(rho: str | Column, per: float = 1.0) -> Column:
    """per * ln(1/2) / ln|rho| where 0 < |rho| < 1, else NULL."""
    a = F.abs(col(rho))
    return F.when((a > 0) & (a < 1), per * F.log(F.lit(0.5)) / F.log(a))


def sign(c: str | Column) -> Column:
    return F.signum(col(c).cast("double"))


def cents(c: str | Column) -> Column:
    """Money as an exact integer, so that sums do not depend on the order of tasks."""
    return F.round(col(c) * 100).cast("long")
