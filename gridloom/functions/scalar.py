"""Scalar helpers as Column expressions: cleaning, labels, names, parsing, calendar, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gridloom.functions.num import col


def sentinel_to_null(c, sentinel=-1) -> Column:
    x = col(c)
    return F.when(x != sentinel, x)


def coerce_double(c) -> Column:
    return col(c).try_cast("double")


def validity_gate(value, count, floor: float) -> Column:
    """The value only where its count is positive and it exceeds the floor."""
    return F.when((col(count) > 0) & (col(value) > floor), col(value))


def in_ratio_band(a, b, lo: float, hi: float) -> Column:
    """a where lo <= a / b <= hi."""
    q = F.when(col(b) != 0, col(a) / col(b))
    return F.when(q.between(lo, hi), col(a))


def quantity_weighted(pairs: Sequence[tuple]) -> Column:
    """sum(p * q) / sum(q) over the sides that have a price."""
    num = sum((F.coalesce(col(p) * col(q), F.lit(0.0)) for p, q in pairs), F.lit(0.0))
    den = sum((F.when(col(p).isNotNull(), F.coalesce(col(q), F.lit(0.0))).otherwise(0.0) for p, q in pairs), F.lit(0.0))
    return F.when(den > 0, num / den)


def cut_bins(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins; the last one is open to infinity."""
    x = col(c)
    expr = None
    for e, lab in sorted(zip(edges, labels), reverse=True):
        expr = F.when(x >= e, F.lit(lab)) if expr is None else expr.when(x >= e, F.lit(lab))
    return expr


def first_match(rules: Sequence[tuple[Column, Column | str]], default=None) -> Column:
    """Ordered conditions; the first that holds gives the label."""
    expr = None
    for cond, lab in rules:
        v = lab if isinstance(lab, Column) else F.lit(lab)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def lot_ceil(c, lot: int) -> Column:
    return (F.ceil(col(c) / lot) * lot).cast("long")


def fee_capped(value, rate: float, floor: float, cap: float) -> Column:
    """min(max(rate * value, floor), cap)."""
    return F.least(F.greatest(rate * col(value), F.lit(float(floor))), F.lit(float(cap)))


def norm_name(c) -> Column:
    """Lower case with whitespace collapsed."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def stable_id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(norm_name(c).cast("binary")), 1, 12))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_number(c) -> Column:
    """First number in a text; thousands commas are ignored."""
    return F.regexp_extract(F.regexp_replace(col(c), ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def range_bounds(c) -> tuple[Column, Column]:
    """Lower and upper end of 'a-b'; a single number is both; none gives 1."""
    nums = F.regexp_extract_all(F.regexp_replace(col(c), ",", ""), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    n = F.size(nums)
    lo = F.when(n > 0, F.element_at(nums, 1).cast("double")).otherwise(1.0)
    hi = F.when(n > 0, F.element_at(nums, -1).cast("double")).otherwise(1.0)
    return lo, hi


def plural_forms(c) -> Column:
    """Candidate plural spellings of a singular name."""
    x = col(c)
    return F.array_distinct(F.array(
        F.concat(x, F.lit("s")),
        F.when(x.rlike("(s|x|z|ch|sh)$"), F.concat(x, F.lit("es"))).otherwise(F.concat(x, F.lit("s"))),
        F.when(x.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies"))).otherwise(F.concat(x, F.lit("s"))),
        F.when(x.rlike("fe?$"), F.concat(F.regexp_replace(x, "fe?$", ""), F.lit("ves"))).otherwise(F.concat(x, F.lit("s"))),
        F.when(x.rlike("man$"), F.regexp_replace(x, "man$", "men")).otherwise(F.concat(x, F.lit("s"))),
    ))


def parse_date(c, formats: Sequence[str]) -> Column:
    """First format that fits; NULL when none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(col(c), F.lit(f))) for f in formats])


def cyclic(c, period: float) -> tuple[Column, Column]:
    a = 2 * 3.141592653589793 * col(c) / period
    return F.sin(a), F.cos(a)


def local_hour(ts, zone: str) -> Column:
    """Hour of day in a named time zone of a UTC instant."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts).cast("timestamp_ntz")))


def one_hot(c, values: Sequence, prefix: str) -> list[Column]:
    return [(col(c) == v).cast("double").alias(f"{prefix}_{str(v).lower().replace(' ', '_')}") for v in values]
