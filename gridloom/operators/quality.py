"""Expectations as (check, violations, passed) rows, reconciliation, freshness and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators.joins import with_scalars


def monotone_violations(df: DataFrame, value: str, entity="entity", date="date") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(date)
    d = df.withColumn("_prev", F.lag(value).over(w))
    return d.groupBy(entity).agg(F.count(F.when(F.col(value) < F.col("_prev"), 1)).alias("violations"))


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Every named condition counted in one pass; a NULL condition counts as a violation."""
    agg = df.agg(*[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()])
    return agg.unpivot([], list(checks), "check", "violations").select(
        "check", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"),
        (F.coalesce("violations", F.lit(0)) == 0).alias("passed"))


def unique_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1")
    return d.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))


def full_grid(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Missing cells of the a x b grid, from counts alone."""
    s = df.agg(F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb"), F.countDistinct(a, b).alias("nc"))
    v = F.col("na") * F.col("nb") - F.col("nc")
    return s.select(F.lit(name).alias("check"), v.alias("violations"), (v == 0).alias("passed"))


def missing_blocks(actual: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    return expected.join(actual.select(on).distinct(), on, "left_anti")


def require_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Schema contract, checked on the driver without a job; raises on a difference."""
    have = dict(df.dtypes)
    bad = {c: (t, have.get(c)) for c, t in required.items() if have.get(c) != t}
    if bad:
        raise ValueError(f"schema contract broken: {bad}")
    return df.select(*required)


def agreement(facts: DataFrame, fact: str, value: str, tol: float) -> DataFrame:
    """Same fact stated by several sources: spread against a tolerance."""
    return facts.groupBy(fact).agg(F.count("*").alias("sources"), (F.max(value) - F.min(value)).alias("spread"),
                                   (F.max(value) - F.min(value) <= tol).alias("agrees"))


def freshness(stamps: DataFrame, source: str, stamp: str, max_age_days: int) -> DataFrame:
    """Age of each source against the newest one."""
    g = stamps.groupBy(source).agg(F.max(stamp).alias("latest"))
    g = with_scalars(g, g.agg(F.max("latest").alias("newest")))
    age = F.datediff("s.newest", "latest")
    return g.select(source, "latest", age.cast("long").alias("age_days"), (age > max_age_days).alias("stale"))


def audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative filter, in one pass."""
    keep = F.lit(True)
    aggs = [F.count("*").alias("input")]
    for name, cond in steps:
        keep = keep & F.coalesce(cond, F.lit(False))
        aggs.append(F.sum(keep.cast("long")).alias(name))
    names = ["input", *[n for n, _ in steps]]
    return df.agg(*aggs).unpivot([], names, "step", "rows")


# ------------------------------------------------------------------ decisions
# fixed values: thresholds of the decision rules
RULES = {"min_t": 2.0, "min_windows": 10, "min_depth": 25, "max_staleness_days": 7, "min_share_profitable": 0.6}


def eligible_horizon(holdout: DataFrame, min_t: float = 2.0, min_n: int = 10) -> DataFrame:
    """The shortest horizon whose own holdout clears significance and independent windows."""
    ok = holdout.where((F.col("t") >= min_t) & (F.col("windows") >= min_n))
    s = F.struct("horizon", "net", "t", "windows", "share_profitable", "cutoff")
    g = ok.agg(F.min_by(s, "horizon").alias("h"))
    return g.select(*[F.col(f"h.{c}").alias(c) for c in ("horizon", "net", "t", "windows", "share_profitable", "cutoff")])


def decide(preds: DataFrame, books: DataFrame, horizon: DataFrame, band: float, round_trip: float,
           rules: dict = RULES, entity="entity") -> DataFrame:
    """Ordered gates: stale or no horizon, no depth, inside the band, below the tested cutoff, fee, conflict, then buy or sell.

    ``preds``: entity, as_of, deviation, predicted, lo80, hi80.  ``books``: entity, depth.
    ``horizon``: the single row of ``eligible_horizon`` (NULLs when none is eligible).
    """
    d = preds.join(books.select(entity, "depth"), entity, "left")
    d = with_scalars(d, preds.agg(F.max("as_of").alias("now")), "m")
    d = with_scalars(d, horizon.select("horizon", "cutoff", "share_profitable"), "h")
    dev, adev = F.col("deviation"), F.abs("deviation")
    stale = F.datediff("m.now", "as_of") > rules["max_staleness_days"]
    gates = [
        ("Abstain", "none", "price is stale", stale),
        ("Abstain", "none", "no horizon cleared its own holdout", F.col("h.horizon").isNull()),
        ("Avoid", "low", "resting depth under one lot", F.col("depth") < rules["min_depth"]),
        ("Hold", "high", "inside the band", adev < band),
        ("Hold", "medium", "below the cutoff the holdout was earned at", adev < F.col("h.cutoff")),
        ("Hold", "medium", "does not cover the round trip", adev <= round_trip),
        ("Investigate", "low", "signal and forecast disagree",
         ((dev > 0) & (F.col("predicted") > 0)) | ((dev < 0) & (F.col("predicted") < 0))),
    ]
    action = F.when(dev > 0, "Sell").otherwise("Buy")
    weak = ((F.col("lo80") < 0) & (F.col("hi80") > 0)) | (F.col("h.share_profitable") < rules["min_share_profitable"])
    conf = F.when(weak, "low").otherwise("medium")
    why = F.concat_ws("; ", F.lit("deviation clears the tested cutoff"),
                      F.when(F.col("depth").isNull(), "no book, capacity unknown"),
                      F.when((F.col("lo80") < 0) & (F.col("hi80") > 0), "interval spans zero"))
    for a, c, reason, cond in reversed(gates):
        action, conf, why = (F.when(cond, a).otherwise(action), F.when(cond, c).otherwise(conf), F.when(cond, reason).otherwise(why))
    return d.select(entity, "as_of", "deviation", "predicted", F.col("h.horizon").alias("horizon"),
                    action.alias("action"), conf.alias("confidence"), why.alias("reason"))
