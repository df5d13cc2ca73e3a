"""Group summaries whose state stays small per group (map-side combined)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.num import div
from gridloom.operators.joins import with_scalars
from gridloom.operators.quantiles import running


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole last row per key as an aggregate: unlike row_number, a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    s = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return s.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    s = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return s.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column the last value that is not null."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols])


def entity_summary(df: DataFrame, price: str, ret: str, volume: str, entity="entity", date="date") -> DataFrame:
    return df.groupBy(entity).agg(
        F.count("*").alias("n"), F.min_by(price, date).alias("px_first"), F.max_by(price, date).alias("px_last"),
        F.percentile(price, F.lit(0.5)).alias("px_median"), F.min(price).alias("px_min"),
        F.max(price).alias("px_max"), F.stddev(ret).alias("ret_sd"),
        F.percentile(volume, F.lit(0.5)).alias("volume_median"))


def net_flow(df: DataFrame, origin: str, destination: str, weight: str) -> DataFrame:
    """Inflow by destination against outflow by origin; ``weight`` counts the moves behind a row."""
    i = df.groupBy(F.col(destination).alias("entity")).agg(F.sum(weight).alias("inflow"))
    o = df.groupBy(F.col(origin).alias("entity")).agg(F.sum(weight).alias("outflow"))
    z = F.lit(0).cast("long")
    return i.join(o, "entity", "full").select(
        "entity", F.coalesce("inflow", z).alias("inflow"), F.coalesce("outflow", z).alias("outflow"),
        (F.coalesce("inflow", z) - F.coalesce("outflow", z)).alias("net"))


def weighted_stats(df: DataFrame, by: Sequence[str], value: str, weight: str, threshold: float) -> DataFrame:
    """Weighted mean, lower weighted median and weight at or above a threshold."""
    g = running(df, value, by, [weight])
    v, w = F.col("v"), F.col(weight)
    return g.groupBy(*by).agg(
        (F.sum(v * w) / F.sum(w)).alias("w_mean"),
        F.min(F.when(F.col(f"c_{weight}") * 2 >= F.col(f"g_{weight}"), v)).alias("w_median"),
        F.sum(F.when(v >= threshold, w).otherwise(0)).cast("long").alias("w_above"))


def concentration(df: DataFrame, by: Sequence[str], value: str, top: int = 10) -> DataFrame:
    """Herfindahl index of shares, share of the top k categories, number of categories."""
    t, r = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col("category"))
    s = df.withColumn("s", F.col(value) / F.sum(value).over(t)).withColumn("rk", F.row_number().over(r))
    return s.groupBy(*by).agg(
        F.sum(F.col("s") * F.col("s")).alias("hhi"),
        F.sum(F.when(F.col("rk") <= top, F.col("s"))).alias("top_share"), F.count("*").alias("n_categories"))


def top_categories(df: DataFrame, category: str, value: str, k: int) -> DataFrame:
    """The k largest categories overall (TakeOrdered, k rows)."""
    return df.groupBy(category).agg(F.sum(value).alias("total")).orderBy(F.col("total").desc(), category).limit(k)


def category_mix(df: DataFrame, by: Sequence[str], category: str, value: str, k: int) -> DataFrame:
    """Share of each globally common category per group, long form."""
    top = top_categories(df, category, value, k).select(category, F.lit(1).alias("_top"))
    tot = Window.partitionBy(*by)
    d = df.withColumn("share", F.col(value) / F.sum(value).over(tot))
    return d.join(F.broadcast(top), category).select(*by, category, "share")


def scoped(df: DataFrame, scopes: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregates for several grouping levels in one pass (grouping sets)."""
    cols = sorted({c for s in scopes for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in scopes], *cols).agg(*aggs)


def share_of_total(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.sum(value).alias("total"))
    return with_scalars(g, g.agg(F.sum("total").alias("all")), "z").withColumn(
        "share", div("total", "z.all")).drop("z")
