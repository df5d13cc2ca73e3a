"""Resting offers: fees, depth, bands, participation and venue comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import div
from gridloom.operators.joins import with_scalars
from gridloom.operators.quantiles import quantile_bins, quantile_row, quantile_wide

# fixed values: fee schedule (rate, floor, cap) and lot size
FEE = {"rate": 0.02, "floor": 2000.0, "cap": 8000.0}
LOT = 25


def with_fees(offers: DataFrame, rate: float = FEE["rate"], floor: float = FEE["floor"], cap: float = FEE["cap"]) -> DataFrame:
    d = offers.withColumn("fee_uncapped", rate * F.col("value"))
    d = d.withColumn("fee", S.fee_capped("value", rate, floor, cap))
    return d.withColumn("eff_rate_pct", F.col("fee") / F.col("value") * 100)


def book_summary(offers: DataFrame, below: float, anonymous: str, entity="entity") -> DataFrame:
    """Best prices, depth, counts, anonymous share, depth below a level, mid and spread per entity."""
    sell, buy = F.col("side") == "sell", F.col("side") == "buy"
    when = lambda c, v: F.when(c, F.col(v))
    low = buy & (F.col("price") < below)
    g = offers.groupBy(entity).agg(
        F.count(F.when(sell, 1)).alias("n_sellers"), F.count(F.when(buy, 1)).alias("n_buyers"),
        F.min(when(sell, "price")).alias("best_ask"), F.max(when(buy, "price")).alias("best_bid"),
        F.sum(when(sell, "amount")).alias("sell_depth"), F.sum(when(buy, "amount")).alias("buy_depth"),
        F.avg(F.when(sell, (F.col("name") == anonymous).cast("double"))).alias("anon_sell"),
        F.avg(F.when(buy, (F.col("name") == anonymous).cast("double"))).alias("anon_buy"),
        F.count(F.when(low, 1)).alias("buyers_below"), F.coalesce(F.sum(when(low, "amount")), F.lit(0)).alias("depth_below"))
    mid = (F.col("best_ask") + F.col("best_bid")) / 2
    return g.withColumn("mid", mid).withColumn("spread_pct", (F.col("best_ask") - F.col("best_bid")) / mid * 100).withColumn(
        "count_ratio", div("n_buyers", "n_sellers")).withColumn("depth_ratio", div("buy_depth", "sell_depth"))


def fee_study(offers: DataFrame) -> DataFrame:
    """Shares of capped offers by count, value and units, break-even size and offers at the floor."""
    d = with_fees(offers)
    capped = F.col("fee_uncapped") > FEE["cap"]
    s = d.agg(F.count("*").alias("n"), F.avg(capped.cast("double")).alias("capped_by_count"),
              (F.sum(F.when(capped, F.col("value")).otherwise(0.0)) / F.sum("value")).alias("capped_by_value"),
              (F.sum(F.when(capped, F.col("amount")).otherwise(0)) / F.sum("amount")).alias("capped_by_units"),
              F.sum((F.col("fee_uncapped") < FEE["floor"]).cast("long")).alias("n_at_floor"), F.min("value").alias("min_value"), F.max("amount").alias("max_amount"))
    s = with_scalars(s, quantile_row(d, "price", {"median_price": 0.5}), "q")
    cap_units = FEE["cap"] / FEE["rate"] / F.col("q.median_price")
    return s.select("n", "capped_by_count", "capped_by_value", "capped_by_units", "n_at_floor", "min_value", "max_amount",
                    F.col("q.median_price").alias("median_price"), cap_units.alias("cap_binds_units"), S.lot_ceil(cap_units, LOT).alias("cap_binds_lot"))


def round_trip_by_size(offers: DataFrame, k: int = 10) -> DataFrame:
    """Median size and round-trip fee per size decile; the deciles and medians are exact at any size."""
    d = quantile_bins(with_fees(offers).withColumn("amount", F.col("amount").cast("double")), "amount", k, "decile")
    a = quantile_wide(d, "amount", {"median_amount": 0.5}, ["decile"])
    e = quantile_wide(d, "eff_rate_pct", {"med_rate": 0.5}, ["decile"])
    return a.join(e, "decile").select("decile", "median_amount", (2 * F.col("med_rate")).alias("roundtrip_pct"))


def size_bands(offers: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Offers, units and buy share per size band, with the share of all buy units."""
    d = offers.withColumn("band", S.cut_bins("amount", edges, labels))
    buy = F.col("side") == "buy"
    g = d.groupBy("band").agg(F.count("*").alias("offers"), F.sum("amount").alias("units"), F.sum(F.when(buy, F.col("amount")).otherwise(0)).alias("buy_units"))
    g = with_scalars(g, g.agg(F.sum("units").alias("u"), F.sum("buy_units").alias("b")), "t")
    return g.select("band", "offers", "units", div("units", "t.u").alias("unit_share"), div("buy_units", "units").alias("buy_share"), div("buy_units", "t.b").alias("share_of_buying"))


def executable_depth(offers: DataFrame, summary: DataFrame, flow: DataFrame, near: float = 0.05, entity="entity") -> DataFrame:
    """Buy depth near the reference price against total buy depth and a day's flow, per entity."""
    b = offers.where("side = 'buy'").join(summary.select(entity, "ref"), entity)
    ok = F.col("price") / F.col("ref") - 1 > -near
    g = b.groupBy(entity).agg(F.sum("amount").alias("depth"), F.coalesce(F.sum(F.when(ok, F.col("amount"))), F.lit(0)).alias("near_depth"))
    return g.join(flow, entity).select(entity, "depth", "near_depth", div("near_depth", "depth").alias("near_share"), div("depth", "flow").alias("depth_over_flow"))


def venues(pools: DataFrame, venue: str, depth: str, price: str) -> DataFrame:
    """Totals per table of pools: number, summed depth, the deepest pool's name and price, price range."""
    return pools.agg(F.count("*").alias("n_pools"), F.sum(depth).alias("depth"), F.max_by(venue, F.struct(depth, venue)).alias("deepest"),
                     F.max_by(price, F.struct(depth, venue)).alias("price"), F.min(price).alias("price_lo"), F.max(price).alias("price_hi"))
