"""Signal studies on the deviation panel: grids, holdouts, episodes, capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.num import div, sign
from gridloom.operators import windows as W
from gridloom.operators.inference import independent_windows, nw_mean, nw_panel
from gridloom.operators.joins import with_scalars
from gridloom.operators.quantiles import exact_quantiles, quantile_bins
from gridloom.session import materialise

# fixed values: round-trip costs of a small offer and of one above the fee cap; entry band
COSTS = {"small offer": 0.04, "above the fee cap": 0.01}
LARGE = 0.01
BAND = 0.02


def signals(df: DataFrame, horizons: Sequence[int], delay: int = 0, entity="entity", date="date") -> DataFrame:
    """One row per (entity, date, h): gap known yesterday, gross convergence over the next h rows.

    ``delay`` moves entry that many rows later, so the signal day is never the entry day.
    """
    w = W.series(entity, date)
    lag = F.lag("dev").over(w)
    entry = F.lead("dev", delay).over(w) if delay else F.col("dev")
    cells = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead("dev", h + delay).over(w) - entry).alias("fwd"),
                               (F.lead("logp", h).over(w) - F.col("logp")).alias("hold")) for h in horizons])
    d = df.select(entity, date, "dev", lag.alias("dev_lag"), cells.alias("cells"))
    d = d.select(entity, date, "dev", "dev_lag", F.abs("dev_lag").alias("absdev"), F.explode("cells").alias("c"))
    return d.select(entity, date, "dev", "dev_lag", "absdev", "c.h", "c.fwd", "c.hold").withColumn("gross", -sign("dev_lag") * F.col("fwd"))


def qualifying(sig: DataFrame, band: float = BAND) -> DataFrame:
    return sig.where((F.col("absdev") > band) & F.col("gross").isNotNull())


def deciles(sig: DataFrame, value: str = "absdev", k: int = 10) -> DataFrame:
    """Signal-strength bins per horizon (exact edges)."""
    return quantile_bins(materialise(sig, "signals"), value, k, "decile", ["h"])


def score(trades: DataFrame, by: Sequence[str], date="date") -> DataFrame:
    """Mean gross and net, hit rate, naive t, HAC t of the per-date mean with h lags, windows."""
    by = list(by)
    trades = materialise(trades.select(*by, *[c for c in (date, "h", "absdev", "gross", "net") if c not in by]), "trades")
    g = trades.groupBy(*by).agg(
        F.count("*").alias("n"), (F.avg("absdev") * 100).alias("mean_absdev_pct"), (F.avg("gross") * 100).alias("gross_pct"),
        (F.avg("net") * 100).alias("net_pct"), F.avg((F.col("net") > 0).cast("double")).alias("share_profitable"),
        (F.avg("net") / (F.stddev("net") / F.sqrt(F.count("net")))).alias("t_naive"))
    s = nw_panel(trades, "net", date, by, "h").select(*by, F.col("t").alias("t_stat"))
    w = independent_windows(trades, date, F.col("h"), by)
    return g.join(s, by).join(w, by)


def with_cost(trades: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("basis"), F.lit(v).alias("cost")) for k, v in costs.items()])).alias("c")
    d = trades.select(*trades.columns, c)
    return d.select(*trades.columns, "c.basis", "c.cost").withColumn("net", F.col("gross") - F.col("cost"))


def signal_grid(df: DataFrame, horizons: Sequence[int], band: float = BAND, costs: dict[str, float] = COSTS) -> DataFrame:
    """Decile x horizon x cost table."""
    return score(with_cost(deciles(qualifying(signals(df, horizons), band)), costs), ["h", "decile", "basis"])


def top_bin(df: DataFrame, horizons: Sequence[int], band: float = BAND, delay: int = 0, cost: float = LARGE) -> DataFrame:
    """Trades of the widest decile per horizon with their net return."""
    d = deciles(qualifying(signals(df, horizons, delay), band))
    return d.where("decile = 10").withColumn("net", F.col("gross") - cost)


def overlap_inflation(trades: DataFrame) -> DataFrame:
    return score(trades, ["h"]).withColumn("inflation", div("t_naive", "t_stat"))


def concentration_by_entity(trades: DataFrame, top: int = 5, entity="entity") -> DataFrame:
    """Entities used and profitable, share of trades in the best five."""
    e = trades.groupBy(entity).agg(F.avg("net").alias("m"), F.count("*").alias("c"))
    best = e.orderBy(F.col("m").desc(), entity).limit(top).agg(F.sum("c").alias("top_c"))
    s = e.agg(F.count("*").alias("entities"), F.sum((F.col("m") > 0).cast("long")).alias("profitable"), F.sum("c").alias("trades"))
    return with_scalars(s, best, "b").select("entities", "profitable", "trades", div("b.top_c", "trades").alias("top_share"))


def long_only(df: DataFrame, horizons: Sequence[int], band: float = BAND) -> DataFrame:
    """Holding return of cheap entities against the same day's average, per-date pairs with a HAC t."""
    s = materialise(signals(df, horizons).where("hold is not null and dev_lag is not null"), "hold")
    cheap = F.when(F.col("dev_lag") < -band, F.col("hold"))
    rich = F.when(F.col("dev_lag") > band, F.col("hold"))
    d = s.groupBy("h", "date").agg((F.avg(cheap) - F.avg("hold")).alias("paired")).where("paired is not null")
    m = s.groupBy("h").agg((F.avg(cheap) * 100).alias("cheap_pct"), (F.avg("hold") * 100).alias("any_pct"), (F.avg(rich) * 100).alias("rich_pct"), F.count(cheap).alias("n_cheap"))
    t = nw_mean(d, "paired", "date", ["h"], "h").select("h", (F.col("mean") * 100).alias("paired_pct"), "t", F.col("n").alias("n_dates"))
    pos = d.groupBy("h").agg(F.avg((F.col("paired") > 0).cast("double")).alias("share_positive"))
    return m.join(t, "h").join(pos, "h")


def episodes(sig: DataFrame, max_gap: int = 7, entity="entity", date="date") -> DataFrame:
    """Runs of qualifying days per entity, broken by more than ``max_gap`` days."""
    d = W.sessions(sig, max_gap, "episode", entity, date)
    return d.groupBy(entity, "episode").agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count("*").alias("days"),
                                            F.avg("absdev").alias("mean_dev"), F.avg("gross").alias("gross"))


def disjoint_t(ep: DataFrame, h: int, cost: float = LARGE) -> DataFrame:
    """t over means of disjoint h-day bins of episode starts."""
    d = with_scalars(ep, ep.agg(F.min("start_date").alias("d0")), "s")
    b = d.groupBy(F.floor(F.datediff("start_date", "s.d0") / h).alias("bin")).agg(F.avg(F.col("gross") - cost).alias("m"))
    return nw_mean(b, "m", "bin", (), 1).select("n", "mean", "t")


def capacity(ep: DataFrame, span: DataFrame, lot: float, price: DataFrame, net_pct: DataFrame) -> DataFrame:
    """Episodes per month times one lot, at the last price and mean net; every input is a one-row table."""
    s = with_scalars(ep.agg(F.count("*").alias("episodes")), span, "d")
    s = with_scalars(with_scalars(s, price, "p"), net_pct, "r")
    per_month = F.col("episodes") / (F.datediff("d.hi", "d.lo") / 30.44)
    units = per_month * lot
    return s.select("episodes", per_month.alias("per_month"), units.alias("units_per_month"), (units * F.col("p.price")).alias("value_per_month"),
                    (units * F.col("p.price") * F.col("r.net_pct") / 100).alias("expected_per_month"))


def split_date(df: DataFrame, share: float = 0.70, date="date") -> DataFrame:
    """One row: the date at the given rank of the distinct dates."""
    from pyspark.sql import Window

    d = df.select(date).distinct().withColumn("g", F.lit(1))
    w = Window.partitionBy("g")
    d = d.withColumn("i", F.row_number().over(w.orderBy(date)) - 1).withColumn("n", F.count("*").over(w))
    return d.agg(F.max(F.when(F.col("i") == F.floor(F.col("n") * share), F.col(date))).alias("split"))


def holdout(df: DataFrame, horizons: Sequence[int], band: float = BAND, share: float = 0.70, q: float = 0.9, cost: float = LARGE) -> DataFrame:
    """The cutoff comes from purged training rows alone; both periods are scored at it."""
    sig = signals(df, horizons).where("gross is not null and dev_lag is not null")
    sig = with_scalars(sig, split_date(df, share), "s")
    period = F.when(F.col("date") <= F.expr("date_sub(s.split, h)"), "train").when(F.col("date") > F.col("s.split"), "holdout")
    sig = materialise(sig.withColumn("period", period).where("period is not null").drop("s"), "holdout")
    cut = exact_quantiles(sig.where((F.col("period") == "train") & (F.col("absdev") > band)), "absdev", [q], ["h"]).select("h", F.col("q").alias("cutoff"))
    t = sig.join(F.broadcast(cut), "h").where("absdev >= cutoff").withColumn("net", F.col("gross") - cost)
    return score(t, ["h", "period"]).join(cut, "h")


def dispersion_regime(df: DataFrame, horizons: Sequence[int], within: bool = False, band: float = BAND, share: float = 0.70, cost: float = LARGE) -> DataFrame:
    """The widest decile split by terciles of the day's dispersion, pooled or inside each period."""
    disp = df.groupBy("date").agg(F.stddev("dev").alias("disp"))
    sig = signals(df, horizons).where("gross is not null and dev_lag is not null").join(disp, "date").where("disp is not null")
    if within:
        sig = with_scalars(sig, split_date(df, share), "s")
        sig = sig.withColumn("period", F.when(F.col("date") <= F.col("s.split"), "train").otherwise("holdout")).drop("s")
    else:
        sig = sig.withColumn("period", F.lit("all"))
    keys = ["period", "h"]
    sig = materialise(sig, "regime")
    cut = exact_quantiles(sig.where(F.col("absdev") > band), "absdev", [0.9], keys).select(*keys, F.col("q").alias("cutoff"))
    b = sig.join(F.broadcast(cut), keys).where("absdev >= cutoff").withColumn("net", F.col("gross") - cost)
    b = materialise(quantile_bins(materialise(b, "regime"), "disp", 3, "tercile", keys), "regime")
    out = score(b, [*keys, "tercile"])
    return out.join(b.groupBy(*keys, "tercile").agg((F.avg("disp") * 100).alias("mean_disp_pct")), [*keys, "tercile"])


def selector_comparison(df: DataFrame, horizons: Sequence[int], cost: float = LARGE) -> DataFrame:
    """Top decile by raw gap against gap over the day's dispersion."""
    disp = df.groupBy("date").agg(F.stddev("dev").alias("disp"))
    sig = signals(df, horizons).where("gross is not null and dev_lag is not null").join(disp, "date").where("disp > 0")
    sel = F.explode(F.array(F.struct(F.lit("raw").alias("selector"), F.col("absdev").alias("v")),
                            F.struct(F.lit("normalised").alias("selector"), (F.col("absdev") / F.col("disp")).alias("v")))).alias("z")
    x = sig.select("entity", "date", "h", "absdev", "gross", sel).select("entity", "date", "h", "absdev", "gross", "z.selector", "z.v")
    x = materialise(x, "selector")
    cut = exact_quantiles(x, "v", [0.9], ["h", "selector"]).select("h", "selector", F.col("q").alias("cutoff"))
    t = x.join(F.broadcast(cut), ["h", "selector"]).where("v >= cutoff").withColumn("net", F.col("gross") - cost)
    return score(t, ["h", "selector"])
