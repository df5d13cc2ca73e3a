"""Ordered-window operators over (entity, date) series.

Inputs are at (entity, date) grain, so a window partition is one entity's series and is bounded
by the length of the calendar however many raw rows the entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.num import col, div
from gridloom.operators.joins import with_group
from gridloom.session import materialise


def series(entity="entity", date="date"):
    e = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*e).orderBy(date)


def trailing(w, n: int, lag: int = 0):
    return w.rowsBetween(-(n - 1) - lag, -lag)


def guarded(value: Column, cnt: Column, k: int) -> Column:
    return F.when(cnt >= k, value)


def row_lag(df: DataFrame, value: str, out: str, n: int = 1, entity="entity", date="date") -> DataFrame:
    return df.withColumn(out, F.lag(value, n).over(series(entity, date)))


def gap_checked_return(df: DataFrame, price: str, out: str = "ret", max_gap: int = 1,
                       entity="entity", date="date") -> DataFrame:
    """Log return, NULL when the previous observation is more than ``max_gap`` days back."""
    w = series(entity, date)
    gap = F.datediff(date, F.lag(date).over(w))
    r = F.log(price) - F.lag(F.log(price)).over(w)
    return df.withColumn("gap_days", gap.cast("long")).withColumn(out, F.when(gap <= max_gap, r))


def rolling_median(value, n: int, min_obs: int, entity="entity", date="date") -> Column:
    """Centred median over n rows with a minimum number of observations."""
    f = series(entity, date).rowsBetween(-(n // 2), n // 2)
    return guarded(F.percentile(col(value), F.lit(0.5)).over(f), F.count(col(value)).over(f), min_obs)


def mad_scrub(df: DataFrame, value: str, win: int = 15, k: float = 5.0, floor: float = 0.12,
              min_obs: int = 5, entity="entity", date="date") -> DataFrame:
    """Null values further from the rolling median than max(k * rolling MAD, floor * median)."""
    d = df.withColumn("med", rolling_median(value, win, min_obs, entity, date))
    d = d.withColumn("_ad", F.abs(F.col(value) - F.col("med")))
    d = d.withColumn("mad", rolling_median("_ad", win, min_obs, entity, date))
    limit = F.greatest(k * F.col("mad"), floor * F.col("med"))
    bad = F.col("_ad") > limit
    return d.withColumn("is_outlier", F.coalesce(bad, F.lit(False))).withColumn(
        f"{value}_clean", F.when(~F.col("is_outlier"), F.col(value))).drop("_ad")


def rolling(value, n: int, how: str, entity="entity", date="date", min_obs: int | None = None,
            lag: int = 0) -> Column:
    """Trailing mean / sd / sum / skew over n rows; ``min_obs`` defaults to max(2, n // 2)."""
    f = trailing(series(entity, date), n, lag)
    k = max(2, n // 2) if min_obs is None else min_obs
    c = col(value)
    cnt = F.count(c).over(f)
    if how == "mean":
        v = F.avg(c).over(f)
    elif how == "sd":
        v = F.stddev(c).over(f)
    elif how == "sum":
        v = F.sum(c).over(f)
    elif how == "skew":
        m, s = F.avg(c).over(f), F.stddev_pop(c).over(f)
        m3 = F.avg(c * c * c).over(f) - 3 * m * F.avg(c * c).over(f) + 2 * m * m * m
        v = F.when((cnt > 2) & (s > 0), m3 / (s * s * s) * F.sqrt(cnt * (cnt - 1)) / (cnt - 2))
    else:
        raise ValueError(how)
    return guarded(v, cnt, k)


def ewma(df: DataFrame, value: str, half_life: float, out_mean: str, out_sd: str, min_obs: int = 3,
         entity="entity", date="date") -> DataFrame:
    """Bias-adjusted exponential mean and sd over the whole past; NULLs keep their age but carry no weight.

    The mean is a ratio of decayed running sums.  Inside a block of rows the weights are powers
    relative to the block's start, so a plain running sum does; the sums of earlier blocks are
    carried over, one short array per entity.
    """
    size = max(1, int(round(16 * half_life)))
    lam = 0.5 ** (1.0 / half_life)
    x = F.col(value)
    d = df.withColumn("_i", F.row_number().over(series(entity, date)) - 1)
    d = d.withColumn("_k", F.floor(F.col("_i") / size)).withColumn("_o", F.col("_i") % size)
    up = F.pow(F.lit(1 / lam), F.col("_o"))
    one = x.isNotNull().cast("double")
    parts = {"n": one, "w": one * up, "w2": one * up * up, "x": F.coalesce(x, F.lit(0.0)) * up, "xx": F.coalesce(x * x, F.lit(0.0)) * up}
    fade = {"n": 1.0, "w": lam, "w2": lam * lam, "x": lam, "xx": lam}
    inside = Window.partitionBy(entity, "_k").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    blocks = d.groupBy(entity, "_k").agg(*[(F.sum(c) * fade[p] ** size).alias(p) for p, c in parts.items()])
    blocks = blocks.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("_k", *parts))).alias("_b"))
    step = ", ".join(f"'{p}', a.{p} * {fade[p] ** size!r}D + b.{p}" for p in parts)
    zero = ", ".join(f"'{p}', 0D" for p in parts)
    carry = F.expr(f"aggregate(_b, array(named_struct({zero})), (s, b) -> array_append(s, transform(array(element_at(s, -1)), a -> named_struct({step}))[0]))")
    d = d.join(blocks.select(F.col(entity).alias("_e"), carry.alias("_c")), F.col(entity).eqNullSafe(F.col("_e")), "left")
    # the sums as of a row: those inside its block and the carried ones, both brought to the row's age
    for p, c in parts.items():
        down = F.pow(F.lit(fade[p]), F.col("_o"))
        d = d.withColumn(f"_{p}", down * (F.sum(c).over(inside) + F.get(F.col("_c"), F.col("_k").cast("int"))[p]))
    mean = F.col("_x") / F.col("_w")
    var = (F.col("_xx") / F.col("_w") - mean * mean) * F.col("_w") * F.col("_w") / (F.col("_w") * F.col("_w") - F.col("_w2"))
    ok = F.col("_n") >= min_obs
    return d.withColumn(out_mean, F.when(ok, mean)).withColumn(out_sd, F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0))))).select(*df.columns, out_mean, out_sd)


def running_sum(df: DataFrame, value: str, out: str, entity="entity", date="date") -> DataFrame:
    f = series(entity, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(f))


def drawdown(df: DataFrame, value: str, out: str = "drawdown", entity="entity", date="date") -> DataFrame:
    f = series(entity, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.col(value) / F.max(value).over(f) - 1)


def cross_deviation(df: DataFrame, value: str, out: str = "dev", min_entities: int = 10, date="date") -> DataFrame:
    d = with_group(df, [date], _n=F.count(value), _m=F.avg(value))
    return d.withColumn(out, F.when(F.col("_n") >= min_entities, F.col(value) - F.col("_m"))).drop("_n", "_m")


def cross_rank_pct(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Average rank divided by the group's non-null count."""
    from gridloom.operators.quantiles import running

    keys = [f"_g{i}" for i in range(len(by))]
    rank = running(df, value, by)
    rank = rank.select(*[F.col(k).alias(g) for k, g in zip(by, keys)], F.col("v").alias("_v"), ((F.col("c_w") - (F.col("w") - 1) / 2.0) / F.col("g_w")).alias(out))
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(by, keys)]
    return df.join(rank, [*same, F.col(value).cast("double") == F.col("_v")], "left").drop(*keys, "_v")


def cross_section(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """z-score, distance from the median and average-rank share of every row inside its group.

    One range partitioning of the distinct (group, value) serves median and ranks; mean and spread
    are group aggregates.  No group is gathered, however many entities one date has.
    """
    from gridloom.operators.quantiles import running

    keys = [f"_g{i}" for i in range(len(by))]
    run = materialise(running(df, value, by), "cross").select(*[F.col(k).alias(g) for k, g in zip(by, keys)], F.col("v").alias("_v"), "w", "c_w", "g_w")
    # the ranks (from 0) of the two middle values; a value with copies holds several
    lo, mid = F.col("c_w") - F.col("w"), (F.col("g_w") - 1) / 2.0
    holds = lambda k: F.max(F.when((lo <= k) & (k < F.col("c_w")), F.col("_v")))
    stats = run.groupBy(*keys).agg(((holds(F.floor(mid)) + holds(F.ceil(mid))) / 2.0).alias("_med"))
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(by, keys)]
    d = with_group(df, by, _m=F.avg(value), _s=F.stddev(value)).join(stats, same, "left").drop(*keys)
    rank = run.select(*keys, "_v", ((F.col("c_w") - (F.col("w") - 1) / 2.0) / F.col("g_w")).alias("rank_pct"))
    d = d.join(rank, [*same, F.col(value).cast("double") == F.col("_v")], "left").drop(*keys, "_v")
    return d.select(*df.columns, div(F.col(value) - F.col("_m"), F.col("_s")).alias("z"), (F.col(value) - F.col("_med")).alias("from_median"), "rank_pct")


def sessions(df: DataFrame, max_gap: int, out: str = "episode", entity="entity", date="date") -> DataFrame:
    """Episode number per entity; a new one starts when the gap exceeds ``max_gap`` days."""
    w = series(entity, date)
    gap = F.datediff(date, F.lag(date).over(w))
    new = (F.coalesce(gap, F.lit(999)) > max_gap).cast("long")
    d = df.withColumn("_new", new)
    return d.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def bounded_fill(df: DataFrame, value: str, out: str, limit: int, how: str = "ffill",
                 entity="entity", date="date") -> DataFrame:
    """Forward fill or linear interpolation on a regular grid, at most ``limit`` rows into a gap."""
    w = series(entity, date)
    mark = F.when(F.col(value).isNotNull(), F.col(date))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # the look ahead runs on the reversed order: a running frame is linear, a shrinking one is not
    ent = [entity] if isinstance(entity, str) else list(entity)
    ahead = Window.partitionBy(*ent).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
    pv, pd_ = F.last(value, True).over(back), F.last(mark, True).over(back)
    since = F.datediff(date, pd_)
    if how == "ffill":
        return df.withColumn(out, F.when(since <= limit, pv))
    nv, nd = F.last(value, True).over(ahead), F.last(mark, True).over(ahead)
    span = F.datediff(nd, pd_)
    lin = F.when(span == 0, pv).otherwise(pv + (nv - pv) * since / span)
    return df.withColumn(out, F.when((since <= limit) & nv.isNotNull(), lin))


def chain_index(df: DataFrame, logp: str, min_entities: int = 10, weight: str | None = None,
                entity="entity", date="date") -> DataFrame:
    """Date-grain index: basket mean, chain-linked index over stayers, optional volume weights.

    A stayer is an entity seen on this date and on the table's previous date.  The window without
    partition runs on one row per date only.
    """
    days = df.groupBy(date).agg(F.count(logp).alias("n_entities"), F.avg(logp).alias("basket_log"),
                                F.stddev(logp).alias("disp"), F.lit(1).alias("g"))
    wd = Window.partitionBy("g").orderBy(date)
    days = days.withColumn("prev_date", F.lag(date).over(wd))
    w = series(entity, date)
    step = df.select(date, (F.col(logp) - F.lag(logp).over(w)).alias("d"), F.lag(date).over(w).alias("own_prev"),
                     F.col(logp).alias("lp"), (F.col(weight) if weight else F.lit(1.0)).alias("wt"))
    j = step.join(days.select(date, "prev_date"), date)
    stay = F.col("own_prev") == F.col("prev_date")
    agg = j.groupBy(date).agg(
        F.avg(F.when(stay, F.col("d"))).alias("chain_ret"), F.count(F.when(stay, 1)).alias("n_pairs"),
        F.sum((F.col("d") > 0).cast("int")).alias("n_up"),
        (F.sum(F.col("lp") * F.col("wt")) / F.sum("wt")).alias("vw_log"))
    d = days.join(agg, date)
    run = wd.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("n_entities") >= min_entities
    d = d.withColumn("first_ok", F.min(F.when(ok, F.col(date))).over(Window.partitionBy("g")))
    d = d.withColumn("base", F.max(F.when(F.col(date) == F.col("first_ok"), F.col("basket_log"))).over(Window.partitionBy("g")))
    inc = F.when(F.col(date) > F.col("first_ok"), F.coalesce(F.col("chain_ret"), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("chain_log", F.when(F.col(date) >= F.col("first_ok"), F.col("base") + F.sum(inc).over(run)))
    return d.select(date, "n_entities", "n_pairs", "n_up", "basket_log", "vw_log", "chain_ret", "chain_log",
                    F.when(ok, F.col("disp")).alias("disp"), ok.alias("index_valid"))


def technicals(df: DataFrame, price: str, entity="entity", date="date") -> DataFrame:
    """MA50, MA200, simple RSI14, Bollinger z on 20 rows."""
    w = series(entity, date)

    def full(v, n):
        f = trailing(w, n)
        return guarded(F.avg(v).over(f), F.count(v).over(f), n)

    d = df.withColumn("_d", F.col(price) - F.lag(price).over(w))
    d = d.withColumn("_up", F.greatest(F.col("_d"), F.lit(0.0))).withColumn("_dn", F.greatest(-F.col("_d"), F.lit(0.0)))
    d = d.withColumn("_up", F.when(F.col("_d").isNotNull(), F.col("_up"))).withColumn(
        "_dn", F.when(F.col("_d").isNotNull(), F.col("_dn")))
    up, dn = full(F.col("_up"), 14), full(F.col("_dn"), 14)
    f20 = trailing(w, 20)
    sd = guarded(F.stddev(price).over(f20), F.count(price).over(f20), 20)
    return d.select(
        *df.columns, full(F.col(price), 50).alias("ma50"), full(F.col(price), 200).alias("ma200"),
        F.when(dn > 0, 100 - 100 / (1 + up / dn)).alias("rsi14"),
        F.when(sd > 0, (F.col(price) - full(F.col(price), 20)) / sd).alias("bb_z"))
