"""Feature and target columns over the panel; each block is one select on a shared window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.num import div, log_floor, safe_corr
from gridloom.operators import windows as W
from gridloom.operators.joins import enrich, nearest_marks, signed_distance, with_group, with_scalars
from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.series_plan import SeriesPlan, one_hot
from gridloom.session import materialise


def shift_features(df: DataFrame, cols: Sequence[str], entity="entity", date="date") -> DataFrame:
    """Every listed feature moved one row back in one pass: nothing of the current day is left."""
    w = W.series(entity, date)
    return df.select(*[F.lag(c).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])


def leakage(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.25) -> DataFrame:
    """Correlation of each feature with the next target, one aggregate for all."""
    a = df.agg(*[safe_corr(f, target).alias(f) for f in features])
    return a.unpivot([], list(features), "feature", "corr").withColumn("ok", F.abs("corr") < limit)


def forward_targets(df: DataFrame, horizons: Sequence[int] = (1, 7, 30), move: float = 0.02, universe: str | None = None,
                    entity="entity", date="date") -> DataFrame:
    """Forward log returns, up/down flags, market-relative returns, forward volatility and its top quartile.

    The market's mean is that of the rows where ``universe`` holds.
    """
    w = W.series(entity, date)
    d = df.select(*df.columns, *[(F.lead("logp", h).over(w) - F.col("logp")).alias(f"y_ret{h}") for h in horizons],
                  W.guarded(F.stddev("ret_row").over(w.rowsBetween(1, 7)), F.count("ret_row").over(w.rowsBetween(1, 7)), 5)
                  .alias("_v"))
    d = d.withColumn("y_vol7", F.col("_v") * F.sqrt(F.lit(365.0))).drop("_v")
    inside = F.lit(True) if universe is None else F.col(universe)
    d = materialise(d, "targets")
    d = with_group(d, [date], **{f"_m{h}": F.avg(F.when(inside, F.col(f"y_ret{h}"))) for h in horizons})
    top = exact_quantiles(d, "y_vol7", [0.75])
    d = with_scalars(d, top.agg(F.max("q").alias("q")), "_top")
    out = []
    for h in horizons:
        y = F.col(f"y_ret{h}")
        out += [F.when(y.isNotNull(), (y > move).cast("double")).alias(f"y_up{h}"),
                F.when(y.isNotNull(), (y < -move).cast("double")).alias(f"y_dn{h}"), (y - F.col(f"_m{h}")).alias(f"y_rel{h}")]
    high = F.when(F.col("y_vol7").isNotNull(), (F.col("y_vol7") > F.col("_top.q")).cast("double")).alias("y_hivol7")
    return d.select(*[x for x in d.columns if not x.startswith("_")], *out, high)


#: Columns that enter in logs, with their growth over 7 and 30 rows.
ACTIVITY = ("n", "volume", "returned", "suppliers", "value", "per_head")


def date_marks(calendar: DataFrame, dates: DataFrame, date="date") -> DataFrame:
    """Per date: event flags, signed days to the nearest event and release, windows around releases (date grain)."""
    flags = calendar.select(date, F.col("ev_month_end").alias("release"), "ev_urgent", "n_urgent")
    d = dates.select(date).distinct().join(flags, date, "left").fillna(0, ["release", "ev_urgent", "n_urgent"])
    d = d.withColumn("ev_any", F.greatest("release", "ev_urgent")).withColumn("n_events", F.col("release") + F.col("ev_urgent"))
    d = signed_distance(d, flags.where("greatest(release, ev_urgent) > 0"), date, "days_to_event")
    d = signed_distance(d, flags.where("release > 0"), date, "days_to_release")
    near = nearest_marks(d, flags.where("release > 0"), date)
    ahead, behind = F.datediff("next_mark", date), F.datediff(date, "prev_mark")
    within = lambda x, lo, n: F.coalesce(x.between(lo, n), F.lit(False)).cast("double")
    near = near.select(date, *[within(ahead, 1, n).alias(f"pre_release_{n}") for n in (7, 14, 30)], *[within(behind, 0, n).alias(f"post_release_{n}") for n in (14, 30)])
    return d.join(near, date)


def feature_block(fund: DataFrame, dim: DataFrame, calendar: DataFrame, regions: Sequence[str], kinds: Sequence[str] = (), tiers: Sequence[str] = (),
                  entity="entity", date="date") -> DataFrame:
    """(entity, date) and all features of the row: what was known when the row before it ended.

    Price history, activity, liquidity, calendar, events, structure, cross-section and interactions.
    Calendar, structure and distances to dated events belong to the row's own day.
    """
    c = F.col
    pop = F.greatest(c("population"), F.lit(1)).cast("double")
    marks = materialise(date_marks(calendar, fund, date), "marks")
    static = dim.select(entity, "region", "kind", "tier", "created", "population", "mean_balance", "premium_share")
    d = enrich(enrich(fund, static, [entity]), marks, [date], spread=entity)
    d = d.withColumn("per_head", c("n") / pop).withColumn("logp", F.log("price"))
    d = d.select("*", *[log_floor(x).alias(f"log_{x}") for x in ACTIVITY], (c("logp") - F.lag("logp").over(W.series(entity, date))).alias("ret"),
                 *[F.log(F.greatest(F.coalesce(c(f"{x}_qty"), F.lit(0.0)), F.lit(0.0)) + 1).alias(f"log_{x}") for x in ("sell", "buy")],
                 *[c(f"{x}_qty").isNotNull().cast("double").alias(f"has_{x}") for x in ("sell", "buy")],
                 div(c("returned"), c("volume")).alias("returned_share"), (c("volume") / c("n")).alias("lot"), (c("returned") / F.greatest(c("n"), F.lit(1.0)) * 1e4).alias("return_ratio"),
                 (F.coalesce(c("buy_qty"), F.lit(0.0)) / pop).alias("demand"), div(c("sell_qty") - c("buy_qty"), c("sell_qty") + c("buy_qty")).alias("imbalance"), (c("volume") / pop).alias("engaged"))
    p = SeriesPlan(entity, date)
    for k in (1, 2, 3, 5, 7, 14, 21):
        p.add(f"ret_lag{k}", p.past("ret", k - 1))
    for n in (7, 14, 30):
        p.add(f"ret_mean{n}", p.rolling("ret", n, "mean"))
        p.add(f"ret_sd{n}", p.rolling("ret", n, "sd"))
        p.add(f"mom{n}", p.growth("logp", n))
    for h in (3, 7, 14):
        p.faded("ret", h, f"ret_ew{h}")
    p.add("ret_skew30", p.rolling("ret", 30, "skew"))
    p.add("px_z30", div(p.past("logp") - p.rolling("logp", 30, "mean"), p.rolling("logp", 30, "sd")))
    for n in (30, 90):
        p.add(f"dist_ma{n}", p.past("logp") - p.rolling("logp", n, "mean"))
    growth = {}
    for x in ACTIVITY:
        p.add(f"log_{x}", p.past(f"log_{x}"))
        for n in (7, 30):
            growth[x, n] = p.growth(f"log_{x}", n)
            p.add(f"g{n}_{x}", growth[x, n])
    for x in ("returned_share", "supplier_hhi", "top_share", "lot", "return_ratio", "log_sell", "has_sell", "log_buy", "has_buy", "imbalance", "ev_any", "ev_urgent", "n_events", "n_urgent",
              *(f"pre_release_{n}" for n in (7, 14, 30)), *(f"post_release_{n}" for n in (14, 30))):
        p.add(x, p.past(x).cast("double"))
    p.add("release", p.past("release").cast("double"))
    p.add("inflation_pressure", growth["n", 7] - growth["volume", 7])
    p.add("premium_demand", p.past("demand"))
    p.add("premium_demand_7", p.rolling("buy_qty", 7, "mean") / pop)
    p.add("turnover_7", p.rolling("sell_qty", 7, "mean") + p.rolling("buy_qty", 7, "mean"))
    p.add("engagement", p.past("engaged"))
    gap = p.since(c("returned") * 2 > c("volume"), "returns")
    described = p.past(date)
    p.add("never_marked", F.when(described.isNotNull(), gap.isNull().cast("double")))
    p.add("days_since_mark", F.when(described.isNotNull(), F.coalesce(gap, F.lit(9999)).cast("double")))
    p.add("recent_mark", F.when(described.isNotNull(), F.coalesce(gap.between(0, 90), F.lit(False)).cast("double")))
    for name, e, span in (("dow", F.weekday(date), 7), ("doy", F.dayofyear(date), 365)):
        p.add(f"{name}_sin", F.sin(2 * math.pi * e / span))
        p.add(f"{name}_cos", F.cos(2 * math.pi * e / span))
    p.add("is_weekend", (F.weekday(date) >= 5).cast("double"))
    p.add("month", F.month(date).cast("double"))
    p.add("days_to_event", c("days_to_event").cast("double"))
    p.add("days_to_release", c("days_to_release").cast("double"))
    p.add("event_soon", F.greatest(F.least(c("days_to_event"), F.lit(0)), F.lit(-14)) / -14.0)
    age = F.datediff(date, "created").cast("double")
    p.add("age", age)
    p.add("log_age", F.log1p(F.greatest(age, F.lit(0.0))))
    p.add("log_population", F.log(pop))
    p.add("log_balance", log_floor("mean_balance"))
    p.add("premium_share", c("premium_share"))
    for prefix, values in (("region", regions), ("kind", kinds), ("tier", tiers)):
        for name, e in one_hot(prefix, values, prefix).items():
            p.add(name, e)
    # of the day before the described one: each date's cross-section is built from what it knew, then moved with the rest
    for k in (1, 2):
        p.add(f"_p{k}", p._lag("logp", k))
        p.add(f"_r{k}", p._lag("ret", k))
        p.add(f"_a{k}", p._lag("log_n", k))
    p.add("_described", described)
    rows = materialise(p.select(d, [entity, date]), "features")
    up = F.coalesce((c("_r1") > 0), F.lit(False)).cast("double")
    cross = rows.groupBy(F.col(date).alias("_day")).agg(F.stddev("_p1").alias("xw_disp"), F.avg("_r1").alias("xw_ret"), F.avg(up).alias("breadth_up"), F.avg("_a1").alias("xw_activity"))
    mid = exact_quantiles(rows.select(F.col(date).alias("_day"), "_p1"), "_p1", [0.5], ["_day"]).select("_day", F.col("q").alias("xw_med_logp"))
    cross = materialise(cross.join(mid, "_day", "left").withColumnRenamed("_day", "_described"), "cross")  # a row per date
    out = enrich(p.exponentials(rows), cross, ["_described"], spread=entity)
    rel = c("_p2") - c("xw_med_logp")
    out = out.withColumns({"rel_premium": rel, "rel_premium_z": div(rel, c("xw_disp")), "beta_gap": c("_r2") - c("xw_ret"), "rel_activity": c("_a2") - c("xw_activity")})
    kind = F.coalesce(c(f"kind_{kinds[0].split()[0].lower()}"), F.lit(0.0)) if kinds else F.lit(0.0)
    out = out.withColumns({"activity_x_event": c("g7_n") * c("ev_any"), "activity_x_kind": c("g7_n") * kind, "premium_x_disp": rel * c("xw_disp"), "vol_x_breadth": c("ret_sd14") * c("breadth_up")})
    return out.drop(*[f"_{x}{k}" for x in "pra" for k in (1, 2)], "_described")


def deviation_features(df: DataFrame, entity="entity", date="date") -> DataFrame:
    """Lagged deviation, its rolling means and spread, return and rank: the scoring feature set."""
    w = W.series(entity, date)
    d = df.select(*df.columns, F.lag("dev").over(w).alias("dev_lag"),
                  *[W.rolling("dev", n, "mean", entity, date, min_obs=n, lag=1).alias(f"dev_mean{n}") for n in (3, 7)],
                  W.rolling("dev", 7, "sd", entity, date, min_obs=7, lag=1).alias("dev_sd7"),
                  F.lag("ret_row").over(w).alias("ret_lag"), F.lead("dev").over(w).alias("_next"))
    return d.withColumn("y", F.col("_next") - F.col("dev")).drop("_next")


def sequence_windows(df: DataFrame, cols: Sequence[str], look: int = 30, entity="entity", date="date") -> DataFrame:
    """The ``look`` rows before each row as an array of arrays; complete and finite windows only."""
    f = W.series(entity, date).rowsBetween(-look, -1)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = df.withColumn("_ok", ok.cast("int"))
    d = d.withColumn("seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(f))
    d = d.withColumn("_good", F.sum("_ok").over(f))
    return d.where((F.size("seq") == look) & (F.col("_good") == look)).drop("_ok", "_good")


def exposure_grid(df: DataFrame, logp: str, series: str, lags: Sequence[int], windows: Sequence[int], horizons: Sequence[int],
                  entity="entity", date="date") -> DataFrame:
    """One slope per exposure (lag or trailing mean) and horizon, all on the rows where every cell exists."""
    from gridloom.operators.moments import panel_ols

    w = W.series(entity, date)
    xs = {f"lag{k}": F.lag(series, k).over(w) for k in lags}
    xs |= {f"ma{n}": W.rolling(series, n, "mean", entity, date, min_obs=n, lag=1) for n in windows}
    ys = {h: F.lead(logp, h).over(w) - F.col(logp) for h in horizons}
    d = df.select(entity, date, *[e.alias(f"_x_{n}") for n, e in xs.items()], *[e.alias(f"_y_{h}") for h, e in ys.items()])
    d = d.dropna()
    cells = F.array(*[F.struct(F.lit(n).alias("exposure"), F.lit(h).alias("h"), F.col(f"_x_{n}").alias("x"), F.col(f"_y_{h}").alias("y")) for n in xs for h in ys])
    g = d.select(entity, date, F.explode(cells).alias("c")).select(entity, date, "c.*")
    return panel_ols(g, "y", ["x"], fe=[entity], cluster=[entity, date], by=["exposure", "h"])


def almon_terms(df: DataFrame, series: str, lags: int, degree: int, entity="entity", date="date") -> DataFrame:
    """Polynomial lag basis: term p is the sum of k^p times lag k; incomplete histories are dropped."""
    w = W.series(entity, date)
    d = df.select(*df.columns, *[F.lag(series, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    d = d.where(F.col(f"_l{lags}").isNotNull())
    out = []
    for p in range(degree + 1):
        e = F.lit(0.0)
        for k in range(1, lags + 1):
            e = e + float(k**p) * F.col(f"_l{k}")
        out.append(e.alias(f"almon{p}"))
    return d.select(*df.columns, *out)
