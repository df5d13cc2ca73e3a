"""Panel econometrics built on the moment kernel and date-grain series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import div, half_life, safe_corr
from gridloom.operators import windows as W
from gridloom.operators.inference import nw_mean, nw_panel, per_date_mean
from gridloom.operators.joins import leave_one_out, peer_mean, with_group, with_scalars
from gridloom.operators.moments import attach, coefficients, complete, demean, panel_ols, _lin
from gridloom.operators.quantiles import exact_quantiles, running
from gridloom.operators.resampling import draw_moments, morans_by_draw, sign_words
from gridloom.session import materialise

# fixed values: edges and labels of the gap bins
GAP_EDGES = (0.0, 0.02, 0.04, 0.06, 0.10)
GAP_LABELS = ("0-2%", "2-4%", "4-6%", "6-10%", ">10%")


# ------------------------------------------------------------------ deviation dynamics
def closures(df: DataFrame, dev: str = "dev", entity="entity", date="date", calendar_exact: bool = True) -> DataFrame:
    """Lagged absolute gap and its narrowing in percentage points."""
    w = W.series(entity, date)
    step = F.datediff(date, F.lag(date).over(w)) == 1 if calendar_exact else F.lit(True)
    d = df.withColumn("absdev", F.abs(dev)).withColumn("absdev_lag", F.when(step, F.lag(F.abs(dev)).over(w)))
    return d.withColumn("closure_pp", (F.col("absdev_lag") - F.col("absdev")) * 100)


def band_table(df: DataFrame, dev: str = "dev", edges: Sequence[float] = GAP_EDGES, labels: Sequence[str] = GAP_LABELS,
               min_n: int = 30, by: Sequence[str] = (), entity="entity", date="date", calendar_exact: bool = True) -> DataFrame:
    """Mean closure per gap bin with HAC error on the per-date series; thin bins stay without a mean."""
    by = list(by)
    d = closures(df, dev, entity, date, calendar_exact).withColumn("bin", S.cut_bins("absdev_lag", edges, labels))
    d = materialise(d.where("bin is not null and closure_pp is not null").select(*by, "bin", date, "closure_pp"), "bands")
    n = d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("closure_pp").alias("m"))
    s = nw_panel(d, "closure_pp", date, [*by, "bin"]).select(*by, "bin", F.col("mean").alias("date_mean"), "se", "t", F.col("n").alias("n_dates"))
    j = n.join(s, [*by, "bin"])
    ok = F.col("n") >= min_n
    return j.select(*by, "bin", "n", "n_dates", F.when(ok, F.col("m")).alias("closure_pp"),
                    F.when(ok, F.col("se")).alias("se"), F.when(ok, F.col("t")).alias("t"))


def first_positive_bin(bands: DataFrame, by: Sequence[str], labels: Sequence[str] = GAP_LABELS) -> DataFrame:
    """Lowest bin with a positive mean closure."""
    order = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return bands.groupBy(*by).agg(F.min_by("bin", F.when(F.col("closure_pp") > 0, order[F.col("bin")])).alias("first_positive_bin"))


def persistence(df: DataFrame, dev: str, horizons: Sequence[int], entity="entity", date="date") -> DataFrame:
    """Entity-effect slope of the deviation h calendar days ahead, and the implied half-life."""
    hh = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h")
    a = df.where(F.col(dev).isNotNull()).select(entity, date, F.col(dev).alias("x"), hh)
    b = df.where(F.col(dev).isNotNull()).select(entity, F.col(date).alias("_d"), F.col(dev).alias("y"), hh).select(
        entity, F.expr("date_sub(_d, h)").alias(date), "h", "y")
    r = panel_ols(a.join(b, [entity, date, "h"]), "y", ["x"], fe=[entity], cluster=[entity], by=["h"])
    return r.select("h", F.col("coef").alias("rho"), "se", "n", half_life("coef", F.col("h")).alias("half_life"))


def slope_by_spacing(df: DataFrame, dev: str, spacings: Sequence[int], entity="entity", date="date") -> DataFrame:
    """Slope of the forward change on the lagged deviation at several row spacings."""
    w = W.series(entity, date)
    arr = F.array(*[F.struct(F.lit(k).alias("k"), (F.lead(dev, k).over(w) - F.col(dev)).alias("y")) for k in spacings])
    d = df.select(F.lag(dev).over(w).alias("x"), arr.alias("a")).select("x", F.explode("a").alias("a"))
    d = d.select("x", F.col("a.k").alias("spacing"), F.col("a.y").alias("y")).where("x is not null and y is not null")
    return d.groupBy("spacing").agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))


# ------------------------------------------------------------------ threshold models
def threshold_grid(df: DataFrame, y: str, x: str, lo: float = 0.02, hi: float = 0.90, points: int = 60, entity="entity",
                   grid_of: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sums per candidate threshold from one scan.

    |x| falls into one of ``points`` + 1 buckets; per (entity, bucket) sums are accumulated over
    the buckets, so every threshold's regime sums are prefix sums and nothing is multiplied out
    over the rows.
    """
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, entity, F.col(x).alias("x"), F.col(y).alias("y"), F.abs(x).alias("ax"), F.signum(x).alias("s"))
    d = materialise(d, "threshold")
    probs = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    q = exact_quantiles(d if grid_of is None else grid_of, "ax", probs)
    grid = q.agg(F.array_sort(F.collect_set(F.round("q", 6))).alias("grid"))
    d = with_scalars(d, grid, "_g").withColumn("b", F.expr("size(filter(_g.grid, g -> g < ax))"))
    c = F.col
    terms = {"n": F.lit(1.0), "x": c("x"), "s": c("s"), "ax": c("ax"), "xx": c("x") * c("x"), "xy": c("x") * c("y"),
             "sy": c("s") * c("y"), "y": c("y"), "yy": c("y") * c("y")}
    cell = d.groupBy(*by, entity, "b").agg(*[F.sum(e).alias(k) for k, e in terms.items()])
    ent = with_scalars(cell.select(*by, entity).distinct(), grid, "_g")
    dense = ent.select(*by, entity, F.posexplode("_g.grid").alias("b", "gamma"))
    # the bucket above the last threshold belongs to every outside sum, so totals come apart
    tot = cell.groupBy(*by, entity).agg(*[F.sum(k).alias(f"t_{k}") for k in terms])
    j = dense.join(cell, [*by, entity, "b"], "left").join(tot, [*by, entity])
    run = Window.partitionBy(*by, entity).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    acc = j.select(*by, entity, "gamma", *[f"t_{k}" for k in terms], *[F.coalesce(F.sum(k).over(run), F.lit(0.0)).alias(f"i_{k}") for k in terms])
    n = c("t_n")
    out = lambda k: c(f"t_{k}") - c(f"i_{k}")
    # pull-to-edge regressor outside the band: x - gamma * sign(x)
    bx = out("x") - c("gamma") * out("s")
    bxx = out("xx") - 2 * c("gamma") * out("ax") + c("gamma") * c("gamma") * out("n")
    bxy = out("xy") - c("gamma") * out("sy")
    return acc.groupBy(*by, "gamma").agg(
        F.sum(n).alias("n"), F.sum(c("i_n")).alias("n_in"),
        (F.sum("t_yy") - F.sum(c("t_y") * c("t_y") / n)).alias("yy"),
        (F.sum("i_xx") - F.sum(c("i_x") * c("i_x") / n)).alias("g11"),
        (F.sum(out("xx")) - F.sum(out("x") * out("x") / n)).alias("g22"),
        (-F.sum(c("i_x") * out("x") / n)).alias("g12"),
        (F.sum("i_xy") - F.sum(c("i_x") * c("t_y") / n)).alias("r1"),
        (F.sum(out("xy")) - F.sum(out("x") * c("t_y") / n)).alias("r2"),
        (F.sum(bxx) - F.sum(bx * bx / n)).alias("bxx"), (F.sum(bxy) - F.sum(bx * c("t_y") / n)).alias("bxy"))


def threshold_ar(df: DataFrame, y: str, x: str, form: str = "two_regime", crit: float = 7.35, entity="entity",
                 by: Sequence[str] = (), **grid) -> DataFrame:
    """SSR, likelihood-ratio statistic and coefficients for every candidate threshold."""
    by = list(by)
    g = threshold_grid(df, y, x, entity=entity, by=by, **grid)
    c = F.col
    if form == "two_regime":
        det = c("g11") * c("g22") - c("g12") * c("g12")
        g = g.withColumn("rho_in", div(c("g22") * c("r1") - c("g12") * c("r2"), det)).withColumn(
            "rho_out", div(c("g11") * c("r2") - c("g12") * c("r1"), det))
        g = g.withColumn("ssr", c("yy") - c("rho_in") * c("r1") - c("rho_out") * c("r2"))
    else:
        g = g.withColumn("rho_in", F.lit(0.0)).withColumn("rho_out", div("bxy", "bxx"))
        g = g.withColumn("ssr", c("yy") - c("rho_out") * c("bxy"))
    best = F.min("ssr").over(Window.partitionBy(*by)) if by else None
    if best is None:
        g = with_scalars(g, g.agg(F.min("ssr").alias("best")), "_b")
        best = F.col("_b.best")
    lr = c("n") * (c("ssr") - best) / best
    return g.select(*by, "gamma", "n", "n_in", "rho_in", "rho_out", "ssr", lr.alias("lr"), (lr <= crit).alias("in_set"))


def threshold_estimate(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minimiser, its confidence set and coefficients."""
    k = F.struct(F.col("ssr"), "gamma")
    return curve.groupBy(*by).agg(
        F.min_by("gamma", k).alias("gamma"), F.min(F.when(F.col("in_set"), F.col("gamma"))).alias("lo"),
        F.max(F.when(F.col("in_set"), F.col("gamma"))).alias("hi"), F.min_by("rho_in", k).alias("rho_in"),
        F.min_by("rho_out", k).alias("rho_out"), F.min("ssr").alias("ssr"), F.max("n").alias("n"),
        F.min_by(F.col("n_in") / F.col("n"), k).alias("share_inside"))


def threshold_bootstrap(df: DataFrame, y: str, x: str, draws: int = 200, seed: int = 7, entity="entity", date="date", **grid) -> DataFrame:
    """Share of sign-flip draws under the linear null whose best two-regime gain reaches the observed one.

    A draw changes y alone, so all thresholds and draws come from one pass: the products of the regime
    regressors with y and each entity's sum of y (``signed_sums``).  Without rows everything is null.
    """
    c = F.col
    d = materialise(complete(df, [y, x], [entity, date]).select(entity, date, c(y).alias("y"), c(x).alias("x")), "bootstrap")
    g = materialise(threshold_grid(d, "y", "x", entity=entity, **grid), "grid")
    d = with_scalars(d, g.agg(F.array_sort(F.collect_set("gamma")).alias("grid")), "_g")
    d = d.select(entity, date, "x", "y", F.expr("size(filter(_g.grid, v -> v < abs(x)))").alias("bucket"), F.size("_g.grid").alias("_k"))
    # per entity: mean of y, and of each regressor as a prefix sum over the buckets
    cell = d.groupBy(entity, "bucket").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"), F.max("_k").alias("_k"))
    ent = cell.groupBy(entity).agg(F.collect_list(F.struct("bucket", "sx")).alias("at"), (F.sum("sy") / F.sum("n")).alias("ybar"), F.sum("n").alias("n"), F.max("_k").alias("_k"))
    upto = F.expr("transform(sequence(0, _k), i -> aggregate(filter(at, b -> b.bucket <= i), 0D, (s, b) -> s + b.sx) / n)")
    u = d.drop("_k").join(ent.select(entity, "ybar", upto.alias("means")), entity)
    _, beta, _ = coefficients(d, "y", ["x"], fe=[entity])
    u = attach(u, beta, ["beta"], [], True)
    fit = c("beta")[0] * (c("x") - F.element_at("means", -1))
    u = u.select(entity, c("bucket").cast("int").alias("bucket"), "x", "means", fit.alias("fit"), (c("y") - c("ybar") - fit).alias("res"), sign_words(draws, seed, entity, date).alias("words"))
    products, between = draw_moments(u, draws, entity)
    products = materialise(products, "products")

    # thresholds in order, then x itself, then y squared
    k = g.select((F.row_number().over(Window.orderBy("gamma")) - 1).alias("regressor"), "n", "g11", "g12", "g22")
    size = g.agg(F.count("*").cast("int").alias("size"))
    p = with_scalars(products, size, "_s")
    whole = p.where("regressor >= _s.size").groupBy("draw").agg(F.max(F.when(c("regressor") == c("_s.size"), c("value"))).alias("xy"), F.max(F.when(c("regressor") > c("_s.size"), c("value"))).alias("yy"))
    whole = whole.join(between, "draw").select("draw", "xy", (c("yy") - c("between")).alias("yy"))
    j = products.join(k, "regressor").join(whole, "draw").withColumn("r2", c("xy") - c("value"))
    det = c("g11") * c("g22") - c("g12") * c("g12")
    gain = div(c("g22") * c("value") * c("value") - 2 * c("g12") * c("value") * c("r2") + c("g11") * c("r2") * c("r2"), det)
    lin = c("yy") - div(c("xy") * c("xy"), c("g11") + 2 * c("g12") + c("g22"))
    f = j.groupBy("draw").agg(F.max("n").alias("n"), F.min(lin).alias("lin"), F.min(c("yy") - gain).alias("ssr"))
    f = f.select("draw", div(c("lin") - c("ssr"), c("ssr") / (c("n") - 2)).alias("f"))
    f = with_scalars(f, f.where("draw = 0").select("f"), "_o")
    drawn = c("draw") > 0
    return f.agg(F.max("_o.f").alias("f_obs"), F.avg(F.when(drawn, (c("f") >= c("_o.f")).cast("double"))).alias("p_boot"), F.sum(drawn.cast("long")).alias("draws"))


# ------------------------------------------------------------------ cross-section and events
def fama_macbeth(df: DataFrame, y: str, x: str, date="date", min_cross: int = 8, lags=None) -> DataFrame:
    """Mean of per-date slopes with HAC error."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    s = d.groupBy(date).agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("k")).where(F.col("k") >= min_cross)
    return nw_mean(s, "slope", date, (), lags)


def driscoll_kraay(df: DataFrame, y: str, x: str, fe: str, lags: int, date="date") -> DataFrame:
    """Single-regressor slope with errors from date-summed moments (robust to cross-sectional dependence)."""
    d = demean(complete(df, [y, x], [fe, date]), [y, x], [fe])
    m = d.agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("b"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.count("*").alias("n"))
    u = with_scalars(d, m, "m")
    h = u.groupBy(date).agg(F.sum(F.col(x) * (F.col(y) - F.col("m.b") * F.col(x))).alias("h"))
    # the moments add up to zero, so the HAC variance of their mean is the kernel sum
    s = with_scalars(nw_mean(h, "h", date, (), lags), m, "m")
    se = F.col("se") * F.col("n") / F.col("m.sxx")
    return s.select(F.col("m.b").alias("coef"), se.alias("se"), (F.col("m.b") / se).alias("t"), F.col("m.n").alias("n"), F.col("n").alias("n_dates"))


def welch(df: DataFrame, flag: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    g = df.groupBy(*by).agg(F.avg(on).alias("mean_on"), F.avg(off).alias("mean_off"), F.count(on).alias("n_on"), F.count(off).alias("n_off"),
                            F.variance(on).alias("v_on"), F.variance(off).alias("v_off"))
    t = (F.col("mean_on") - F.col("mean_off")) / F.sqrt(F.col("v_on") / F.col("n_on") + F.col("v_off") / F.col("n_off"))
    return g.select(*by, "mean_on", "mean_off", "n_on", "n_off", t.alias("t"))


def identification(df: DataFrame, flags: Sequence[str], date="date", tol: float = 1e-8) -> DataFrame:
    """Residual spread of each flag under date effects: a common date flag has none left and is not identified."""
    r = demean(df.select(date, *[F.col(f).cast("double").alias(f) for f in flags]), list(flags), [date])
    a = r.agg(*[F.stddev(f).alias(f) for f in flags])
    return a.unpivot([], list(flags), "flag", "residual_sd").withColumn("identified", F.col("residual_sd") > tol)


def morans_i(df: DataFrame, value: str, group: str, date="date") -> DataFrame:
    """Moran's I per date with same-group row-normalised weights; null where the values of a date do not differ."""
    d = with_group(df.where(F.col(value).isNotNull()), [date], _m=F.avg(value)).withColumn("_z", F.col(value) - F.col("_m"))
    p = peer_mean(d, [date, group], "_z", "_p")
    return p.where("_p is not null").groupBy(date).agg(div(F.sum(F.col("_z") * F.col("_p")), F.sum(F.col("_z") * F.col("_z"))).alias("moran"), F.count("*").alias("n"))


def morans_permutation(df: DataFrame, value: str, group: str, entity="entity", date="date", draws: int = 200, seed: int = 11) -> DataFrame:
    """Mean Moran's I over the dates against permutations of the values within each date."""
    m = morans_by_draw(df, value, group, entity, date, draws, seed).groupBy("draw").agg(F.avg("moran").alias("moran"))
    m = materialise(m, "moran")
    obs, m = m.where("draw = 0").select("moran"), m.where("draw > 0")
    m = with_scalars(m, obs, "o")
    return m.agg(F.max("o.moran").alias("moran"), F.avg("moran").alias("null_mean"), F.avg((F.col("moran") >= F.col("o.moran")).cast("double")).alias("p"),
                 F.count("*").alias("draws"))


def iv_ols(df: DataFrame, y: str, endog: str, instrument: str, exog: Sequence[str] = (), fe: Sequence[str] = (), cluster: Sequence[str] = (), weak: float = 10.0) -> DataFrame:
    """Two-stage least squares as two moment regressions; first-stage F of the instrument."""
    keep = list(dict.fromkeys([*fe, *cluster]))
    d = materialise(complete(df, [y, endog, instrument, *exog], keep), "iv")
    rows, beta, names = coefficients(d, endog, [instrument, *exog], fe=fe)
    first = panel_ols(d, endog, [instrument, *exog], fe=fe, cluster=cluster).where(F.col("term") == instrument)
    src = d.withColumn("const", F.lit(1.0)) if "const" in names else d
    # the fixed effects of the first stage drop out of the second, so the linear part is enough
    fitted = attach(src, beta, ["beta"], [], True).withColumn("fitted", _lin(names)).drop("beta")
    second = panel_ols(fitted, y, ["fitted", *exog], fe=fe, cluster=cluster)
    out = with_scalars(second, first.select((F.col("t") * F.col("t")).alias("f")), "s")
    return out.select("term", "coef", "se", "t", "n", F.col("s.f").alias("first_stage_f"), (F.col("s.f") < weak).alias("weak"))


# ------------------------------------------------------------------ per-entity series diagnostics
def adf(df: DataFrame, value: str, lags: int = 1, entity="entity", date="date") -> DataFrame:
    """Fixed-lag unit-root t-statistic per entity."""
    w = W.series(entity, date)
    d = df.withColumn("_dy", F.col(value) - F.lag(value).over(w)).withColumn("_l", F.lag(value).over(w))
    d = d.select(entity, "_dy", "_l", *[F.lag("_dy", i).over(w).alias(f"_d{i}") for i in range(1, lags + 1)])
    r = panel_ols(d, "_dy", ["_l", *[f"_d{i}" for i in range(1, lags + 1)]], by=[entity], bounded=False)
    return r.where("term = '_l'").select(entity, F.col("coef").alias("rho"), F.col("t").alias("adf_t"), "n")


def kpss(df: DataFrame, value: str, entity="entity", date="date") -> DataFrame:
    """Level-stationarity statistic with Bartlett lags floor(4 (n/100)^(1/4))."""
    wg, wo = Window.partitionBy(entity), W.series(entity, date)
    d = df.where(F.col(value).isNotNull()).select(entity, date, value, F.count(value).over(wg).alias("n"), (F.col(value) - F.avg(value).over(wg)).alias("e"))
    d = d.withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(0.25))).cast("int"))
    s = d.withColumn("c", F.sum("e").over(wo.rowsBetween(Window.unboundedPreceding, 0))).groupBy(entity).agg(F.sum(F.col("c") * F.col("c")).alias("ss"), F.max("n").alias("n"))
    v = nw_mean(d.select(entity, date, value, "lags"), value, date, [entity], "lags").select(entity, (F.col("se") * F.col("se") * F.col("n")).alias("lrv"))
    return s.join(v, entity).select(entity, "n", (F.col("ss") / (F.col("n") * F.col("n") * F.col("lrv"))).alias("kpss"))


def autocorrelations(df: DataFrame, value: str, lags: int, entity="entity", date="date") -> DataFrame:
    """(entity, n, g0, array of lag products) of the centred series in one window pass."""
    wg, wo = Window.partitionBy(entity), W.series(entity, date)
    d = df.where(F.col(value).isNotNull()).select(entity, date, (F.col(value) - F.avg(value).over(wg)).alias("e"))
    d = d.select(entity, "e", *[(F.col("e") * F.lag("e", k).over(wo)).alias(f"_p{k}") for k in range(1, lags + 1)])
    return d.groupBy(entity).agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"),
                                 F.array(*[F.sum(f"_p{k}") for k in range(1, lags + 1)]).alias("g"))


def ljung_box(df: DataFrame, value: str, lags: int = 10, entity="entity", date="date") -> DataFrame:
    a = autocorrelations(df, value, lags, entity, date)
    q = F.expr(f"aggregate(sequence(1, {lags}), 0D, (s, k) -> s + power(g[k - 1] / g0, 2) / (n - k)) * n * (n + 2)")
    return a.select(entity, "n", q.alias("q"), (F.col("g")[0] / F.col("g0")).alias("ac1"))


def engle_granger(df: DataFrame, y: str, x: str, entity="entity", date="date") -> DataFrame:
    """Per entity: levels regression, then the unit-root t of its residual."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    b = d.groupBy(entity).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"))
    u = d.join(b, entity).withColumn("_u", F.col(y) - F.col("a") - F.col("b") * F.col(x))
    w = W.series(entity, date)
    s = u.select(entity, (F.col("_u") - F.lag("_u").over(w)).alias("_dy"), F.lag("_u").over(w).alias("_l"))
    t = panel_ols(s, "_dy", ["_l"], by=[entity], const=False, bounded=False).select(entity, F.col("t").alias("eg_t"), "n")
    return b.join(t, entity)


def variance_ratio(df: DataFrame, ret: str, qs: Sequence[int] = (2, 5, 10, 20), entity="entity", date="date") -> DataFrame:
    """Variance ratio with the heteroskedasticity-robust z of the overlapping estimator."""
    wg, wo = Window.partitionBy(entity), W.series(entity, date)
    d = df.where(F.col(ret).isNotNull()).select(entity, date, F.col(ret).alias("r"), F.avg(ret).over(wg).alias("mu"))
    d = d.withColumn("e2", (F.col("r") - F.col("mu")) ** 2)
    top = max(qs)
    lagged = [(F.col("e2") * F.lag("e2", j).over(wo)).alias(f"_l{j}") for j in range(1, top)]
    roll = []
    for q in qs:
        f = wo.rowsBetween(-(q - 1), 0)
        roll.append(F.when(F.count("r").over(f) == q, (F.sum("r").over(f) - q * F.col("mu")) ** 2).alias(f"_r{q}"))
    a = d.select(entity, "e2", *lagged, *roll).groupBy(entity).agg(
        F.count("*").alias("n"), F.sum("e2").alias("ss"), F.array(*[F.sum(f"_l{j}") for j in range(1, top)]).alias("d"),
        *[F.sum(f"_r{q}").alias(f"_r{q}") for q in qs])
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"_r{q}").alias("sq")) for q in qs])).alias("z")
    a = a.select(entity, "n", "ss", "d", rows).select(entity, "n", "ss", "d", "z.q", "z.sq").where("n >= q * 10")
    m = F.expr("q * (n - q + 1) * (1 - q / n)")
    vr = F.col("sq") / m / (F.col("ss") / (F.col("n") - 1))
    delta = F.expr("aggregate(sequence(1, q - 1), 0D, (s, j) -> s + power(2D * (q - j) / q, 2) * d[j - 1] / (ss * ss))")
    return a.select(entity, "q", "n", vr.alias("vr"), ((vr - 1) / F.sqrt(delta)).alias("z"))


def roll_spread(df: DataFrame, ret: str, entity="entity", date="date") -> DataFrame:
    w = W.series(entity, date)
    d = df.where(F.col(ret).isNotNull()).withColumn("_l", F.lag(ret).over(w))
    g = d.groupBy(entity).agg(F.covar_samp(ret, "_l").alias("gamma1"), safe_corr(ret, "_l").alias("ac1"), F.count("*").alias("n"))
    return g.withColumn("roll_spread_pct", F.when(F.col("gamma1") < 0, 200 * F.sqrt(-F.col("gamma1"))))


def market_model(df: DataFrame, ret: str, entity="entity", date="date") -> DataFrame:
    """Beta, R2 and idiosyncratic sd against the mean of the others."""
    d = leave_one_out(df.where(F.col(ret).isNotNull()), [date], ret, "_m").where("_m is not null")
    g = d.groupBy(entity).agg(F.regr_slope(ret, "_m").alias("beta"), F.regr_r2(ret, "_m").alias("r2"), F.count("*").alias("n"), F.regr_syy(ret, "_m").alias("syy"))
    return g.select(entity, "beta", "r2", "n", F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)).alias("idio_sd"))


def granger(df: DataFrame, y: str, x: str, lags: int, entity="entity", date="date") -> DataFrame:
    """F statistic per entity that lags of x add to lags of y, both fits on one sample."""
    w = W.series(entity, date)
    d = df.select(entity, F.col(y).alias("_y"), *[F.lag(y, k).over(w).alias(f"_y{k}") for k in range(1, lags + 1)],
                  *[F.lag(x, k).over(w).alias(f"_x{k}") for k in range(1, lags + 1)])
    ys, xs = [f"_y{k}" for k in range(1, lags + 1)], [f"_x{k}" for k in range(1, lags + 1)]
    d = complete(d, ["_y", *ys, *xs], [entity])
    one = lambda cols, out: panel_ols(d, "_y", cols, by=[entity], bounded=False).where("term = 'const'").select(entity, F.col("ssr").alias(out), "n")
    j = one(ys, "ssr_r").join(one(ys + xs, "ssr_u").drop("n"), entity)
    f = ((F.col("ssr_r") - F.col("ssr_u")) / lags) / (F.col("ssr_u") / (F.col("n") - 2 * lags - 1))
    return j.select(entity, "n", f.alias("f"))


def sup_wald(series: DataFrame, value: str, order: str, trim: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """Largest squared Welch t over trimmed split points of a date-grain series, from running sums."""
    by = list(by)
    s = series.where(F.col(value).isNotNull()).select(*by, F.col(order).alias("o"), F.col(value).alias("x"))
    if not by:
        s, keys = s.withColumn("_k", F.lit(1)), ["_k"]
    else:
        keys = by
    wg = Window.partitionBy(*keys)
    run = wg.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    s = s.withColumn("x", c("x") - F.avg("x").over(wg))
    s = s.select(*keys, "o", F.row_number().over(wg.orderBy("o")).alias("i"), F.count("*").over(wg).alias("n"), F.sum("x").over(run).alias("s"),
                 F.sum(c("x") * c("x")).over(run).alias("q"), F.sum("x").over(wg).alias("s_all"), F.sum(c("x") * c("x")).over(wg).alias("q_all"))
    n1, n2 = c("i"), c("n") - c("i")
    m1, m2 = c("s") / n1, (c("s_all") - c("s")) / n2
    v1 = (c("q") - n1 * m1 * m1) / (n1 - 1)
    v2 = (c("q_all") - c("q") - n2 * m2 * m2) / (n2 - 1)
    s = s.where((c("i") >= F.greatest(F.floor(c("n") * trim), F.lit(2))) & (c("i") <= c("n") - F.greatest(F.floor(c("n") * trim), F.lit(2))))
    s = s.withColumn("wald", (m1 - m2) ** 2 / (v1 / n1 + v2 / n2))
    g = s.groupBy(*keys).agg(F.max("wald").alias("sup_wald"), F.max_by("o", "wald").alias("break_after"), F.max("n").alias("n"))
    return g.drop("_k")


def permutation_entropy(df: DataFrame, value: str, m: int = 4, entity="entity", date="date", min_n: int = 50) -> DataFrame:
    """Normalised entropy of ordinal patterns of length m."""
    import math

    w = W.series(entity, date)
    d = df.where(F.col(value).isNotNull()).select(entity, *[F.lag(value, m - 1 - i).over(w).alias(f"_v{i}") for i in range(m)])
    pat = F.array_join(F.transform(F.array_sort(F.array(*[F.struct(F.col(f"_v{i}").alias("v"), F.lit(i).alias("i")) for i in range(m)])), lambda z: z["i"].cast("string")), "")
    p = d.where("_v0 is not null").groupBy(entity, pat.alias("pattern")).agg(F.count("*").alias("c"))
    t = Window.partitionBy(entity)
    p = p.withColumn("n", F.sum("c").over(t)).withColumn("p", F.col("c") / F.sum("c").over(t))
    g = p.groupBy(entity).agg((-F.sum(F.col("p") * F.log("p")) / math.log(math.factorial(m))).alias("entropy"), F.max("n").alias("n"))
    return g.where(F.col("n") >= min_n)


def sample_entropy(df: DataFrame, value: str, m: int = 2, r: float = 0.2, entity="entity", date="date") -> DataFrame:
    """How often stretches of ``m`` points that lie within ``r`` standard deviations stay so one point longer.

    Every stretch of the whole series is filed by its first two standardised values cut into cells
    of width ``r``; partners can only be in the same or a neighbouring cell, so the close pairs come
    from an equi-join and are counted, never listed.
    """
    t = Window.partitionBy(entity)
    s = t.orderBy(date)
    z = (F.col(value) - F.avg(value).over(t)) / F.nullif(F.stddev_pop(value).over(t), F.lit(0.0))
    d = df.where(F.col(value).isNotNull()).select(entity, F.row_number().over(s).alias("i"), F.count("*").over(t).alias("n"), z.alias("z0"), F.col(date).alias("_d"))
    d = d.select(entity, "i", "n", "z0", *[F.lead("z0", k).over(t.orderBy("i")).alias(f"z{k}") for k in range(1, m + 1)])
    long = d.where(F.col("i") <= F.col("n") - m)
    sides = min(m, 2)
    a = long.select(entity, F.col("i").alias("i1"), *[F.col(f"z{k}").alias(f"a{k}") for k in range(m + 1)], *[F.floor(F.col(f"z{k}") / r).alias(f"c{k}") for k in range(sides)])
    b = long.select(entity, F.col("i").alias("i2"), *[F.col(f"z{k}").alias(f"b{k}") for k in range(m + 1)], *[F.floor(F.col(f"z{k}") / r).alias(f"c{k}") for k in range(sides)])
    for k in range(sides):
        b = b.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + F.lit(o) for o in (-1, 0, 1)])))
    near = [F.abs(F.col(f"a{k}") - F.col(f"b{k}")) <= r for k in range(m + 1)]
    pairs = a.join(b, [entity, *[f"c{k}" for k in range(sides)]]).where(F.col("i1") < F.col("i2"))
    for k in range(m):
        pairs = pairs.where(near[k])
    got = pairs.groupBy(entity).agg((2 * F.count("*")).alias("pairs_m"), (2 * F.count(F.when(near[m], 1))).alias("pairs_m1"))
    sizes = d.groupBy(entity).agg(F.max("n").alias("n"))
    out = sizes.join(got, entity, "left").select(entity, "n", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pairs_m", "pairs_m1")])
    ratio = F.col("pairs_m1") / F.col("pairs_m")
    return out.withColumn("sampen", F.when((F.col("pairs_m1") > 0) & (F.col("pairs_m") > 0), -F.log(ratio)))


# ------------------------------------------------------------------ other estimators
def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Two-sample rank test with tie correction from distributed ranks."""
    d = df.where(F.col(value).isNotNull()).withColumn("_f", F.col(flag).cast("long"))
    run = running(d, value, (), ["_f"])
    r = F.col("c_w") - (F.col("w") - 1) / 2.0
    g = run.agg(F.sum(r * F.col("_f")).alias("r1"), F.sum("_f").alias("n1"), F.sum("w").alias("n"), F.sum(F.col("w") ** 3 - F.col("w")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return g.select(n1.alias("n_on"), n2.alias("n_off"), u.alias("u"), ((u - n1 * n2 / 2.0) / sd).alias("z"))


def quantile_regression(df: DataFrame, y: str, x: str, taus: Sequence[float], iters: int = 60, eps: float = 1e-4, tol: float = 1e-4) -> DataFrame:
    """Slope and intercept per quantile by iteratively reweighted least squares; ``converged`` says whether the last pass moved less than ``tol``.

    Each pass is one weighted-moment aggregate for all quantiles; only the coefficients come back.
    """
    d = complete(df, [y, x]).persist()
    coef, moved = {t: (0.0, 0.0) for t in taus}, float("inf")
    c = F.col
    for _ in range(iters):
        # the coefficients travel as one constant array, so the generated code is the same every pass
        state = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for t, (a, b) in coef.items()])
        e = d.select(y, x, F.explode(state).alias("s")).select(y, x, "s.*").withColumn("u", c(y) - c("a") - c("b") * c(x))
        e = e.withColumn("w", F.when(c("u") < 0, 1 - c("tau")).otherwise(c("tau")) / F.greatest(F.abs("u"), F.lit(eps)))
        rows = e.groupBy("tau").agg(F.sum("w").alias("w"), F.sum(c("w") * c(x)).alias("x"), F.sum(c("w") * c(y)).alias("y"),
                                    F.sum(c("w") * c(x) * c(x)).alias("xx"), F.sum(c("w") * c(x) * c(y)).alias("xy")).collect()
        moved = 0.0
        for r in rows:
            b = (r["xy"] - r["x"] * r["y"] / r["w"]) / (r["xx"] - r["x"] * r["x"] / r["w"])
            new = ((r["y"] - b * r["x"]) / r["w"], b)
            moved = max(moved, *(abs(n - o) for n, o in zip(new, coef[r["tau"]])))
            coef[r["tau"]] = new
        if moved < tol:
            break
    d.unpersist()
    return df.sparkSession.createDataFrame([(float(t), float(a), float(b), moved < tol) for t, (a, b) in coef.items()], "tau double, intercept double, slope double, converged boolean")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation from the inverse correlation matrix; a column without spread is correlated with nothing (1)."""
    from gridloom.operators.moments import _solve

    d = complete(df, list(xs))
    k = len(xs)
    c = d.agg(F.array(*[F.lit(1.0) if i == j else F.coalesce(safe_corr(xs[i], xs[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).alias("xx"), F.array(*[F.lit(0.0)] * k).alias("xy"))
    s = c.select(_solve("xx", "xy").alias("s"))
    z = F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.col("s")[k + i * k + i].alias("vif")) for i, x in enumerate(xs)])).alias("z")
    return s.select(z).select("z.term", "z.vif")


def rolling_reestimation(df: DataFrame, y: str, x: str, fe: str, window: int, step: int, date="date") -> DataFrame:
    """The same slope in overlapping date windows: rows are labelled with the window ids that cover them."""
    d = with_scalars(df, df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")), "s")
    day = F.datediff(date, "s.d0")
    hi = F.floor(day / step).cast("int")
    lo = F.greatest(F.ceil((day - window + 1) / step).cast("int"), F.lit(0))
    last = F.floor((F.datediff("s.d1", "s.d0") - window + 1) / step).cast("int")
    d = d.where(F.least(hi, last) >= lo).withColumn("window_id", F.explode(F.sequence(lo, F.least(hi, last))))
    return panel_ols(d, y, [x], fe=[fe], by=["window_id"], bounded=True).select("window_id", "coef", "se", "n")


def panel_pca(df: DataFrame, value: str, k: int = 3, entity="entity", date="date", train=None, spare: int = 8, tol: float = 1e-8, max_iter: int = 200):
    """Principal components of the standardised date x entity block, missing cells at the entity mean.

    Subspace iteration: a few vectors over the dates are multiplied by the block and back, two
    grouped joins a pass, so neither side is gathered; the driver sees the small Gram matrices of
    those vectors.  With ``train`` (a condition), moments and loadings come from those rows only and
    all dates are scored with them.  Returns (explained shares, date scores, entity loadings).
    """
    d = df.where(F.col(value).isNotNull()).select(entity, date, F.col(value).cast("double").alias("_x"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("_t"))
    known = d.where("_t").groupBy(F.col(entity).alias("_e")).agg(F.avg("_x").alias("_m"), F.stddev("_x").alias("_s"))
    z = d.join(known, F.col(entity).eqNullSafe(F.col("_e"))).select(entity, date, "_t", div(F.col("_x") - F.col("_m"), "_s").alias("z")).where("z is not null")
    z = materialise(z, "standardised")
    zt = z.where("_t").select(entity, date, "z")
    total, n_dates = zt.agg(F.sum(F.col("z") * F.col("z")), F.countDistinct(date)).first()
    b = max(1, min(k + spare, n_dates or 1))
    k = min(k, b)

    def times(rows: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
        g = rows.join(vectors, on).groupBy(to).agg(*[F.sum(F.col("z") * F.col("v")[i]).alias(f"s{i}") for i in range(b)])
        return g.select(to, F.array(*[f"s{i}" for i in range(b)]).alias("v"))

    def products(rows: DataFrame, left: str, right: str) -> np.ndarray:
        got = rows.agg(*[F.sum(F.col(left)[i] * F.col(right)[j]) for i in range(b) for j in range(b)]).first()
        return np.array(got, dtype=float).reshape(b, b)

    def rotated(rows: DataFrame, m: np.ndarray) -> DataFrame:
        cols = [sum((F.col("v")[i] * F.lit(float(m[i, j])) for i in range(b)), F.lit(0.0)) for j in range(b)]
        return rows.select(date, F.array(*cols).alias("v"))

    def whitening(gram: np.ndarray) -> np.ndarray:
        w, q = np.linalg.eigh((gram + gram.T) / 2)
        return q / np.sqrt(np.maximum(w, max(w.max(), 1e-300) * 1e-14))

    start = F.array(*[F.pmod(F.xxhash64(date, F.lit(j)), F.lit(2000003)) / 1000001.5 - 1.0 for j in range(b)])
    v = materialise(zt.select(date).distinct().select(date, start.alias("v")), "subspace")
    v = rotated(v, whitening(products(v, "v", "v")))
    last = None
    for _ in range(max_iter):
        u = times(zt, times(zt, v, date, entity), entity, date)
        both = materialise(u.join(v.select(date, F.col("v").alias("old")), date), "subspace")
        ritz = products(both, "old", "v")
        values, q = np.linalg.eigh((ritz + ritz.T) / 2)
        order = np.argsort(values)[::-1]
        values, q = values[order], q[:, order]
        if last is not None and np.all(np.abs(values[:k] - last[:k]) <= tol * max(values[0], 1e-300)):
            break
        last = values
        v = rotated(both.select(date, "v"), whitening(products(both, "v", "v")))
    else:
        raise RuntimeError(f"components not found in {max_iter} passes")
    vectors = rotated(both.select(date, F.col("old").alias("v")), q)
    sums = vectors.agg(*[F.sum(F.col("v")[i]) for i in range(k)]).first()
    scale = [(-1.0 if x < 0 else 1.0) * math.sqrt(max(w, 0.0)) for x, w in zip(sums, values)]
    fit = materialise(vectors.select(date, *[(F.col("v")[i] * scale[i]).alias(f"pc{i + 1}") for i in range(k)]), "scores")
    load = zt.join(fit, date).groupBy(entity).agg(*[(F.sum(F.col("z") * F.col(f"pc{i + 1}")) / float(values[i])).alias(f"load{i + 1}") for i in range(k)])
    if train is None:
        dated = fit
    else:  # every date on the training loadings, which are orthogonal over the entities
        pl = materialise(load, "loadings")
        ll = pl.agg(*[F.sum(F.col(f"load{i + 1}") ** 2) for i in range(k)]).first()
        dated = z.join(pl, entity).groupBy(date).agg(*[(F.sum(F.col("z") * F.col(f"load{i + 1}")) / float(ll[i])).alias(f"pc{i + 1}") for i in range(k)])
        load = pl
    share = df.sparkSession.createDataFrame([(i + 1, float(values[i] / total)) for i in range(k)], "component long, share double")
    return share, dated, load
