"""Features, walk-forward evaluation and models."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions.num import div, log_floor, rnd, safe_corr
from gridloom.operators import evaluation as V, features as X, inference as I, joins as J, learning as L, quantiles as Q, states as ST, windows as W
from gridloom.queries.aggregates import qbin_sql
from gridloom.queries.econometric import nw_sql
from gridloom.registry import query
from gridloom.session import materialise, scratch
from gridloom.sqltext import define, r, with_, tail_sql

WE = "WINDOW we AS (PARTITION BY entity ORDER BY date)"
FEATS = ["dev_lag", "dev_mean3", "ret_lag", "lv_lag"]

define("mf", f"""SELECT entity, date, dev, ret_row, logp, volume, lag(dev) OVER we AS dev_lag, CASE WHEN count(dev) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 3 THEN
  avg(dev) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS dev_mean3, lag(ret_row) OVER we AS ret_lag, lag(ln(volume)) OVER we AS lv_lag, lead(dev) OVER we - dev AS y FROM devm {WE}""")
define("mcut", """SELECT dd[CAST(floor(n * 0.60) AS BIGINT) + 1] AS cut_a, dd[CAST(floor(n * 0.65) AS BIGINT) + 1] AS cut_b, dd[CAST(floor(n * 0.80) AS BIGINT) + 1] AS cut_c
  FROM (SELECT list(date ORDER BY date) AS dd, count(*) AS n FROM (SELECT DISTINCT date FROM mf WHERE y IS NOT NULL AND dev_lag IS NOT NULL))""")
define("mfs", "SELECT mf.*, CASE WHEN date <= cut_a THEN 'train' WHEN date > cut_b THEN 'test' END AS part, date <= cut_c AS early FROM mf, mcut WHERE y IS NOT NULL AND dev_lag IS NOT NULL")


def mf(t):
    w = W.series()
    return X.deviation_features(t.devm).withColumn("lv_lag", F.lag(F.log("volume")).over(w))


def parts(t):
    """Training rows, and test rows with the flag ``early``; the cuts are shares of the dates that the data have."""
    d = mf(t).where("y is not null and dev_lag is not null")
    d = J.with_scalars(d, V.cut_dates(d, "date", a=0.60, b=0.65, c=0.80), "_s").withColumn("early", F.col("date") <= F.col("_s.c"))
    return d.where("date <= _s.a").drop("_s", "early"), d.where("date > _s.b").drop("_s")


@query("m1_forward_targets", with_(f"""
WITH f AS (SELECT entity, date, lead(logp, 1) OVER we - logp AS y1, lead(logp, 7) OVER we - logp AS y7, lead(logp, 30) OVER we - logp AS y30,
   CASE WHEN count(ret_row) OVER v >= 5 THEN stddev(ret_row) OVER v END * sqrt(365.0) AS vol FROM pr WINDOW we AS (PARTITION BY entity ORDER BY date), v AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
SELECT entity, date, {r('y1')} AS y_ret1, {r('y7')} AS y_ret7, {r('y30')} AS y_ret30, CASE WHEN y7 IS NOT NULL THEN CAST(y7 > 0.02 AS DOUBLE) END AS y_up7, CASE WHEN y7 IS NOT NULL THEN CAST(y7 < -0.02 AS DOUBLE) END AS y_dn7,
 {r('y7 - avg(y7) OVER (PARTITION BY date)')} AS y_rel7, {r('y30 - avg(y30) OVER (PARTITION BY date)')} AS y_rel30, {r('vol')} AS y_vol7,
 CASE WHEN vol IS NOT NULL THEN CAST(vol > (SELECT quantile_cont(vol, 0.75) FROM f) AS DOUBLE) END AS y_hivol7 FROM f""").replace("\nWITH f AS", ",\nf AS"))
def m1(t):
    d = X.forward_targets(t.pr)
    return d.select("entity", "date", *[rnd(c).alias(c) for c in ("y_ret1", "y_ret7", "y_ret30")], "y_up7", "y_dn7", *[rnd(c).alias(c) for c in ("y_rel7", "y_rel30", "y_vol7")], "y_hivol7")


REGIONS, KINDS, TIERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], ["optional", "open"], ["green", "yellow"]


def _block_sql() -> str:
    """The whole block with plain frames on the described day and one move at the end."""
    def roll(c, n, f, k=None):
        return f"CASE WHEN count({c}) OVER r{n} >= {k or max(2, n // 2)} THEN {f}({c}) OVER r{n} END"

    div = lambda a, b: f"({a}) / nullif({b}, 0)"
    ln1 = lambda c: f"ln(greatest({c}, 1))"
    base = f"""SELECT f.*, d.region, d.kind, d.tier, d.created, d.mean_balance, d.premium_share, CAST(greatest(d.population, 1) AS DOUBLE) AS pop, ln(price) AS logp, n / greatest(d.population, 1) AS per_head,
  coalesce(k.ev_month_end, 0) AS release, coalesce(k.ev_urgent, 0) AS ev_urgent, coalesce(k.n_urgent, 0) AS n_urgent FROM fundamentals f LEFT JOIN dim d USING (entity) LEFT JOIN calendar k USING (date)"""
    acts = ["n", "volume", "returned", "suppliers", "value", "per_head"]
    more = f"""SELECT *, logp - lag(logp) OVER we AS ret, {', '.join(f'{ln1(x)} AS lg_{x}' for x in acts)}, greatest(release, ev_urgent) AS ev_any, row_number() OVER we - 1 AS i FROM fb0 {WE}"""
    days = """SELECT *, CASE WHEN pe IS NULL THEN date - ne WHEN ne IS NULL THEN date - pe WHEN date - pe <= ne - date THEN date - pe ELSE date - ne END AS days_to_event,
      CASE WHEN pr_ IS NULL THEN date - nr WHEN nr IS NULL THEN date - pr_ WHEN date - pr_ <= nr - date THEN date - pr_ ELSE date - nr END AS days_to_release
    FROM (SELECT date, (SELECT max(k.date) FROM calendar k WHERE k.date <= x.date AND greatest(ev_month_end, ev_urgent) > 0) AS pe, (SELECT min(k.date) FROM calendar k WHERE k.date >= x.date AND greatest(ev_month_end, ev_urgent) > 0) AS ne,
      (SELECT max(k.date) FROM calendar k WHERE k.date <= x.date AND ev_month_end > 0) AS pr_, (SELECT min(k.date) FROM calendar k WHERE k.date >= x.date AND ev_month_end > 0) AS nr FROM (SELECT DISTINCT date FROM fundamentals) x)"""
    pairs = "SELECT a.entity, a.date, count(*) AS k" + "".join(
        f", sum(b.ret * pow(0.5, (a.i - b.i) / {h}.0)) AS x{h}, sum(b.ret * b.ret * pow(0.5, (a.i - b.i) / {h}.0)) AS s{h}, sum(pow(0.5, (a.i - b.i) / {h}.0)) AS w{h}, sum(pow(0.25, (a.i - b.i) / {h}.0)) AS q{h}" for h in (3, 7, 14)
    ) + " FROM fb1 a JOIN fb1 b ON a.entity = b.entity AND b.i <= a.i AND b.ret IS NOT NULL GROUP BY 1, 2"
    f: dict[str, str] = {f"ret_lag{k}": f"lag(ret, {k - 1}) OVER we" for k in (1, 2, 3, 5, 7, 14, 21)}
    for n in (7, 14, 30):
        f |= {f"ret_mean{n}": roll("ret", n, "avg"), f"ret_sd{n}": roll("ret", n, "stddev"), f"mom{n}": f"logp - lag(logp, {n}) OVER we"}
    for h in (3, 7, 14):
        f |= {f"ret_ew{h}": f"CASE WHEN k >= 3 THEN x{h} / w{h} END", f"ret_ew{h}_sd": f"CASE WHEN k >= 3 THEN sqrt(greatest((s{h} / w{h} - pow(x{h} / w{h}, 2)) * w{h} * w{h} / (w{h} * w{h} - q{h}), 0)) END"}
    f |= {"ret_skew30": roll("ret", 30, "skewness"), "px_z30": div(f"logp - {roll('logp', 30, 'avg')}", roll("logp", 30, "stddev"))}
    f |= {f"dist_ma{n}": f"logp - {roll('logp', n, 'avg')}" for n in (30, 90)}
    for x in acts:
        f |= {f"log_{x}": f"lg_{x}"} | {f"g{n}_{x}": f"lg_{x} - lag(lg_{x}, {n}) OVER we" for n in (7, 30)}
    f |= {"returned_share": "returned / volume", "supplier_hhi": "supplier_hhi", "top_share": "top_share", "lot": "volume / n", "return_ratio": "returned / greatest(n, 1) * 1e4",
          "log_sell": "ln(coalesce(sell_qty, 0) + 1)", "has_sell": "CAST(sell_qty IS NOT NULL AS DOUBLE)", "log_buy": "ln(coalesce(buy_qty, 0) + 1)", "has_buy": "CAST(buy_qty IS NOT NULL AS DOUBLE)",
          "imbalance": div("sell_qty - buy_qty", "sell_qty + buy_qty"), "ev_any": "CAST(ev_any AS DOUBLE)", "ev_urgent": "CAST(ev_urgent AS DOUBLE)", "n_events": "CAST(release + ev_urgent AS DOUBLE)", "n_urgent": "CAST(n_urgent AS DOUBLE)"}
    f |= {f"pre_release_{n}": f"CAST(coalesce(nr - date BETWEEN 1 AND {n}, false) AS DOUBLE)" for n in (7, 14, 30)} | {f"post_release_{n}": f"CAST(coalesce(date - pr_ BETWEEN 0 AND {n}, false) AS DOUBLE)" for n in (14, 30)}
    last = "date - max(CASE WHEN returned * 2 > volume THEN date END) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)"
    f |= {"release": "CAST(release AS DOUBLE)", "inflation_pressure": "(lg_n - lag(lg_n, 7) OVER we) - (lg_volume - lag(lg_volume, 7) OVER we)", "premium_demand": "coalesce(buy_qty, 0) / pop",
          "premium_demand_7": f"{roll('buy_qty', 7, 'avg')} / pop", "turnover_7": f"{roll('sell_qty', 7, 'avg')} + {roll('buy_qty', 7, 'avg')}", "engagement": "volume / pop",
          "never_marked": f"CAST(({last}) IS NULL AS DOUBLE)", "days_since_mark": f"CAST(coalesce({last}, 9999) AS DOUBLE)", "recent_mark": f"CAST(coalesce({last} BETWEEN 0 AND 90, false) AS DOUBLE)"}
    cross = {"rel_premium": "lp - quantile_cont(lp, 0.5) OVER dd", "xw_med_logp": "quantile_cont(lp, 0.5) OVER dd", "xw_disp": "stddev(lp) OVER dd", "breadth_up": "avg(CAST(coalesce(lr > 0, false) AS DOUBLE)) OVER dd", "xw_ret": "avg(lr) OVER dd",
             "xw_activity": "avg(la) OVER dd"}
    late = {"rel_premium_z": div("rel_premium", "xw_disp"), "beta_gap": "lr - xw_ret", "rel_activity": "la - xw_activity", "activity_x_event": "g7_n * ev_any", "activity_x_kind": "g7_n * CAST(kind = 'optional' AS DOUBLE)",
            "premium_x_disp": "rel_premium * xw_disp", "vol_x_breadth": "ret_sd14 * breadth_up"}
    own = {"dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)", "doy_sin": "sin(2 * pi() * dayofyear(date) / 365)", "doy_cos": "cos(2 * pi() * dayofyear(date) / 365)",
           "is_weekend": "CAST(isodow(date) >= 6 AS DOUBLE)", "month": "CAST(month(date) AS DOUBLE)", "days_to_event": "CAST(days_to_event AS DOUBLE)", "days_to_release": "CAST(days_to_release AS DOUBLE)",
           "event_soon": "greatest(least(days_to_event, 0), -14) / -14.0", "age": "CAST(date - created AS DOUBLE)", "log_age": "ln(1 + greatest(date - created, 0))", "log_population": "ln(pop)", "log_balance": ln1("mean_balance"), "premium_share": "premium_share"}
    own |= {f"{c}_{v.split()[0].lower()}": f"CAST({c} = '{v}' AS DOUBLE)" for c, vs in (("region", REGIONS), ("kind", KINDS), ("tier", TIERS)) for v in vs}
    frames = ", ".join(f"r{n} AS (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING)" for n in (7, 14, 30, 90))
    keep = "entity, date, kind, region, tier, created, pop, mean_balance, premium_share AS premium_own, days_to_event, days_to_release"
    day = f"SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in f.items())}, lag(logp) OVER we AS lp, lag(ret) OVER we AS lr, lag(lg_n) OVER we AS la FROM fb1 JOIN fbd USING (date) LEFT JOIN fbe USING (entity, date) {WE}, {frames}"
    moved = [*f, *cross, *late]
    own["premium_share"] = "premium_own"
    return with_(f"""SELECT entity, date, {', '.join(f'{r(f"lag({n}) OVER we", 4)} AS {n}' for n in moved)}, {', '.join(f'{r(e, 4)} AS {n}' for n, e in own.items())} FROM fb5 {WE}""",
                 ("fb0", base), ("fb1", more), ("fbd", days), ("fbe", pairs), ("fb3", day), ("fb4", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in cross.items())} FROM fb3 WINDOW dd AS (PARTITION BY date)"),
                 ("fb5", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in late.items())} FROM fb4"))


@query("m2_feature_block", _block_sql())
def m2(t):
    d = X.feature_block(t.fundamentals, t.dim, t.calendar, REGIONS, KINDS, TIERS)
    return d.select("entity", "date", *[rnd(c, 4).alias(c) for c in d.columns if c not in ("entity", "date")])


@query("m3_named_indices", with_(f"""
SELECT p.entity, p.date, {r('(ln(greatest(n, 1)) - CASE WHEN lag(n, 7) OVER we IS NOT NULL THEN ln(greatest(lag(n, 7) OVER we, 1)) END) - (ln(greatest(volume, 1)) - CASE WHEN lag(volume, 7) OVER we IS NOT NULL THEN ln(greatest(lag(volume, 7) OVER we, 1)) END)')} AS inflation_pressure,
 {r('volume / greatest(population, 1)')} AS premium_demand FROM panel p JOIN dim USING (entity) WINDOW we AS (PARTITION BY p.entity ORDER BY p.date)"""))
def m3(t):
    w = W.series()
    g = lambda c: log_floor(c) - F.when(F.lag(c, 7).over(w).isNotNull(), log_floor(F.lag(c, 7).over(w)))
    d = t.panel.join(t.dim.select("entity", "population"), "entity")
    return d.select("entity", "date", rnd(g("n") - g("volume")).alias("inflation_pressure"), rnd(F.col("volume") / F.greatest("population", F.lit(1))).alias("premium_demand"))


@query("m3b_activity_index")
def m3b(t):
    d = t.panel.select("entity", "date", log_floor("volume").alias("lv"), log_floor("n").alias("ln"), log_floor("price").alias("lp"), F.log1p("volume").alias("l1"))
    return L.activity_index(d, ["lv", "ln", "lp", "l1"], ["entity", "date"])


@query("m4_mix_axes")
def m4(t):
    from gridloom.operators.aggs import category_mix
    return L.mix_axes(category_mix(t.counts, ["entity", "date"], "category", "n", 5), ["entity", "date"], ["click", "error", "purchase", "signup", "view"])


FOLD = ("fd", """SELECT k AS fold, dd[1] AS train_lo, dd[CAST(floor(n * (0.45 + k * 0.55 / 4)) AS BIGINT) + 1] - 8 AS train_hi, dd[CAST(floor(n * (0.45 + k * 0.55 / 4)) AS BIGINT) + 1] AS test_lo,
   dd[CAST(least(floor(n * (0.45 + (k + 1) * 0.55 / 4)), n) AS BIGINT)] AS test_hi FROM (SELECT list(date ORDER BY date) AS dd, count(*) AS n FROM (SELECT DISTINCT date FROM pr)), (SELECT unnest(range(0, 4)) AS k)""")


@query("m5_walk_forward_folds", with_("""
SELECT CAST(fold AS INTEGER) AS fold, train_lo, train_hi, test_lo, test_hi, (SELECT count(*) FROM pr WHERE date BETWEEN train_lo AND train_hi) AS n_train, (SELECT count(*) FROM pr WHERE date BETWEEN test_lo AND test_hi) AS n_test FROM fd""", FOLD))
def m5(t):
    f = V.walk_forward_folds(t.panel, "date", 7, n=4)
    c = V.with_folds(t.panel.select("date"), f, "date").groupBy("fold").agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("n_train"), F.count(F.when(F.col("part") == "test", 1)).alias("n_test"))
    return f.join(c, "fold")


@query("m6_holdout_split", with_("""
WITH d AS (SELECT list(date ORDER BY date) AS dd, count(*) AS n FROM (SELECT DISTINCT date FROM panel)), e AS (SELECT dd[CAST(floor(n * 0.7) AS BIGINT) + 1] AS a, dd[CAST(floor(n * 0.85) AS BIGINT) + 1] AS b FROM d),
s AS (SELECT CASE WHEN date <= a - 7 THEN 'train' WHEN date > a AND date <= b - 7 THEN 'validation' WHEN date > b THEN 'holdout' END AS split, date FROM panel, e)
SELECT split, count(*) AS n, min(date) AS lo, max(date) AS hi FROM s WHERE split IS NOT NULL GROUP BY 1""").replace("\nWITH d AS", ",\nd AS"))
def m6(t):
    return V.date_splits(t.panel, "date").groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))


define("bl", f"""SELECT entity, date, isodow(date) - 1 AS dow, ret_row AS y, 0.0 AS zero, lag(ret_row) OVER we AS naive, lag(ret_row, 7) OVER we AS seasonal, avg(ret_row) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS drift FROM pr {WE}""")


def baselines(t):
    w = W.series()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return t.pr.select("entity", "date", F.weekday("date").cast("long").alias("dow"), F.col("ret_row").alias("y"), F.lit(0.0).alias("zero"), F.lag("ret_row").over(w).alias("naive"),
                       F.lag("ret_row", 7).over(w).alias("seasonal"), F.avg("ret_row").over(past).alias("drift"))


@query("m7_baselines", with_(f"SELECT entity, date, {r('naive')} AS naive, {r('seasonal')} AS seasonal, {r('drift')} AS drift FROM bl"))
def m7(t):
    return baselines(t).select("entity", "date", *[rnd(c).alias(c) for c in ("naive", "seasonal", "drift")])


def fold_preds(t, models, keep=("entity",)):
    d = mf(t)
    folds = V.walk_forward_folds(d, "date", 31, n=2)
    return L.fit_predict(d, folds, FEATS, "y", {k: v for k, v in L.regressors().items() if k in models}, keep=list(keep))


@query("m8_regressors")
def m8(t):
    return V.forecast_metrics(fold_preds(t, {"ols", "ridge", "elastic_net", "forest", "boosted"}), ["fold", "model"], "y", "yhat")


@query("m9_classifiers")
def m9(t):
    """Direction of the next move and whether it lies in the top quartile of all moves, over six folds."""
    d = materialise(mf(t).where("y is not null").withColumn("up", (F.col("y") > 0).cast("double")).withColumn("_size", F.abs("y")), "classes")
    d = J.with_scalars(d, Q.exact_quantiles(d, "_size", [0.75]).agg(F.max("q").alias("q")), "_top").withColumn("big", (F.col("_size") > F.col("_top.q")).cast("double")).drop("_top", "_size")
    folds = V.walk_forward_folds(d, "date", 31, n=6)
    s = L.class_scores(d, folds, FEATS, "up", L.classifiers()).withColumn("target", F.lit("up"))
    s = s.unionByName(L.class_scores(d, folds, FEATS, "big", {"forest": L.classifiers()["forest"]}).withColumn("target", F.lit("high_volatility")))
    return L.class_metrics(materialise(s, "scores"), ["target", "fold", "model"])


def metric_sql(y, p):
    e = f"({y} - {p})"
    return (f"count(*) AS n, {r(f'sqrt(avg({e} * {e}))')} AS rmse, {r(f'avg(abs({e}))')} AS mae, {r(f'1 - sum({e} * {e}) / sum({y} * {y})')} AS r2_oos, "
            f"{r(f'avg(CAST(sign({y}) = sign({p}) AS INT))')} AS dir_acc, {r(f'corr({y}, {p})')} AS corr")


@query("m10_forecast_metrics", with_(f"SELECT dow, {metric_sql('y', 'drift')} FROM bl WHERE y IS NOT NULL AND drift IS NOT NULL GROUP BY dow"))
def m10(t):
    d = V.forecast_metrics(baselines(t), ["dow"], "y", "drift")
    return d.select("dow", "n", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2_oos", "dir_acc", "corr")])


FOLDED = ("bm", """SELECT fold, model, date, y, yhat FROM (SELECT year(date) AS fold, date, y, unnest(['naive', 'seasonal', 'drift']) AS model, unnest([naive, seasonal, drift]) AS yhat FROM bl) WHERE y IS NOT NULL AND yhat IS NOT NULL""")


@query("m11_model_summary", with_(f"""
WITH f AS (SELECT model, fold, 1 - sum(pow(y - yhat, 2)) / sum(y * y) AS r2, sqrt(avg(pow(y - yhat, 2))) AS rmse FROM bm GROUP BY 1, 2), z AS (SELECT n.kk, mean / se AS z FROM nwr n),
j AS (SELECT model, fold, r2, rmse, z FROM f JOIN z ON z.kk = model || '|' || fold)
SELECT model, folds, {r('rmse', 5)} AS rmse, {r('r2_oos', 5)} AS r2_oos, {r('zz', 3)} AS z_combined, CAST(n_better AS BIGINT) AS n_better,
 i <= coalesce(last_i, 0) AS significant, i <= coalesce(last_i, 0) AND r2_oos > 0 AND zz < 0 AND n_better > folds / 2.0 AS beats
FROM (SELECT *, max(CASE WHEN p <= i * 0.05 / m THEN i END) OVER () AS last_i FROM (SELECT *, row_number() OVER (ORDER BY p, model) AS i, count(*) OVER () AS m FROM (
 SELECT *, {tail_sql('zz')} AS p FROM (SELECT model, count(*) AS folds, avg(rmse) AS rmse, avg(r2) AS r2_oos, sum(z) / sqrt(count(z)) AS zz, sum(CASE WHEN z < 0 THEN 1 ELSE 0 END) AS n_better FROM j GROUP BY 1))))""", FOLDED,
    ("ld", "SELECT model || '|' || fold AS kk, date, avg(pow(y - yhat, 2) - y * y) AS v FROM bm GROUP BY 1, 2"), ("nwr", nw_sql("ld", "v", "date", 1, "kk"))).replace("\nWITH f AS", ",\nf AS"))
def m11(t):
    """Fold metrics, combined loss-differential z, its significance over the models (step-up) and the beats-the-baseline rule."""
    b = baselines(t).withColumn("fold", F.year("date")).unpivot(["fold", "date", "y", "zero"], ["naive", "seasonal", "drift"], "model", "yhat").where("y is not null and yhat is not null")
    m = V.forecast_metrics(b, ["model", "fold"], "y", "yhat")
    z = I.diebold_mariano(b, ["model", "fold"], "date", "y", "yhat", "zero", 1).select("model", "fold", F.col("t").alias("z"))
    j = m.join(z, ["model", "fold"])
    g = j.groupBy("model").agg(F.count("*").alias("folds"), F.avg("rmse").alias("rmse"), F.avg("r2_oos").alias("r2_oos"))
    s = g.join(I.stouffer(j, ["model"], "z"), "model")
    s = I.bh(I.normal_tail(s, "z_combined", "p"), "p", ["model"])
    beats = F.col("bh_step_up") & (F.col("r2_oos") > 0) & (F.col("z_combined") < 0) & (F.col("n_better") > F.col("folds") / 2)
    return s.select("model", "folds", rnd("rmse", 5).alias("rmse"), rnd("r2_oos", 5).alias("r2_oos"), rnd("z_combined", 3).alias("z_combined"), "n_better", F.col("bh_step_up").alias("significant"), beats.alias("beats"))


@query("m12_fold_stability", with_(f"""
WITH f AS (SELECT model, fold, sqrt(avg(pow(y - yhat, 2))) AS v FROM bm GROUP BY 1, 2), k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY fold) AS a, rank() OVER (PARTITION BY model ORDER BY v) AS b, fold, v FROM f)
SELECT model, {r('arg_min(v, fold)')} AS first, {r('arg_max(v, fold)')} AS last, {r('avg(v)')} AS mean, count(*) AS n_folds, {r('corr(a, b)')} AS rho FROM k GROUP BY 1""", FOLDED).replace("\nWITH f AS", ",\nf AS"))
def m12(t):
    b = baselines(t).withColumn("fold", F.year("date")).unpivot(["fold", "date", "y"], ["naive", "seasonal", "drift"], "model", "yhat").where("y is not null and yhat is not null")
    m = V.forecast_metrics(b, ["model", "fold"], "y", "yhat").select("model", "fold", "rmse")
    s = V.fold_stability(m, ["model"], "fold", "rmse").join(Q.spearman(m, "fold", "rmse", ["model"]).select("model", "rho"), "model")
    return s.select("model", *[rnd(c).alias(c) for c in ("first", "last", "mean", "rho")], "n_folds")


@query("m13_scope_comparison", with_(f"""
WITH d AS (SELECT mfs.*, region FROM mfs JOIN dim USING (entity)), g AS (SELECT regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a FROM d WHERE part = 'train'),
fo AS (SELECT entity, date, y, dev_lag, month(date) % 5 AS f FROM d WHERE part = 'train'), oc AS (SELECT entity, f, sum(y) AS s, count(y) AS n FROM fo GROUP BY 1, 2),
ot AS (SELECT *, sum(s) OVER (PARTITION BY entity) AS ks, sum(n) OVER (PARTITION BY entity) AS kn, (sum(s) OVER () - sum(s) OVER (PARTITION BY f)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY f)) AS prior FROM oc),
oz AS (SELECT fo.y, dev_lag AS x, (ks - s + prior * 20) / (kn - n + 20) AS z FROM fo JOIN ot ON fo.entity = ot.entity AND fo.f = ot.f),
om AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM oz),
ob AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS gm FROM om),
te AS (SELECT entity AS te_entity, (sum(y) + (SELECT avg(y) FROM fo) * 20) / (count(y) + 20) AS code FROM fo GROUP BY 1),
rg AS (SELECT region, regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a FROM d WHERE part = 'train' GROUP BY 1), en AS (SELECT entity, regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a, count(*) AS n FROM d WHERE part = 'train' GROUP BY 1),
p AS (SELECT y, g.a + g.b * dev_lag AS p1, rg.a + rg.b * dev_lag AS p2, en.a + en.b * dev_lag AS p3, n / (n + 50.0) AS w, ob.my + ob.b * (dev_lag - ob.mx) + ob.gm * (code - ob.mz) AS p4 FROM d, g, rg, en, te, ob WHERE part = 'test' AND rg.region = d.region AND en.entity = d.entity AND te_entity = d.entity),
l AS (SELECT y, unnest(['global', 'regional', 'entity_own', 'shrunk', 'encoded']) AS scope, unnest([p1, p2, p3, w * p3 + (1 - w) * p1, p4]) AS yhat FROM p)
SELECT scope, count(*) AS n, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse, {r('1 - sum(pow(y - yhat, 2)) / sum(y * y)')} AS r2_oos FROM l GROUP BY 1""").replace("\nWITH d AS", ",\nd AS"))
def m13(t):
    tr, te = parts(t)
    reg = t.dim.select("entity", "region")
    p = L.scope_predictions(tr.join(reg, "entity"), te.select("entity", "date", "y", "dev_lag").join(reg, "entity"), "y", "dev_lag", "entity", "region")
    fold = F.month("date") % 5
    e = L.encoded_predictions(tr.select("entity", "date", "y", "dev_lag").withColumn("fold", fold), te.select("entity", "date", "y", "dev_lag"), "y", "dev_lag", "entity", "fold")
    p = p.select("scope", "y", "yhat").unionByName(e.select(F.lit("encoded").alias("scope"), "y", "yhat"))
    return V.forecast_metrics(p, ["scope"], "y", "yhat").select("scope", "n", rnd("rmse").alias("rmse"), rnd("r2_oos").alias("r2_oos"))


@query("m14_target_encoding", with_(f"""
SELECT entity, count(y) AS n, {r("(sum(y) + (SELECT avg(y) FROM mfs WHERE part = 'train') * 20) / (count(y) + 20)")} AS encoded FROM mfs WHERE part = 'train' GROUP BY 1"""))
def m14(t):
    return V.target_encoding(parts(t)[0], "entity", "y", 20.0).select("entity", "n", rnd("encoded").alias("encoded"))


@query("m14b_out_of_fold_encoding", with_(f"""
WITH fo AS (SELECT entity, y, month(date) % 5 AS f FROM mfs WHERE part = 'train')
SELECT a.entity, CAST(a.f AS INTEGER) AS fold, {r("(coalesce((SELECT sum(y) FROM fo o WHERE o.entity = a.entity AND o.f <> a.f), 0) + (SELECT avg(y) FROM fo o WHERE o.f <> a.f) * 20) / ((SELECT count(y) FROM fo o WHERE o.entity = a.entity AND o.f <> a.f) + 20)")} AS encoded
FROM (SELECT DISTINCT entity, f FROM fo) a""").replace("\nWITH fo AS", ",\nfo AS"))
def m14b(t):
    """Codes of the training rows, each from the other folds only."""
    d = parts(t)[0].withColumn("fold", F.month("date") % 5)
    return V.out_of_fold_encoding(d, "entity", "fold", "y").select("entity", F.col("fold").cast("int").alias("fold"), rnd("encoded").alias("encoded"))


@query("m15_fallback_registry", with_("""
WITH c AS (SELECT entity, kind, tier, region, count(*) OVER (PARTITION BY kind, tier, region) AS n0, count(*) OVER (PARTITION BY kind, tier) AS n1, count(*) OVER (PARTITION BY kind) AS n2 FROM dim),
g AS (SELECT entity, CASE WHEN n0 >= 3 THEN 'kind__tier__region' WHEN n1 >= 3 THEN 'kind__tier' ELSE 'kind' END AS group_level, CASE WHEN n0 >= 3 THEN kind || '__' || tier || '__' || region WHEN n1 >= 3 THEN kind || '__' || tier ELSE kind END AS group_id,
  CASE WHEN n0 >= 3 THEN n0 WHEN n1 >= 3 THEN n1 ELSE n2 END AS model_size FROM c)
SELECT entity, group_level, group_id, model_size, model_size < 3 AS low_sample, count(*) OVER (PARTITION BY group_id) AS assigned FROM g""").replace("\nWITH c AS", ",\nc AS"))
def m15(t):
    d = V.fallback_registry(t.dim, "entity", [["kind", "tier", "region"], ["kind", "tier"], ["kind"]], 3)
    return d.select("entity", "group_level", "group_id", "model_size", "low_sample", "assigned")


@query("m16_estimator_selection", with_(f"""
WITH d AS (SELECT mfs.*, kind FROM mfs JOIN dim USING (entity)), g AS (SELECT regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a, avg(y) AS m FROM d WHERE part = 'train'),
k AS (SELECT kind, regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a FROM d WHERE part = 'train' GROUP BY 1),
l AS (SELECT d.kind, y, early AS val, unnest(['zero', 'mean', 'pooled', 'own']) AS model, unnest([0.0, g.m, g.a + g.b * dev_lag, k.a + k.b * dev_lag]) AS yhat FROM d, g, k WHERE part = 'test' AND k.kind = d.kind),
s AS (SELECT kind, model, sqrt(avg(pow(y - yhat, 2)) FILTER (val)) AS v, sqrt(avg(pow(y - yhat, 2)) FILTER (NOT val)) AS rmse FROM l GROUP BY 1, 2)
SELECT kind, arg_min(model, (round(v * 1e9), model)) AS selected, {r('arg_min(rmse, (round(v * 1e9), model))')} AS rmse FROM s GROUP BY 1""").replace("\nWITH d AS", ",\nd AS"))
def m16(t):
    """The estimator is selected on the earlier slice; its error is reported on the later one."""
    tr, te = parts(t)
    kind = t.dim.select("entity", "kind")
    fit = lambda by, d: d.groupBy(*by).agg(F.regr_slope("y", "dev_lag").alias("b"), F.regr_intercept("y", "dev_lag").alias("a"), F.avg("y").alias("m"))
    x = J.with_scalars(te.join(kind, "entity").select("kind", "y", "dev_lag", F.col("early").alias("val")), fit([], tr), "g").join(fit(["kind"], tr.join(kind, "entity")), "kind")
    x = x.select("kind", "y", "val", F.lit(0.0).alias("zero"), F.col("g.m").alias("mean"), (F.col("g.a") + F.col("g.b") * F.col("dev_lag")).alias("pooled"), (F.col("a") + F.col("b") * F.col("dev_lag")).alias("own"))
    c = V.forecast_metrics(x.unpivot(["kind", "y", "val"], ["zero", "mean", "pooled", "own"], "model", "yhat"), ["kind", "model", "val"], "y", "yhat")
    best = V.select_best(c.where("val"), ["kind"], "rmse", "model").select("kind", "selected")
    held = c.where("not val").select("kind", F.col("model").alias("selected"), "rmse")
    return best.join(held, ["kind", "selected"], "left").select("kind", "selected", rnd("rmse").alias("rmse"))


@query("m17_cohort_split", with_("""
WITH c AS (SELECT entity, kind, row_number() OVER (PARTITION BY kind ORDER BY created, entity) AS i, count(*) OVER (PARTITION BY kind) AS n FROM dim), h AS (SELECT *, ceil(n * 0.3) AS nh, ceil((n - ceil(n * 0.3)) * 0.25) AS nv FROM c)
SELECT entity, kind, CASE WHEN i > n - nh THEN 'holdout' WHEN i > n - nh - nv THEN 'validation' ELSE 'train' END AS cohort FROM h""").replace("\nWITH c AS", ",\nc AS"))
def m17(t):
    return V.cohort_split(t.dim, "kind", ["created", "entity"]).select("entity", "kind", "cohort")


@query("m18_newcomer_features", with_(f"""
WITH p AS (SELECT pr.entity, pr.date, pr.date - created AS age, logp, kind FROM pr JOIN dim USING (entity)), nw AS (SELECT * FROM p WHERE kind = 'optional' AND age <= 720), mt AS (SELECT * FROM p WHERE kind = 'open')
SELECT n.entity, n.date, n.age, {r('n.logp - b.logp')} AS mom7, count(m.logp) AS n_ref, {r('CAST(count(m.logp) FILTER (m.logp <= n.logp) AS DOUBLE) / nullif(count(m.logp), 0)')} AS rank_ref
FROM nw n LEFT JOIN nw b ON b.entity = n.entity AND b.date = n.date - 7 LEFT JOIN mt m ON m.date = n.date GROUP BY n.entity, n.date, n.age, n.logp, b.logp""").replace("\nWITH p AS", ",\np AS"))
def m18(t):
    p = t.pr.join(t.dim.select("entity", "kind", "created"), "entity").select("entity", "date", F.datediff("date", "created").cast("long").alias("age"), "logp", "kind")
    new = p.where("kind = 'optional' and age <= 720").drop("kind")
    back = new.select("entity", F.date_add("date", 7).alias("date"), F.col("logp").alias("logp7"))
    d = J.rank_in_reference(new.join(back, ["entity", "date"], "left"), p.where("kind = 'open'"), "date", "logp", "rank_ref")
    return d.select("entity", "date", "age", rnd(F.col("logp") - F.col("logp7")).alias("mom7"), "n_ref", rnd("rank_ref").alias("rank_ref"))


CAL = ("cal", "SELECT y, dev_lag, CASE WHEN early THEN 'calibration' ELSE 'test' END AS slice FROM mfs WHERE part = 'test'")


@query("m19_conformal_coverage", with_(f"""
WITH g AS (SELECT regr_slope(y, dev_lag) AS b, regr_intercept(y, dev_lag) AS a FROM mfs WHERE part = 'train'), e AS (SELECT slice, abs(y - a - b * dev_lag) AS e FROM cal, g),
q AS (SELECT CAST(unnest([0.5, 0.8, 0.9]) AS DOUBLE) AS nominal, unnest([quantile_cont(e, 0.5), quantile_cont(e, 0.8), quantile_cont(e, 0.9)]) AS q FROM e WHERE slice = 'calibration')
SELECT nominal, count(*) AS n, {r('avg(CAST(e <= q AS INT))')} AS coverage, {r('max(q)')} AS half_width FROM e, q WHERE slice = 'test' GROUP BY 1""", CAL).replace("\nWITH g AS", ",\ng AS"))
def m19(t):
    tr, te = parts(t)
    fit = tr.agg(F.regr_slope("y", "dev_lag").alias("b"), F.regr_intercept("y", "dev_lag").alias("a"))
    p = J.with_scalars(te, fit, "g").withColumn("yhat", F.col("g.a") + F.col("g.b") * F.col("dev_lag"))
    w = V.conformal_halfwidths(p.where("early"), "y", "yhat", [0.5, 0.8, 0.9])
    d = V.interval_coverage(p.where("not early").select("y", "yhat"), w, "y", "yhat")
    return d.select("nominal", "n", rnd("coverage").alias("coverage"), rnd("half_width").alias("half_width"))


@query("m20_persist_and_score_latest")
def m20(t):
    tr, te = parts(t)
    path = scratch(t.spark, "model")
    m = L.fit_save(tr, FEATS, "y", path)
    w = V.conformal_halfwidths(m.transform(te.dropna(subset=FEATS)), "y", "prediction", [0.8])
    return L.score_latest(mf(t), path, FEATS, w)


@query("m21_permutation_importance")
def m21(t):
    from pyspark.ml.regression import LinearRegression
    tr, te = parts(t)
    m = LinearRegression(labelCol="y", featuresCol="features", regParam=1e-6).fit(L.assembled(tr, FEATS, "y"))
    return L.permutation_importance(m, te.select("entity", "date", *FEATS, "y").dropna(), FEATS, "y", ["entity", "date"])


@query("m22_shadow_feature_test")
def m22(t):
    return L.boruta(mf(t), FEATS, "y", ["entity", "date"])


@query("m23_selection_methods")
def m23(t):
    s = L.selection_methods(mf(t), FEATS, "y")
    return s.join(F.broadcast(L.consensus(s, 2)), "feature", "left").select("method", "feature", "rank", F.coalesce("votes", F.lit(0)).alias("votes"))


@query("m24_binned_mutual_information", with_(f"""
WITH j AS (SELECT a.bin AS xb, b.bin AS yb, count(*) AS c FROM xb a JOIN yb b USING (entity, date) GROUP BY 1, 2), t AS (SELECT sum(c) AS n FROM j)
SELECT {r('sum(c / n * ln(c * n / (cx * cy)))')} AS mi, CAST(max(n) AS BIGINT) AS n FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY xb) AS DOUBLE) AS cx, CAST(sum(c) OVER (PARTITION BY yb) AS DOUBLE) AS cy FROM j), t""",
    ("src", "SELECT entity, date, dev_lag AS x, y FROM mf WHERE dev_lag IS NOT NULL AND mf.y IS NOT NULL"), ("xb", qbin_sql("src", "x", 5)), ("yb", qbin_sql("src", "y", 5))).replace("\nWITH j AS", ",\nj AS"))
def m24(t):
    d = mf(t).where("dev_lag is not null and y is not null").select("entity", "date", F.col("dev_lag").alias("x"), "y")
    d = Q.quantile_bins(Q.quantile_bins(d, "x", 5, "xb"), "y", 5, "yb")
    return V.binned_mutual_information(d, "xb", "yb").select(rnd("mi").alias("mi"), "n")


@query("m25_interaction_search")
def m25(t):
    tr, te = parts(t)
    return L.interaction_search(tr, te, FEATS, "y")


def _grid(d, col):
    return Q.exact_quantiles(d, col, [i / 10 for i in range(1, 10)]).select(F.col("q").alias("value"))


@query("m26_partial_dependence")
def m26(t):
    tr, te = parts(t)
    m = L.regressors()["forest"].fit(L.assembled(tr, FEATS, "y"))
    return L.partial_dependence(m, te.select("entity", "date", *FEATS), FEATS, "dev_lag", _grid(tr, "dev_lag"))


@query("m27_counterfactual_flips")
def m27(t):
    from gridloom.operators.aggs import last_row
    tr, te = parts(t)
    m = L.regressors()["forest"].fit(L.assembled(tr, FEATS, "y"))
    last = last_row(te.dropna(subset=FEATS).select("entity", "date", *FEATS), ["entity"], ["date"])
    return L.counterfactual_flips(m, last, FEATS, "dev_lag", _grid(tr, "dev_lag"))


@query("m28_tuning_grid")
def m28(t):
    return L.tune(parts(t)[0], FEATS, "y", "date", [0.001, 0.1], [0.0, 0.5])


@query("m29_ensemble")
def m29(t):
    p = fold_preds(t, {"ridge", "forest"}, ("entity", "dev_lag"))
    e = p.groupBy("fold", "entity", "date").agg(F.avg("yhat").alias("yhat"), F.max("y").alias("y"), F.max("dev_lag").alias("dev_lag"))
    e = e.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(F.abs("dev_lag") > 0.1, "outside").otherwise("inside"))))
    return V.forecast_metrics(e, ["scope"], "y", "yhat")


@query("m30_band_conditional", with_(f"""
WITH d AS (SELECT y, dev_lag AS x, part, CASE WHEN abs(dev_lag) > 0.1 THEN 'outside' ELSE 'inside' END AS regime FROM mfs WHERE part IS NOT NULL), p AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE part = 'train'),
o AS (SELECT regime, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE part = 'train' GROUP BY 1)
SELECT d.regime, count(*) AS n, {r('1 - sum(pow(y - p.a - p.b * x, 2)) / sum(y * y)')} AS r2_pooled, {r('1 - sum(pow(y - o.a - o.b * x, 2)) / sum(y * y)')} AS r2_own FROM d, p, o WHERE part = 'test' AND o.regime = d.regime GROUP BY 1""").replace("\nWITH d AS", ",\nd AS"))
def m30(t):
    tr, te = parts(t)
    return L.band_conditional(tr, te, "y", "dev_lag", 0.1).select("regime", "n", rnd("r2_pooled").alias("r2_pooled"), rnd("r2_own").alias("r2_own"))


@query("m31_skill_by_state", with_(f"""
SELECT state, model, count(*) AS n, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse FROM (SELECT CASE WHEN disp > 1.2 THEN 'wide' ELSE 'calm' END AS state, y, unnest(['naive', 'drift']) AS model, unnest([naive, drift]) AS yhat FROM bl
 JOIN (SELECT date, stddev(logp) AS disp FROM pr GROUP BY 1) USING (date)) WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1, 2"""))
def m31(t):
    s = t.pr.groupBy("date").agg(F.when(F.stddev("logp") > 1.2, "wide").otherwise("calm").alias("state"))
    p = baselines(t).join(s, "date").unpivot(["state", "y"], ["naive", "drift"], "model", "yhat")
    return V.forecast_metrics(p, ["state", "model"], "y", "yhat").select("state", "model", "n", rnd("rmse").alias("rmse"))


SERIES = ["ret", "disp", "vol", "activity", "breadth", "turnover"]
MARKET = (("mk0", """SELECT date, avg(ret_row) AS ret, stddev(logp) AS disp, avg(vol) AS vol, ln(sum(volume)) AS activity, avg(CASE WHEN ret_row IS NOT NULL THEN CASE WHEN ret_row > 0 THEN 1.0 ELSE 0.0 END END) AS breadth, avg(turn) AS turnover
 FROM (SELECT date, logp, volume, ret_row, CASE WHEN count(ret_row) OVER f >= 7 THEN stddev(ret_row) OVER f END AS vol, volume / avg(volume) OVER s AS turn FROM pr
  WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 13 PRECEDING), s AS (PARTITION BY entity ORDER BY date ROWS 6 PRECEDING)) GROUP BY 1"""),
          ("mk", "SELECT * FROM mk0 WHERE ret IS NOT NULL AND disp IS NOT NULL AND vol IS NOT NULL AND activity IS NOT NULL AND breadth IS NOT NULL AND turnover IS NOT NULL"),
          ("mlab", "SELECT *, CAST(ret > 0 AS INT) + 2 * CAST(vol > (SELECT avg(vol) FROM mk) AS INT) AS state FROM mk"),
          ("mseq", "SELECT *, lag(state) OVER (ORDER BY date) AS prev_state FROM mlab"),
          ("mord", "SELECT *, sum(CASE WHEN prev_state = state THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run FROM mseq"),
          ("mrun", "SELECT run, any_value(state) AS state, min(date) AS starts, max(date) AS ends, count(*) AS days FROM mord GROUP BY 1"),
          ("mtra", "SELECT prev_state AS from_state, state AS to_state, count(*) AS n FROM mord WHERE prev_state IS NOT NULL GROUP BY 1, 2"))


def ruled_states(t):
    """Dates labelled by rule: sign of the return, volatility above its mean."""
    d = ST.market_series(t.pr)
    d = J.with_scalars(d, d.agg(F.avg("vol").alias("mid")), "_s")
    lab = d.select("date", *SERIES, ((F.col("ret") > 0).cast("int") + 2 * (F.col("vol") > F.col("_s.mid")).cast("int")).alias("state"))
    return ST.order_runs(lab)


@query("m32_regime_labelling")
def m32(t):
    """Profile of the states that a mixture finds in six market series."""
    lab = materialise(ST.mixture_states(ST.market_series(t.pr), SERIES), "states")
    return ST.state_profile(ST.order_runs(lab), SERIES, "ret", "vol")


@query("m32b_state_profile", with_(f"""
SELECT p.state, (CASE WHEN ret > 0 THEN 'expansion' ELSE 'contraction' END) || (CASE WHEN vol > (SELECT quantile_cont(vol, 0.5) FROM mprof) THEN ', high volatility' ELSE ', calm' END) AS label, p.days, {r('p.days / (SELECT sum(days) FROM mprof)')} AS share,
 {', '.join(f"{r(c)} AS {c}" for c in SERIES)}, {r('persistence')} AS persistence, {r('1 / nullif(1 - persistence, 0)', 4)} AS expected_stay, runs, {r('mean_run')} AS mean_run, longest_run
FROM mprof p JOIN (SELECT state, count(*) AS runs, avg(days) AS mean_run, max(days) AS longest_run FROM mrun GROUP BY 1) USING (state)
LEFT JOIN (SELECT from_state AS state, CAST(coalesce(sum(n) FILTER (from_state = to_state), 0) AS DOUBLE) / sum(n) AS persistence FROM mtra GROUP BY 1) USING (state)""",
    *MARKET, ("mprof", f"SELECT state, count(*) AS days, {', '.join(f'avg({c}) AS {c}' for c in SERIES)} FROM mord GROUP BY 1")))
def m32b(t):
    """Days, means, persistence and stretches of states given by rule."""
    p = ST.state_profile(ruled_states(t), SERIES, "ret", "vol")
    return p.select("state", "label", "days", *[rnd(c).alias(c) for c in ("share", *SERIES, "persistence")], rnd("expected_stay", 4).alias("expected_stay"), "runs", rnd("mean_run").alias("mean_run"), "longest_run")


@query("m32c_state_transitions", with_(f"SELECT from_state, to_state, n, {r('n / sum(n) OVER (PARTITION BY from_state)')} AS share FROM mtra", *MARKET))
def m32c(t):
    """How often each state follows each."""
    return ST.state_transitions(ruled_states(t)).select("from_state", "to_state", "n", rnd("share").alias("share"))


@query("m32d_state_runs", with_("SELECT CAST(run AS BIGINT) AS run, state, starts, ends, days FROM mrun", *MARKET))
def m32d(t):
    """Every stretch of one state."""
    return ST.state_runs(ruled_states(t)).select("run", "state", "starts", "ends", "days")


@query("m33_feature_family_share", with_(f"""
SELECT family, count(*) AS features, {r('sum(c) / (SELECT sum(c) FROM fc)')} AS share FROM (SELECT CASE WHEN regexp_matches(feature, '^dev') THEN 'deviation' WHEN regexp_matches(feature, '^ret') THEN 'return' ELSE 'other' END AS family, c FROM fc) GROUP BY 1""",
    ("fc", "SELECT unnest(['dev_lag', 'dev_mean3', 'ret_lag', 'lv_lag']) AS feature, unnest([abs(corr(dev_lag, y)), abs(corr(dev_mean3, y)), abs(corr(ret_lag, y)), abs(corr(lv_lag, y))]) AS c FROM mf")))
def m33(t):
    d = mf(t)
    c = d.agg(*[F.abs(safe_corr(f, "y")).alias(f) for f in FEATS]).unpivot([], FEATS, "feature", "c")
    from gridloom.operators.aggs import share_of_total
    fam = V.feature_family(c, "feature", [("^dev", "deviation"), ("^ret", "return")])
    n = fam.groupBy("family").agg(F.count("*").alias("features"))
    return share_of_total(fam, ["family"], "c").join(n, "family").select("family", "features", rnd("share").alias("share"))


@query("m34_exposure_oos", with_(f"""
WITH b AS (SELECT entity, date, ret_row AS y, lag(ln(volume)) OVER we AS l1, lag(ln(volume), 2) OVER we AS l2 FROM prm {WE}), sp AS (SELECT dd[CAST(floor(n * 0.7) AS BIGINT) + 1] AS s FROM (SELECT list(date ORDER BY date) AS dd, count(*) AS n FROM (SELECT DISTINCT date FROM prm))),
g AS (SELECT * FROM (SELECT entity, date <= s AS tr, y, unnest(['l1', 'l2']) AS exposure, unnest([l1, l2]) AS x FROM b, sp) WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT exposure, tr, y, avg(y) FILTER (tr) OVER e AS my, x - avg(x) FILTER (tr) OVER e AS xd FROM g WINDOW e AS (PARTITION BY exposure, entity)),
k AS (SELECT exposure, sum(xd * (y - my)) / sum(xd * xd) AS b FROM c WHERE tr GROUP BY 1)
SELECT exposure, count(*) AS n, {r('sqrt(avg(pow(y - my - b * xd, 2)))')} AS rmse, {r('1 - sqrt(avg(pow(y - my - b * xd, 2))) / sqrt(avg(y * y))', 5)} AS gain_frac FROM c JOIN k USING (exposure) WHERE NOT tr AND my IS NOT NULL GROUP BY 1""").replace("\nWITH b AS", ",\nb AS"))
def m34(t):
    w = W.series()
    d = t.prm.select("entity", "date", F.col("ret_row").alias("y"), F.lag(F.log("volume")).over(w).alias("l1"), F.lag(F.log("volume"), 2).over(w).alias("l2"))
    return L.exposure_oos(d, "y", ["l1", "l2"]).select("exposure", "n", rnd("rmse").alias("rmse"), rnd("gain_frac", 5).alias("gain_frac"))


@query("m35_sequence_windows", with_(f"""
SELECT entity, date, CAST(12 AS BIGINT) AS steps, {r('avg(logp) OVER f')} AS mean_logp, {r('first_value(logp) OVER f')} AS oldest FROM prm WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) QUALIFY count(ret_row) OVER f = 12"""))
def m35(t):
    d = X.sequence_windows(t.prm, ["logp", "ret_row"], 12)
    return d.select("entity", "date", F.size("seq").cast("long").alias("steps"), rnd(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0]) / 12).alias("mean_logp"), rnd(F.col("seq")[0][0]).alias("oldest"))


# ------------------------------------------------------------------ decisions

from gridloom.operators import quality as D, strategy as G  # noqa: E402
from gridloom.queries.trading import HOLD, score_sql  # noqa: E402

_ctq, _bodyq = score_sql("SELECT hs.*, gross - 0.01 AS net, cutoff FROM hs JOIN hc ON hs.h = hc.h WHERE period = 'holdout' AND absdev >= cutoff", ["h"])


def holdout_rows(t):
    h = G.holdout(t.dev, [1, 7, 30]).where("period = 'holdout'")
    return h.select(F.col("h").alias("horizon"), F.col("net_pct").alias("net"), F.col("t_stat").alias("t"), "windows", "share_profitable", "cutoff")


@query("q2_eligible_horizon", with_("SELECT min(h) AS horizon, arg_min(net_pct, h) AS net, arg_min(windows, h) AS windows FROM (" + _bodyq + ") WHERE t_stat >= 2 AND windows >= 10", *HOLD, *_ctq))
def q2(t):
    return D.eligible_horizon(holdout_rows(t)).select("horizon", rnd("net", 5).alias("net"), "windows")


@query("q1_decision_policy", with_(f"""
WITH l AS (SELECT entity, max(date) AS as_of, arg_max(dev, date) * 100 AS deviation, arg_max(ret_row, date) * 100 AS predicted FROM dev WHERE dev.dev IS NOT NULL GROUP BY 1), w AS (SELECT entity, stddev(ret_row) * 100 AS s FROM pr GROUP BY 1),
b AS (SELECT entity, CAST(sum(amount) AS DOUBLE) AS depth FROM book WHERE side = 'buy' AND time >= (SELECT dd[CAST(floor(len(dd) * 0.9) AS BIGINT) + 1] FROM (SELECT list(DISTINCT time ORDER BY time) AS dd FROM book)) GROUP BY 1), hz AS (SELECT min(h) AS horizon, arg_min(cutoff, h) * 100 AS cutoff, arg_min(share_profitable, h) AS sp FROM (SELECT x.*, hc.cutoff FROM ({_bodyq}) x JOIN hc ON hc.h = x.h) WHERE t_stat >= 2 AND windows >= 10),
j AS (SELECT l.*, predicted - 1.28 * s AS lo80, predicted + 1.28 * s AS hi80, depth, horizon, cutoff, sp, (SELECT max(as_of) FROM l) - as_of AS age FROM l JOIN w USING (entity) LEFT JOIN b USING (entity), hz)
SELECT entity, as_of, {r('deviation', 5)} AS deviation, horizon, CASE WHEN age > 7 OR horizon IS NULL THEN 'Abstain' WHEN depth < 25 THEN 'Avoid' WHEN abs(deviation) < 5 OR abs(deviation) < cutoff OR abs(deviation) <= 4 THEN 'Hold'
  WHEN (deviation > 0 AND predicted > 0) OR (deviation < 0 AND predicted < 0) THEN 'Investigate' WHEN deviation > 0 THEN 'Sell' ELSE 'Buy' END AS action,
 CASE WHEN age > 7 OR horizon IS NULL THEN 'none' WHEN depth < 25 THEN 'low' WHEN abs(deviation) < 5 THEN 'high' WHEN abs(deviation) < cutoff OR abs(deviation) <= 4 THEN 'medium'
  WHEN (deviation > 0 AND predicted > 0) OR (deviation < 0 AND predicted < 0) THEN 'low' WHEN (lo80 < 0 AND hi80 > 0) OR sp < 0.6 THEN 'low' ELSE 'medium' END AS confidence FROM j""", *HOLD, *_ctq).replace("\nWITH l AS", ",\nl AS"))
def q1(t):
    """Last deviation and naive forecast per entity through the ordered gates."""
    last = t.dev.where("dev is not null").groupBy("entity").agg(F.max("date").alias("as_of"), (F.max_by("dev", "date") * 100).alias("deviation"), (F.max_by("ret_row", "date") * 100).alias("predicted"))
    s = t.pr.groupBy("entity").agg((F.stddev("ret_row") * 100).alias("s"))
    p = last.join(s, "entity").select("entity", "as_of", "deviation", "predicted", (F.col("predicted") - 1.28 * F.col("s")).alias("lo80"), (F.col("predicted") + 1.28 * F.col("s")).alias("hi80"))
    since = V.cut_dates(t.book, "time", c=0.9)
    b = J.with_scalars(t.book.where("side = 'buy'"), since, "_s").where("time >= _s.c").groupBy("entity").agg(F.sum("amount").cast("double").alias("depth"))
    h = D.eligible_horizon(holdout_rows(t)).withColumn("cutoff", F.col("cutoff") * 100)
    return D.decide(p, b, h, band=5.0, round_trip=4.0).select("entity", "as_of", rnd("deviation", 5).alias("deviation"), "horizon", "action", "confidence")
