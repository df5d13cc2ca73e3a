"""Panel econometrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import div, half_life, rnd
from gridloom.operators import econometrics as E, evaluation as V, inference as I, joins as J, lagged as LG, moments as M, pairs as P, windows as W
from gridloom.registry import query
from gridloom.sqltext import CTE, define, r, with_, tail_sql

define("reg", """SELECT entity, date, logp, ln(volume) AS lv, CAST(n AS DOUBLE) AS k, ret_row, dev, lag(dev) OVER we AS dev_lag, dev - lag(dev) OVER we AS ddev,
  lead(dev) OVER we - dev AS dnext, lag(ln(volume)) OVER we AS lv_lag FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date)""")
define("regm", CTE["reg"].replace("FROM dev", "FROM devm"))


def reg(t, src="dev"):
    w = W.series()
    d = t.dev if src == "dev" else t.devm
    lv = F.log("volume")
    return d.select("entity", "date", "logp", lv.alias("lv"), F.col("n").cast("double").alias("k"), "ret_row", "dev", F.lag("dev").over(w).alias("dev_lag"),
                    (F.col("dev") - F.lag("dev").over(w)).alias("ddev"), (F.lead("dev").over(w) - F.col("dev")).alias("dnext"), F.lag(lv).over(w).alias("lv_lag"))


def rounded(df, *cols, keep=(), digits=5):
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in cols])


SWEEPS = 14


def two_way_sql(src: str, cols: list[str], where: str = "") -> list[tuple[str, str]]:
    """Unrolled alternating demeaning by entity and date."""
    out = [("s0", f"SELECT entity, date, {', '.join(cols)} FROM {src} {where}")]
    for i in range(SWEEPS):
        for j, g in enumerate(("entity", "date")):
            prev = out[-1][0]
            out.append((f"s{2 * i + j + 1}", "SELECT entity, date, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {g}) AS {c}" for c in cols) + f" FROM {prev}"))
    last = out[-1][0]
    out.append(("tw", f"SELECT * FROM {last}"))
    return out


@query("e1_absorb_two_way", with_(f"SELECT entity, date, {r('logp', 5)} AS logp, {r('lv', 5)} AS lv FROM tw", *two_way_sql("regm", ["logp", "lv"])))
def e1(t):
    d = M.complete(reg(t, "devm"), ["logp", "lv"], ["entity", "date"])
    return rounded(M.absorb(d, ["logp", "lv"], ["entity", "date"]), "logp", "lv", keep=("entity", "date"))


WITHIN = ("wd", "SELECT entity, date, logp - avg(logp) OVER e AS y, lv - avg(lv) OVER e AS a, k - avg(k) OVER e AS b FROM reg WINDOW e AS (PARTITION BY entity)")


@query("e2_panel_ols", with_(f"""
WITH m AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*) AS n, count(DISTINCT entity) AS g FROM wd),
c AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ba, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS bbeta FROM m),
v AS (SELECT *, yy - ba * ay - bbeta * by_ AS ssr FROM c)
SELECT 'lv' AS term, {r('ba', 5)} AS coef, {r('sqrt(ssr / (n - 2 - g) * bb / (aa * bb - ab * ab))', 5)} AS se, n, {r('1 - ssr / yy', 5)} AS r2_within FROM v UNION ALL
SELECT 'k', {r('bbeta', 5)}, {r('sqrt(ssr / (n - 2 - g) * aa / (aa * bb - ab * ab))', 5)}, n, {r('1 - ssr / yy', 5)} FROM v""", WITHIN).replace("\nWITH m AS", ",\nm AS"))
def e2(t):
    d = M.panel_ols(reg(t), "logp", ["lv", "k"], fe=["entity"])
    return rounded(d, "coef", "se", "r2_within", keep=("term", "n"))


# one regressor within entity: slope, residual and clustered meat
def clustered_sql(src, y, x, digits=5, where=""):
    return with_(f"""
WITH w AS (SELECT entity, date, {y} - avg({y}) OVER (PARTITION BY entity) AS y, {x} - avg({x}) OVER (PARTITION BY entity) AS x FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL {where}),
m AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT entity) AS ge, count(DISTINCT date) AS gd FROM w),
s AS (SELECT entity, date, x * (y - b * x) AS s FROM w, m),
q AS (SELECT (SELECT sum(z * z) FROM (SELECT sum(s) AS z FROM s GROUP BY entity)) AS me, (SELECT sum(z * z) FROM (SELECT sum(s) AS z FROM s GROUP BY date)) AS md, (SELECT sum(s * s) FROM s) AS mi)
SELECT n, {r('b', digits)} AS coef, {r('sqrt(me * ge / (ge - 1.0) * (n - 1.0) / (n - 1 - ge)) / sxx', digits)} AS se_entity,
 {r('sqrt(greatest(me * ge / (ge - 1.0) + md * gd / (gd - 1.0) - mi * n / (n - 1.0), 0) * (n - 1.0) / (n - 1 - ge)) / sxx', digits)} AS se_two_way,
 {r('sqrt(greatest(me * ge / (ge - 1.0) + md * gd / (gd - 1.0) - mi * n / (n - 1.0), me * ge / (ge - 1.0), md * gd / (gd - 1.0)) * (n - 1.0) / (n - 1 - ge)) / sxx', digits)} AS se_floor
FROM m, q""").replace("\nWITH w AS", ",\nw AS")


def clustered(d, y, x):
    one = M.panel_ols(d, y, [x], fe=["entity"], cluster=["entity"]).select("n", "coef", F.col("se").alias("se_entity"))
    two = M.panel_ols(d, y, [x], fe=["entity"], cluster=["entity", "date"]).select(F.col("se").alias("se_two_way"))
    return J.with_scalars(one, two, "w").select("n", rnd("coef", 5).alias("coef"), rnd("se_entity", 5).alias("se_entity"), rnd("w.se_two_way", 5).alias("se_two_way"))


@query("e3_cluster_robust", clustered_sql("reg", "dnext", "dev").rsplit(",\n", 1)[0] + "\nFROM m, q")
def e3(t):
    return clustered(reg(t), "dnext", "dev")


@query("e4_variance_floor", "SELECT n, coef, se_floor FROM (" + clustered_sql("reg", "logp", "lv") + ")")
def e4(t):
    d = M.panel_ols(reg(t), "logp", ["lv"], fe=["entity"], cluster=["entity", "date"], variance_floor=True)
    return d.select("n", rnd("coef", 5).alias("coef"), rnd("se", 5).alias("se_floor"))


def nw_sql(src, val, order, lag, by=""):
    """Newey-West by explicit lag products: rows (by, n, mean, se)."""
    b = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    gb = f"PARTITION BY {by}" if by else ""
    lagx = lag if lag is not None else "CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INT)"
    return f"""SELECT {b}max(n) AS n, max(mu) AS mean, sqrt(greatest(sum(CASE WHEN d = 0 THEN p ELSE 2 * (1 - CAST(d AS DOUBLE) / (lg + 1)) * p END), 0) / max(n) / max(n)) AS se FROM
 (SELECT {('a.' + by + ' AS ' + by + ', ') if by else ''}a.n, a.mu, a.lg, a.i - b.i AS d, (a.x - a.mu) * (b.x - b.mu) AS p FROM
   (SELECT *, {lagx} AS lg FROM (SELECT {b}{val} AS x, row_number() OVER ({gb} ORDER BY {order}) AS i, count(*) OVER ({gb}) AS n, avg({val}) OVER ({gb}) AS mu FROM {src} WHERE {val} IS NOT NULL)) a
   JOIN (SELECT {b}{val} AS x, row_number() OVER ({gb} ORDER BY {order}) AS i, avg({val}) OVER ({gb}) AS mu FROM {src} WHERE {val} IS NOT NULL) b ON {on}a.i - b.i BETWEEN 0 AND a.lg) {('GROUP BY ' + by) if by else ''}"""


@query("e5_newey_west_mean", with_(f"SELECT n, {r('mean')} AS mean, {r('se')} AS se, {r('mean / se', 4)} AS t FROM nwr",
                                   ("mk", "SELECT date, avg(ret_row) AS v FROM pr WHERE ret_row IS NOT NULL GROUP BY 1"), ("nwr", nw_sql("mk", "v", "date", None))))
def e5(t):
    s = I.nw_mean(I.per_date_mean(t.pr, [], "date", "ret_row"), "ret_row", "date")
    return s.select("n", rnd("mean").alias("mean"), rnd("se").alias("se"), rnd("t", 4).alias("t"))


@query("e6_per_date_collapse", with_(f"""
SELECT entity % 5 AS grp, count(*) AS n_dates, {r('avg(v)')} AS mean, CAST(floor((max(date) - min(date)) / 30.0) AS BIGINT) AS windows FROM
 (SELECT entity % 5 AS entity, date, avg(ret_row) AS v FROM pr WHERE ret_row IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def e6(t):
    d = t.pr.withColumn("grp", F.col("entity") % 5)
    p = I.per_date_mean(d, ["grp"], "date", "ret_row")
    w = I.independent_windows(p, "date", 30, ["grp"])
    return p.groupBy("grp").agg(F.count("*").alias("n_dates"), rnd(F.avg("ret_row")).alias("mean")).join(w, "grp")


@query("e7_fama_macbeth", with_(f"SELECT n, {r('mean', 5)} AS mean, {r('se', 5)} AS se FROM nwr",
                                ("sl", "SELECT date, regr_slope(dnext, dev) AS v FROM reg WHERE dnext IS NOT NULL AND reg.dev IS NOT NULL GROUP BY 1 HAVING count(*) >= 8"), ("nwr", nw_sql("sl", "v", "date", 5))))
def e7(t):
    return E.fama_macbeth(reg(t), "dnext", "dev", lags=5).select("n", rnd("mean", 5).alias("mean"), rnd("se", 5).alias("se"))


@query("e8_driscoll_kraay", with_(f"SELECT {r('b', 5)} AS coef, {r('se * n / sxx', 5)} AS se, n AS n_dates FROM nwr, m",
    ("w", "SELECT date, dnext - avg(dnext) OVER e AS y, dev - avg(dev) OVER e AS x FROM reg WHERE dnext IS NOT NULL AND reg.dev IS NOT NULL WINDOW e AS (PARTITION BY entity)"),
    ("m", "SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx FROM w"), ("h", "SELECT date, sum(x * (y - b * x)) AS v FROM w, m GROUP BY 1"), ("nwr", nw_sql("h", "v", "date", 7))))
def e8(t):
    return E.driscoll_kraay(reg(t), "dnext", "dev", "entity", 7).select(rnd("coef", 5).alias("coef"), rnd("se", 5).alias("se"), "n_dates")


@query("e9_event_study", with_(f"""
SELECT 'post_month_end' AS flag, (SELECT coef FROM ({{inner}})) AS coef, (SELECT se_entity FROM ({{inner}})) AS se, 0.0::DOUBLE AS residual_sd, false AS identified""".replace("{inner}", "SELECT * FROM est"),
    ("ev", "SELECT pr.entity, pr.date, ret_row, CAST(coalesce(ev_month_end, 0) AS DOUBLE) AS f FROM pr LEFT JOIN calendar USING (date)"),
    ("w", "SELECT entity, date, ret_row - avg(ret_row) OVER (PARTITION BY entity) AS y, f - avg(f) OVER (PARTITION BY entity) AS x FROM ev WHERE ret_row IS NOT NULL"),
    ("m", "SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT entity) AS ge FROM w"),
    ("est", f"SELECT {r('b', 5)} AS coef, {r('sqrt(me * ge / (ge - 1.0) * (n - 1.0) / (n - 1 - ge)) / sxx', 5)} AS se_entity FROM m, (SELECT sum(z * z) AS me FROM (SELECT sum(x * (y - b * x)) AS z FROM w, m GROUP BY entity))"))
    .replace("{SELECT * FROM est}", "SELECT * FROM est"))
def e9(t):
    """Entity-effect event coefficient, and the check that a common date flag is not identified under date effects."""
    d = t.pr.join(t.calendar.select("date", "ev_month_end"), "date", "left").withColumn("post_month_end", F.coalesce("ev_month_end", F.lit(0)).cast("double"))
    c = M.panel_ols(d, "ret_row", ["post_month_end"], fe=["entity"], cluster=["entity"])
    i = E.identification(d, ["post_month_end"])
    return J.with_scalars(c, i, "i").select(F.col("i.flag").alias("flag"), rnd("coef", 5).alias("coef"), rnd("se", 5).alias("se"),
                                            rnd("i.residual_sd").alias("residual_sd"), F.col("i.identified").alias("identified"))


@query("e10_welch_contrast", with_(f"""
SELECT {r('avg(ret_row) FILTER (f)')} AS mean_on, {r('avg(ret_row) FILTER (NOT f)')} AS mean_off, count(ret_row) FILTER (f) AS n_on, count(ret_row) FILTER (NOT f) AS n_off,
 {r('(avg(ret_row) FILTER (f) - avg(ret_row) FILTER (NOT f)) / sqrt(var_samp(ret_row) FILTER (f) / count(ret_row) FILTER (f) + var_samp(ret_row) FILTER (NOT f) / count(ret_row) FILTER (NOT f))', 5)} AS t
FROM (SELECT ret_row, isodow(date) >= 6 AS f FROM pr)"""))
def e10(t):
    return rounded(E.welch(t.pr.withColumn("f", F.weekday("date") >= 5), "f", "ret_row"), "mean_on", "mean_off", keep=("n_on", "n_off"), digits=6).join(
        E.welch(t.pr.withColumn("f", F.weekday("date") >= 5), "f", "ret_row").select("n_on", rnd("t", 5).alias("t")), "n_on")


GAP_CASE = ("CASE WHEN {x} >= 0.10 THEN '>10%' WHEN {x} >= 0.06 THEN '6-10%' WHEN {x} >= 0.04 THEN '4-6%' WHEN {x} >= 0.02 THEN '2-4%' WHEN {x} >= 0 THEN '0-2%' END")
CLOSURE = ("cl", f"""SELECT date, entity, {GAP_CASE.format(x='al')} AS bin, (al - ad) * 100 AS v FROM
  (SELECT entity, date, abs(dev) AS ad, CASE WHEN date - lag(date) OVER we = 1 THEN lag(abs(dev)) OVER we END AS al FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date)) WHERE al IS NOT NULL AND ad IS NOT NULL""")


@query("e11_band_table", with_(f"""
SELECT bin, g.n, n_dates, {r('CASE WHEN g.n >= 30 THEN m END', 5)} AS closure_pp, {r('CASE WHEN g.n >= 30 THEN se END', 5)} AS se
FROM (SELECT bin, count(*) AS n, avg(v) AS m FROM cl GROUP BY 1) g JOIN (SELECT bin, n AS n_dates, se FROM nwr) USING (bin)""",
    CLOSURE, ("cd", "SELECT bin, date, avg(v) AS v FROM cl GROUP BY 1, 2"), ("nwr", nw_sql("cd", "v", "date", None, "bin"))))
def e11(t):
    return E.band_table(t.dev).select("bin", "n", "n_dates", rnd("closure_pp", 5).alias("closure_pp"), rnd("se", 5).alias("se"))


@query("e11b_band_subsamples", with_(f"""
SELECT scope, arg_min(bin, CASE bin WHEN '0-2%' THEN 0 WHEN '2-4%' THEN 1 WHEN '4-6%' THEN 2 WHEN '6-10%' THEN 3 ELSE 4 END) FILTER (m > 0) AS first_positive_bin FROM
 (SELECT scope, bin, CASE WHEN count(*) >= 30 THEN avg(v) END AS m FROM (SELECT CAST(year(date) AS VARCHAR) AS scope, bin, v FROM cl UNION ALL SELECT region, bin, v FROM cl JOIN dim USING (entity)) GROUP BY 1, 2) GROUP BY 1""", CLOSURE))
def e11b(t):
    # the lag must not jump between scopes, so it is taken before the labels multiply the rows
    c = E.closures(t.dev).join(t.dim.select("entity", "region"), "entity").withColumn("scope", F.explode(F.array(F.year("date").cast("string"), "region")))
    c = c.withColumn("bin", S.cut_bins("absdev_lag", E.GAP_EDGES, E.GAP_LABELS)).where("bin is not null and closure_pp is not null")
    g = c.groupBy("scope", "bin").agg(F.when(F.count("*") >= 30, F.avg("closure_pp")).alias("closure_pp"))
    return E.first_positive_bin(g, ["scope"])


@query("e12_persistence", with_(f"""
WITH p AS (SELECT h, a.entity, a.dev AS x, b.dev AS y FROM dev a, (SELECT unnest([1, 2, 5, 10, 30]) AS h) g JOIN dev b ON b.entity = a.entity AND b.date = a.date + h WHERE a.dev IS NOT NULL AND b.dev IS NOT NULL),
w AS (SELECT h, entity, x - avg(x) OVER (PARTITION BY h, entity) AS x, y - avg(y) OVER (PARTITION BY h, entity) AS y FROM p)
SELECT h, {r('sum(x * y) / sum(x * x)', 5)} AS rho, count(*) AS n FROM w GROUP BY 1""".replace("FROM dev a, (SELECT unnest([1, 2, 5, 10, 30]) AS h) g JOIN dev b ON b.entity = a.entity AND b.date = a.date + h",
    "FROM (SELECT *, unnest([1, 2, 5, 10, 30]) AS h FROM dev) a JOIN dev b ON b.entity = a.entity AND b.date = a.date + a.h")).replace("\nWITH p AS", ",\np AS"))
def e12(t):
    return E.persistence(t.dev, "dev", [1, 2, 5, 10, 30]).select("h", rnd("rho", 5).alias("rho"), "n")


@query("e12b_weekly_persistence", with_(f"""
WITH wk AS (SELECT entity, CAST(date_trunc('week', date) AS DATE) AS d, avg(dev) AS v FROM dev GROUP BY 1, 2), l AS (SELECT entity, v, lag(v) OVER (PARTITION BY entity ORDER BY d) AS x FROM wk),
w AS (SELECT v - avg(v) OVER (PARTITION BY entity) AS y, x - avg(x) OVER (PARTITION BY entity) AS x FROM l WHERE v IS NOT NULL AND x IS NOT NULL)
SELECT {r('sum(x * y) / sum(x * x)', 5)} AS rho, count(*) AS n FROM w""").replace("\nWITH wk AS", ",\nwk AS"))
def e12b(t):
    wk = t.dev.groupBy("entity", F.date_trunc("week", "date").cast("date").alias("d")).agg(F.avg("dev").alias("v"))
    wk = W.row_lag(wk, "v", "x", date="d")
    return M.panel_ols(wk, "v", ["x"], fe=["entity"], cluster=["entity"]).select(rnd("coef", 5).alias("rho"), "n")


@query("e13_reversion_by_spacing", with_(f"""
SELECT spacing, {r('regr_slope(y, x)', 5)} AS slope, count(*) AS n FROM (
 SELECT 1 AS spacing, lag(dev) OVER we AS x, lead(dev, 1) OVER we - dev AS y FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date) UNION ALL
 SELECT 7, lag(dev) OVER we, lead(dev, 7) OVER we - dev FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date) UNION ALL
 SELECT 14, lag(dev) OVER we, lead(dev, 14) OVER we - dev FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date)) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1"""))
def e13(t):
    return E.slope_by_spacing(t.dev, "dev", [1, 7, 14]).select("spacing", rnd("slope", 5).alias("slope"), "n")


def tar_sql(src, form):
    grid = ", ".join(f"quantile_cont(abs(x), {0.05 + 0.85 * i / 19!r})" for i in range(20))
    if form == "two":
        regs = ("a", "CASE WHEN abs(x) <= g THEN x ELSE 0 END"), ("b", "CASE WHEN abs(x) <= g THEN 0 ELSE x END")
    else:
        regs = ("a", "sign(x) * greatest(abs(x) - g, 0)"), ("b", "0.0")
    dem = ", ".join(f"{e} - avg({e}) OVER p AS {n}" for n, e in regs)
    fit = ("((bb * ay - ab * by_) * ay + (aa * by_ - ab * ay) * by_) / (aa * bb - ab * ab)" if form == "two" else "ay * ay / aa")
    return with_(f"""
WITH z AS (SELECT entity, x, y, unnest((SELECT list_distinct(list_transform([{grid}], lambda q: round(q * 1e6) / 1e6)) FROM src)) AS g FROM src),
w AS (SELECT g, y - avg(y) OVER p AS y, {dem} FROM z WINDOW p AS (PARTITION BY g, entity)),
m AS (SELECT g, count(*) AS n, sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM w GROUP BY g)
SELECT {r('g')} AS gamma, {r('yy - ' + fit, 3)} AS ssr FROM m""", ("src", src)).replace("\nWITH z AS", ",\nz AS")


SRC2 = "SELECT entity, dev AS y, dev_lag AS x FROM reg WHERE reg.dev IS NOT NULL AND dev_lag IS NOT NULL"
GRID = {"lo": 0.05, "hi": 0.90, "points": 20}


@query("e14_threshold_ar", tar_sql(SRC2, "two"))
def e14(t):
    return E.threshold_ar(reg(t), "dev", "dev_lag", **GRID).select(rnd("gamma").alias("gamma"), rnd("ssr", 3).alias("ssr"))


@query("e14b_threshold_estimate")
def e14b(t):
    """Minimiser, its likelihood-ratio set and a sign-flip bootstrap of the gain."""
    est = E.threshold_estimate(E.threshold_ar(reg(t), "dev", "dev_lag", **GRID))
    boot = E.threshold_bootstrap(reg(t), "dev", "dev_lag", draws=200, **GRID)
    out = J.with_scalars(est, boot, "b")
    return out.select("gamma", "lo", "hi", "rho_in", "rho_out", "share_inside", "n", half_life("rho_out").alias("half_life_out"), F.col("b.f_obs").alias("f_obs"), F.col("b.p_boot").alias("p_boot"))


@query("e15_band_tar", tar_sql("SELECT entity, dev - dev_lag AS y, dev_lag AS x FROM reg WHERE reg.dev IS NOT NULL AND dev_lag IS NOT NULL", "band"))
def e15(t):
    return E.threshold_ar(reg(t), "ddev", "dev_lag", form="band", **GRID).select(rnd("gamma").alias("gamma"), rnd("ssr", 3).alias("ssr"))


@query("e16_weekly_tar", tar_sql("""SELECT entity, v AS y, x FROM (SELECT entity, v, lag(v) OVER (PARTITION BY entity ORDER BY d) AS x FROM
 (SELECT entity, CAST(date_trunc('week', date) AS DATE) AS d, avg(dev) AS v FROM dev WHERE dev.dev IS NOT NULL GROUP BY 1, 2)) WHERE v IS NOT NULL AND x IS NOT NULL""", "two"))
def e16(t):
    wk = t.dev.where("dev is not null").groupBy("entity", F.date_trunc("week", "date").cast("date").alias("d")).agg(F.avg("dev").alias("v"))
    return E.threshold_ar(W.row_lag(wk, "v", "x", date="d"), "v", "x", **GRID).select(rnd("gamma").alias("gamma"), rnd("ssr", 3).alias("ssr"))


LAGS = "lag(dev) OVER we AS x, lag(ret_row) OVER we AS r1"


def two_reg_sql(src, digits=5, fe="entity"):
    """Within-entity regression of y on a and b by the 2 x 2 normal equations."""
    p = f"PARTITION BY {fe}" if fe else ""
    return with_(f"""
WITH w AS (SELECT y - avg(y) OVER ({p}) AS y, a - avg(a) OVER ({p}) AS a, b - avg(b) OVER ({p}) AS b FROM src WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, count(*) AS n FROM w)
SELECT n, {r('(bb * ay - ab * by_) / (aa * bb - ab * ab)', digits)} AS coef_a, {r('(aa * by_ - ab * ay) / (aa * bb - ab * ab)', digits)} AS coef_b FROM m""", ("src", src)).replace("\nWITH w AS", ",\nw AS")


def two_coefs(df, a, b):
    pick = lambda c: F.max(F.when(F.col("term") == c, F.col("coef")))
    return df.agg(F.max("n").alias("n"), rnd(pick(a), 5).alias("coef_a"), rnd(pick(b), 5).alias("coef_b"))


@query("e17_error_correction", two_reg_sql("SELECT entity, ret_row AS y, lag(dev) OVER we AS a, lag(ret_row) OVER we AS b FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date)"))
def e17(t):
    w = W.series()
    d = t.dev.select("entity", "date", "ret_row", F.lag("dev").over(w).alias("ecm"), F.lag("ret_row").over(w).alias("short"))
    return two_coefs(M.panel_ols(d, "ret_row", ["ecm", "short"], fe=["entity"], cluster=["entity"]), "ecm", "short")


@query("e18_adf_panel", with_(f"""
WITH s AS (SELECT entity, y, x - avg(x) OVER e AS x, d1 - avg(d1) OVER e AS d1, y - avg(y) OVER e AS yc FROM (SELECT entity, logp - lag(logp) OVER we AS y, lag(logp) OVER we AS x,
   lag(logp) OVER we - lag(logp, 2) OVER we AS d1 FROM prm WINDOW we AS (PARTITION BY entity ORDER BY date)) WHERE d1 IS NOT NULL WINDOW e AS (PARTITION BY entity)),
m AS (SELECT entity, count(*) AS n, sum(x * x) AS aa, sum(d1 * d1) AS bb, sum(x * d1) AS ab, sum(x * yc) AS ay, sum(d1 * yc) AS by_, sum(yc * yc) AS yy FROM s GROUP BY 1),
c AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT entity, n, {r('b1', 5)} AS rho, {r('b1 / sqrt((yy - b1 * ay - b2 * by_) / (n - 3) * bb / (aa * bb - ab * ab))', 4)} AS adf_t FROM c""").replace("\nWITH s AS", ",\ns AS"))
def e18(t):
    return E.adf(t.prm, "logp").select("entity", "n", rnd("rho", 5).alias("rho"), rnd("adf_t", 4).alias("adf_t"))


def _unit_root_sql(lags: int = 5) -> list[tuple[str, str]]:
    """Differences taken out of step and level one after the other; each stage gives the statistic with one more lag."""
    ds = [f"d{k}" for k in range(1, lags + 1)]
    names = ["y", "x", *ds]
    ctes = [("ur0", """SELECT entity, date, dev - lag(dev) OVER we AS y, lag(dev) OVER we AS x FROM dev WHERE dev IS NOT NULL WINDOW we AS (PARTITION BY entity ORDER BY date)"""),
            ("ur1", f"SELECT entity, y, x, {', '.join(f'lag(y, {k}) OVER we AS d{k}' for k in range(1, lags + 1))} FROM ur0 WINDOW we AS (PARTITION BY entity ORDER BY date)"),
            ("ura", f"SELECT entity, {', '.join(f'{c} - avg({c}) OVER e AS {c}' for c in names)}, count(*) OVER e AS n FROM ur1 WHERE d{lags} IS NOT NULL WINDOW e AS (PARTITION BY entity)")]
    stages, src = [], "ura"
    for p in range(lags + 1):
        if p:
            ctes.append((f"urs{p}", f"SELECT entity, n, {', '.join(f'{c} - d{p} * sum({c} * d{p}) OVER e / sum(d{p} * d{p}) OVER e AS {c}' for c in ['y', 'x', *ds[p:]])} FROM {src} WINDOW e AS (PARTITION BY entity)"))
            src = f"urs{p}"
        stages.append(f"SELECT entity, max(n) AS n, {p} AS lag, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM {src} GROUP BY 1")
    ctes.append(("urt", "SELECT *, yy - xy * xy / xx AS rss FROM (" + " UNION ALL ".join(stages) + ")"))
    ctes.append(("urc", "SELECT entity, n, CAST(lag AS BIGINT) AS lag, xy / sqrt(xx) / sqrt(rss / (n - lag - 2)) AS adf_t, row_number() OVER (PARTITION BY entity ORDER BY round(n * ln(rss / n) + 2 * (lag + 2), 8), lag) AS k FROM urt WHERE n >= 30"))
    ctes.append(("urz", """SELECT entity, n, lag, adf_t, greatest(least(CASE WHEN adf_t <= -1.61 THEN 2.1659 + 1.4412 * adf_t + 0.038269 * pow(adf_t, 2)
   ELSE 1.7339 + 0.93202 * adf_t - 0.12745 * pow(adf_t, 2) - 0.010368 * pow(adf_t, 3) END, 7.0344869), -7.0344869) AS z FROM urc WHERE k = 1"""))
    return ctes


@query("e18b_unit_roots", with_(f"SELECT entity, n, lag, {r('adf_t', 4)} AS adf_t, {r('z', 4)} AS z FROM urz", *_unit_root_sql()))
def e18b(t):
    """Unit root of every deviation series, lags chosen by criterion."""
    return LG.unit_roots(t.dev, "dev").select("entity", "n", "lag", rnd("adf_t", 4).alias("adf_t"), rnd("z", 4).alias("z"))


@query("e18c_unit_roots_combined", with_(f"""SELECT count(*) AS entities, {r('avg(CAST(z < -1.6448536 AS DOUBLE))')} AS share_reject, {r('sum(z) / sqrt(count(*))', 4)} AS combined_z,
 {r('avg(lag)')} AS mean_lag, {r("CASE WHEN sum(z) < 0 THEN 0.5 * " + tail_sql("(sum(z) / sqrt(count(*)))") + " ELSE 1 - 0.5 * " + tail_sql("(sum(z) / sqrt(count(*)))") + " END", 5)} AS p FROM urz""", *_unit_root_sql()))
def e18c(t):
    """Inverse-normal combination over the entities, with its lower-tail p-value."""
    c = I.normal_tail(LG.combine_unit_roots(LG.unit_roots(t.dev, "dev")), "combined_z", "two_sided")
    half = F.col("two_sided") / 2
    return c.select("entities", rnd("share_reject").alias("share_reject"), rnd("combined_z", 4).alias("combined_z"), rnd("mean_lag").alias("mean_lag"),
                    rnd(F.when(F.col("combined_z") < 0, half).otherwise(1 - half), 5).alias("p"))


@query("e19_kpss", with_(f"""
WITH e AS (SELECT entity, date, logp - avg(logp) OVER (PARTITION BY entity) AS e, count(*) OVER (PARTITION BY entity) AS n, CAST(floor(4 * pow(count(*) OVER (PARTITION BY entity) / 100.0, 0.25)) AS INT) AS lg,
  row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM prm),
l AS (SELECT a.entity, sum(CASE WHEN a.i = b.i THEN a.e * b.e ELSE 2 * (1 - CAST(a.i - b.i AS DOUBLE) / (a.lg + 1)) * a.e * b.e END) / max(a.n) AS lrv FROM e a JOIN e b ON a.entity = b.entity AND a.i - b.i BETWEEN 0 AND a.lg GROUP BY 1),
s AS (SELECT entity, max(n) AS n, sum(c * c) AS ss FROM (SELECT entity, n, sum(e) OVER (PARTITION BY entity ORDER BY date) AS c FROM e) GROUP BY 1)
SELECT entity, n, {r('ss / (n * n * lrv)', 5)} AS kpss FROM s JOIN l USING (entity)""").replace("\nWITH e AS", ",\ne AS"))
def e19(t):
    return E.kpss(t.prm, "logp").select("entity", "n", rnd("kpss", 5).alias("kpss"))


@query("e20_ljung_box", with_(f"""
WITH e AS (SELECT entity, ret_row - avg(ret_row) OVER (PARTITION BY entity) AS e, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS n FROM pr WHERE ret_row IS NOT NULL),
g AS (SELECT a.entity, a.i - b.i AS k, sum(a.e * b.e) AS g, max(a.n) AS n FROM e a JOIN e b ON a.entity = b.entity AND a.i - b.i BETWEEN 0 AND 10 GROUP BY 1, 2),
z AS (SELECT entity, g AS g0 FROM g WHERE k = 0)
SELECT entity, max(n) AS n, {r('max(n) * (max(n) + 2) * sum(pow(g / g0, 2) / (n - k))', 4)} AS q, {r('max(g / g0) FILTER (k = 1)', 5)} AS ac1 FROM g JOIN z USING (entity) WHERE k > 0 GROUP BY 1""").replace("\nWITH e AS", ",\ne AS"))
def e20(t):
    return E.ljung_box(t.pr, "ret_row", 10).select("entity", "n", rnd("q", 4).alias("q"), rnd("ac1", 5).alias("ac1"))


MKT = ("mo", "SELECT entity, date, logp, ret_row, (sum(logp) OVER d - logp) / (count(*) OVER d - 1) AS m FROM (SELECT * FROM prm) WINDOW d AS (PARTITION BY date)")


@query("e21_engle_granger", with_(f"""
WITH b AS (SELECT entity, regr_slope(logp, m) AS b, regr_intercept(logp, m) AS a, regr_r2(logp, m) AS r2 FROM mo GROUP BY 1),
u AS (SELECT entity, date, logp - a - b * m AS u FROM mo JOIN b USING (entity)),
s AS (SELECT entity, u - lag(u) OVER we AS y, lag(u) OVER we AS x FROM u WINDOW we AS (PARTITION BY entity ORDER BY date)),
m2 AS (SELECT entity, count(*) AS n, sum(x * y) / sum(x * x) AS rho, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM s WHERE x IS NOT NULL GROUP BY 1)
SELECT entity, {r('b', 5)} AS b, {r('r2', 5)} AS r2, n, {r('rho / sqrt((yy - rho * xy) / (n - 1) / xx)', 4)} AS eg_t FROM m2 JOIN b USING (entity)""", MKT).replace("\nWITH b AS", ",\nb AS"))
def e21(t):
    d = J.leave_one_out(t.prm, ["date"], "logp", "m")
    return E.engle_granger(d, "logp", "m").select("entity", rnd("b", 5).alias("b"), rnd("r2", 5).alias("r2"), "n", rnd("eg_t", 4).alias("eg_t"))


@query("e22_variance_ratio", with_(f"""
WITH e AS (SELECT entity, ret_row AS r, avg(ret_row) OVER (PARTITION BY entity) AS mu, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS n FROM pr WHERE ret_row IS NOT NULL),
v AS (SELECT entity, max(n) AS n, sum(pow(r - mu, 2)) AS ss FROM e GROUP BY 1),
q AS (SELECT *, unnest([2, 5, 10, 20]) AS q FROM v),
c AS (SELECT entity, i, mu, sum(r) OVER (PARTITION BY entity ORDER BY i) AS c FROM e),
rq AS (SELECT q.entity, q.q, sum(pow(c.c - coalesce(p.c, 0) - q.q * c.mu, 2)) AS sq FROM q JOIN c ON c.entity = q.entity AND c.i >= q.q LEFT JOIN c p ON p.entity = c.entity AND p.i = c.i - q.q GROUP BY 1, 2),
d AS (SELECT a.entity, a.i - b.i AS j, sum(pow(a.r - a.mu, 2) * pow(b.r - b.mu, 2)) AS d FROM e a JOIN e b ON a.entity = b.entity AND a.i - b.i BETWEEN 1 AND 19 GROUP BY 1, 2),
dl AS (SELECT q.entity, q.q, sum(pow(2.0 * (q.q - d.j) / q.q, 2) * d.d / (q.ss * q.ss)) AS dl FROM q JOIN d ON d.entity = q.entity AND d.j < q.q GROUP BY 1, 2)
SELECT q.entity, q.q, n, {r('sq / (q.q * (n - q.q + 1) * (1 - CAST(q.q AS DOUBLE) / n)) / (ss / (n - 1))', 5)} AS vr,
 {r('(sq / (q.q * (n - q.q + 1) * (1 - CAST(q.q AS DOUBLE) / n)) / (ss / (n - 1)) - 1) / sqrt(dl)', 4)} AS z
FROM q JOIN rq ON q.entity = rq.entity AND q.q = rq.q JOIN dl ON dl.entity = q.entity AND dl.q = q.q""").replace("\nWITH e AS", ",\ne AS"))
def e22(t):
    return E.variance_ratio(t.pr, "ret_row").select("entity", "q", "n", rnd("vr", 5).alias("vr"), rnd("z", 4).alias("z"))


@query("e23_roll_spread", with_(f"""
SELECT entity, count(*) AS n, {r('covar_samp(r, l)', 5)} AS gamma1, {r('corr(r, l)', 5)} AS ac1, {r('CASE WHEN covar_samp(r, l) < 0 THEN 200 * sqrt(-covar_samp(r, l)) END', 4)} AS roll_spread_pct
FROM (SELECT entity, ret_row AS r, lag(ret_row) OVER (PARTITION BY entity ORDER BY date) AS l FROM pr WHERE ret_row IS NOT NULL) GROUP BY 1"""))
def e23(t):
    return E.roll_spread(t.pr, "ret_row").select("entity", "n", rnd("gamma1", 5).alias("gamma1"), rnd("ac1", 5).alias("ac1"), rnd("roll_spread_pct", 4).alias("roll_spread_pct"))


@query("e24_market_model", with_(f"""
SELECT entity, count(*) AS n, {r('regr_slope(r, m)', 5)} AS beta, {r('regr_r2(r, m)', 5)} AS r2, {r('sqrt(regr_syy(r, m) * (1 - regr_r2(r, m)) / (count(*) - 2))', 5)} AS idio_sd FROM
 (SELECT entity, ret_row AS r, (sum(ret_row) OVER d - ret_row) / nullif(count(*) OVER d - 1, 0) AS m FROM pr WHERE ret_row IS NOT NULL WINDOW d AS (PARTITION BY date)) WHERE m IS NOT NULL GROUP BY 1"""))
def e24(t):
    return E.market_model(t.pr, "ret_row").select("entity", "n", rnd("beta", 5).alias("beta"), rnd("r2", 5).alias("r2"), rnd("idio_sd", 5).alias("idio_sd"))


@query("e25_panel_pca")
def e25(t):
    """First three components of monthly returns: explained share and entity loadings."""
    share, dated, load = E.panel_pca(t.prm, "ret_row", 3)
    return load.select("entity", *[rnd(f"load{i}").alias(f"load{i}") for i in (1, 2, 3)])


@query("e25b_factor_scores")
def e25b(t):
    """Lagged scores of all months on loadings that come from the first part of the months only."""
    share, dated, load = E.panel_pca(t.prm, "ret_row", 3, train=F.col("date") <= "1997-06-01")
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return dated.select("date", *[F.lag(f"pc{i}").over(w).alias(f"pc{i}_lag") for i in (1, 2, 3)])


@query("e26_granger", with_(f"""
WITH s AS (SELECT entity, y - avg(y) OVER e AS y, a - avg(a) OVER e AS a, b - avg(b) OVER e AS b FROM (SELECT entity, ret_row AS y, lag(ret_row) OVER we AS a, lag(lv) OVER we AS b FROM regm WINDOW we AS (PARTITION BY entity ORDER BY date))
  WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL WINDOW e AS (PARTITION BY entity)),
m AS (SELECT entity, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM s GROUP BY 1),
f AS (SELECT entity, n, yy - ay * ay / aa AS sr, yy - ((bb * ay - ab * by_) * ay + (aa * by_ - ab * ay) * by_) / (aa * bb - ab * ab) AS su FROM m)
SELECT entity, n, {r('(sr - su) / (su / (n - 3))', 4)} AS f FROM f""").replace("\nWITH s AS", ",\ns AS"))
def e26(t):
    return E.granger(reg(t, "devm"), "ret_row", "lv", 1).select("entity", "n", rnd("f", 4).alias("f"))


DM = (("pred", "SELECT entity, date, entity % 3 AS grp, ret_row AS y, lag(ret_row) OVER we AS naive FROM pr WINDOW we AS (PARTITION BY entity ORDER BY date)"),
      ("ld", "SELECT grp, date, avg(pow(y - 0, 2) - pow(y - naive, 2)) AS v FROM pred WHERE y IS NOT NULL AND naive IS NOT NULL GROUP BY 1, 2"))


@query("e27_diebold_mariano", with_(f"SELECT grp, n, {r('mean', 5)} AS mean, {r('mean / se', 4)} AS t FROM nwr", *DM, ("nwr", nw_sql("ld", "v", "date", 6, "grp"))))
def e27(t):
    d = t.pr.select("entity", "date", (F.col("entity") % 3).alias("grp"), F.col("ret_row").alias("y"), F.lit(0.0).alias("zero"), F.lag("ret_row").over(W.series()).alias("naive"))
    return I.diebold_mariano(d, ["grp"], "date", "y", "zero", "naive", 6).select("grp", "n", rnd("mean", 5).alias("mean"), rnd("t", 4).alias("t"))


TSTAT = ("ts", "SELECT entity, year(date) AS fold, avg(ret_row) / (stddev(ret_row) / sqrt(count(ret_row))) AS z FROM pr GROUP BY 1, 2")


def tstats(t):
    return t.pr.groupBy("entity", F.year("date").cast("long").alias("fold")).agg((F.avg("ret_row") / (F.stddev("ret_row") / F.sqrt(F.count("ret_row")))).alias("z"))


@query("e28_stouffer", with_(f"SELECT entity, {r('sum(z) / sqrt(count(z))')} AS z_combined, count(z) AS k, CAST(sum(CASE WHEN z < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_better FROM ts GROUP BY 1", TSTAT))
def e28(t):
    return I.stouffer(tstats(t), ["entity"], "z").select("entity", rnd("z_combined").alias("z_combined"), "k", "n_better")


@query("e29_multiplicity", with_(f"""
WITH p AS (SELECT entity, fold, {tail_sql('z')} AS p FROM ts), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p, fold) AS i, count(*) OVER (PARTITION BY entity) AS m FROM p),
f AS (SELECT *, p <= i * 0.1 / m AS row_ok FROM k)
SELECT entity, fold, {r('1 - pow(1 - p, m)', 4)} AS p_sidak, row_ok AS bh_row, coalesce(i <= max(CASE WHEN row_ok THEN i END) OVER (PARTITION BY entity), false) AS bh_step_up FROM f""", TSTAT).replace("\nWITH p AS", ",\np AS"))
def e29(t):
    d = I.normal_tail(tstats(t).select("entity", "fold", "z"), "z", "p")
    b = I.bh(d, "p", ["fold"], 0.1, ["entity"])
    return b.select("entity", "fold", rnd(I.sidak("p", F.col("m")), 4).alias("p_sidak"), "bh_row", "bh_step_up")


@query("e30_two_stage_least_squares", with_(f"""
WITH w AS (SELECT y - avg(y) OVER e AS y, x - avg(x) OVER e AS x, z - avg(z) OVER e AS z, entity FROM (SELECT entity, logp AS y, lv AS x, lv_lag AS z FROM reg) WHERE x IS NOT NULL AND z IS NOT NULL WINDOW e AS (PARTITION BY entity)),
m AS (SELECT sum(z * y) / sum(z * x) AS b, sum(z * x) / sum(z * z) AS p, sum(z * z) AS zz, count(*) AS n, count(DISTINCT entity) AS g FROM w),
f AS (SELECT sum(s * s) AS me FROM (SELECT sum(z * (x - p * z)) AS s FROM w, m GROUP BY entity))
SELECT n, {r('b', 4)} AS coef, {r('pow(p, 2) / (me * g / (g - 1.0) * (n - 1.0) / (n - 1 - g) / (zz * zz))', 3)} AS first_stage_f, pow(p, 2) / (me * g / (g - 1.0) * (n - 1.0) / (n - 1 - g) / (zz * zz)) < 10 AS weak FROM m, f""").replace("\nWITH w AS", ",\nw AS"))
def e30(t):
    d = E.iv_ols(reg(t), "logp", "lv", "lv_lag", fe=["entity"], cluster=["entity"])
    return d.select("n", rnd("coef", 4).alias("coef"), rnd("first_stage_f", 3).alias("first_stage_f"), "weak")


@query("e31_spatial_lag_iv", with_(f"""
WITH q AS (SELECT entity, ret_row AS y, (sum(ret_row) OVER g - coalesce(ret_row, 0)) / nullif(count(ret_row) OVER g - CAST(ret_row IS NOT NULL AS INT), 0) AS x,
   (sum(dl) OVER g - coalesce(dl, 0)) / nullif(count(dl) OVER g - CAST(dl IS NOT NULL AS INT), 0) AS z FROM (SELECT dev.*, region, lag(dev) OVER (PARTITION BY entity ORDER BY date) AS dl FROM dev JOIN dim USING (entity)) WINDOW g AS (PARTITION BY date, region)),
w AS (SELECT entity, y - avg(y) OVER e AS y, x - avg(x) OVER e AS x, z - avg(z) OVER e AS z FROM q WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL WINDOW e AS (PARTITION BY entity))
SELECT count(*) AS n, {r('sum(z * y) / sum(z * x)', 4)} AS coef FROM w""").replace("\nWITH q AS", ",\nq AS"))
def e31(t):
    d = t.dev.join(t.dim.select("entity", "region"), "entity").withColumn("dl", F.lag("dev").over(W.series()))
    d = J.peer_mean(J.peer_mean(d, ["date", "region"], "ret_row", "peer_ret"), ["date", "region"], "dl", "peer_dev")
    return E.iv_ols(d, "ret_row", "peer_ret", "peer_dev", fe=["entity"], cluster=["entity"]).select("n", rnd("coef", 4).alias("coef"))


@query("e32_morans_i", with_(f"""
WITH z AS (SELECT date, region, logp - avg(logp) OVER (PARTITION BY date) AS z FROM pr JOIN dim USING (entity)),
p AS (SELECT date, z, (sum(z) OVER g - z) / nullif(count(*) OVER g - 1, 0) AS p FROM z WINDOW g AS (PARTITION BY date, region))
SELECT date, count(*) AS n, {r('sum(z * p) / nullif(sum(z * z), 0)', 5)} AS moran FROM p WHERE p IS NOT NULL GROUP BY 1""").replace("\nWITH z AS", ",\nz AS"))
def e32(t):
    d = t.pr.join(t.dim.select("entity", "region"), "entity")
    return E.morans_i(d, "logp", "region").select("date", "n", rnd("moran", 5).alias("moran"))


@query("e32b_moran_permutation")
def e32b(t):
    d = t.prm.join(t.dim.select("entity", "region"), "entity")
    return E.morans_permutation(d, "logp", "region", draws=200)


@query("e33_interaction_date_effects", with_(f"""
WITH i AS (SELECT p.date, ret_row AS y, (population - (SELECT avg(population) FROM dim)) * CAST(ev_urgent AS DOUBLE) AS x FROM pr p JOIN dim USING (entity) JOIN calendar c ON c.date = p.date WHERE ret_row IS NOT NULL),
w AS (SELECT y - avg(y) OVER d AS y, x - avg(x) OVER d AS x FROM i WINDOW d AS (PARTITION BY date))
SELECT count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w""").replace("\nWITH i AS", ",\ni AS"))
def e33(t):
    dim = J.with_scalars(t.dim, t.dim.agg(F.avg("population").alias("m"))).select("entity", (F.col("population") - F.col("s.m")).alias("z"))
    d = t.pr.join(dim, "entity").join(t.calendar.select("date", "ev_urgent"), "date").withColumn("x", F.col("z") * F.col("ev_urgent"))
    return M.panel_ols(d, "ret_row", ["x"], fe=["date"], cluster=["date"]).select("n", rnd("coef", 5).alias("coef"))


@query("e34_vif", with_(f"SELECT unnest(['lv', 'k']) AS term, unnest([{r('1 / (1 - pow(corr(lv, k), 2))', 5)}, {r('1 / (1 - pow(corr(lv, k), 2))', 5)}]) AS vif FROM reg"))
def e34(t):
    return E.vif(reg(t), ["lv", "k"]).select("term", rnd("vif", 5).alias("vif"))


@query("e35_heteroskedasticity", with_(f"""
WITH b AS (SELECT regr_slope(logp, lv) AS b, regr_intercept(logp, lv) AS a FROM reg), u AS (SELECT lv, logp - a - b * lv AS u FROM reg, b),
m AS (SELECT count(*) AS n, avg(u) AS mu, stddev_pop(u) AS s FROM u)
SELECT max(n) AS n, {r('max(n) * (SELECT regr_r2(u * u, lv) FROM u)', 4)} AS breusch_pagan, {r('avg(pow((u - mu) / s, 3))', 5)} AS skew, {r('avg(pow((u - mu) / s, 4)) - 3', 5)} AS excess_kurtosis FROM u, m""").replace("\nWITH b AS", ",\nb AS"))
def e35(t):
    d = reg(t)
    b = d.agg(F.regr_slope("logp", "lv").alias("b"), F.regr_intercept("logp", "lv").alias("a"))
    u = J.with_scalars(d, b).select("lv", (F.col("logp") - F.col("s.a") - F.col("s.b") * F.col("lv")).alias("u"))
    return u.agg(F.count("*").alias("n"), rnd(F.count("*") * F.regr_r2(F.col("u") ** 2, "lv"), 4).alias("breusch_pagan"),
                 rnd(F.skewness("u"), 5).alias("skew"), rnd(F.kurtosis("u"), 5).alias("excess_kurtosis"))


@query("e36_sup_wald_break", with_(f"""
WITH mk AS (SELECT date, avg(ret_row) AS x FROM pr WHERE ret_row IS NOT NULL GROUP BY 1), s AS (SELECT date, x, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM mk),
c AS (SELECT date, i, n, count(*) OVER a AS n1, avg(x) OVER a AS m1, var_samp(x) OVER a AS v1, count(*) OVER b AS n2, avg(x) OVER b AS m2, var_samp(x) OVER b AS v2 FROM s
  WINDOW a AS (ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT {r('max(pow(m1 - m2, 2) / (v1 / n1 + v2 / n2))', 4)} AS sup_wald, arg_max(date, pow(m1 - m2, 2) / (v1 / n1 + v2 / n2)) AS break_after, max(n) AS n FROM c WHERE i >= floor(n * 0.15) AND i <= n - floor(n * 0.15)""").replace("\nWITH mk AS", ",\nmk AS"))
def e36(t):
    d = I.per_date_mean(t.pr, [], "date", "ret_row")
    return E.sup_wald(d, "ret_row", "date").select(rnd("sup_wald", 4).alias("sup_wald"), "break_after", "n")


@query("e37_joint_chi2", with_(f"""
WITH d AS (SELECT isodow(date) - 1 AS dow, avg(ret_row) AS m, stddev(ret_row) / sqrt(count(ret_row)) AS se FROM pr GROUP BY 1)
SELECT {r('sum(pow((m - (SELECT m FROM d WHERE dow = 0)) / sqrt(pow(se, 2) + pow((SELECT se FROM d WHERE dow = 0), 2)), 2))', 4)} AS chi2, count(*) AS df FROM d WHERE dow > 0""").replace("\nWITH d AS", ",\nd AS"))
def e37(t):
    g = t.pr.groupBy(F.weekday("date").alias("dow")).agg(F.avg("ret_row").alias("m"), (F.stddev("ret_row") / F.sqrt(F.count("ret_row"))).alias("se"))
    g = J.with_scalars(g.where("dow > 0"), g.where("dow = 0").select("m", "se"), "b")
    z = (F.col("m") - F.col("b.m")) / F.sqrt(F.col("se") ** 2 + F.col("b.se") ** 2)
    return g.agg(rnd(F.sum(z * z), 4).alias("chi2"), F.count("*").alias("df"))


@query("e38_rolling_reestimation", with_(f"""
WITH s AS (SELECT entity, date, dnext AS y, dev AS x, date - (SELECT min(date) FROM reg WHERE dnext IS NOT NULL AND reg.dev IS NOT NULL) AS day FROM reg WHERE dnext IS NOT NULL AND reg.dev IS NOT NULL),
k AS (SELECT w FROM (SELECT unnest(range(0, 100)) AS w) WHERE w * 30 + 179 <= (SELECT max(day) FROM s)),
j AS (SELECT w AS window_id, y - avg(y) OVER e AS y, x - avg(x) OVER e AS x FROM s JOIN k ON day BETWEEN w * 30 AND w * 30 + 179 WINDOW e AS (PARTITION BY w, entity))
SELECT CAST(window_id AS INTEGER) AS window_id, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM j GROUP BY 1""").replace("\nWITH s AS", ",\ns AS"))
def e38(t):
    d = reg(t).where("dnext is not null and dev is not null")
    return E.rolling_reestimation(d, "dnext", "dev", "entity", 180, 30).select("window_id", "n", rnd("coef", 5).alias("coef"))


REGIME = ("rg", """SELECT entity, date, dnext, dev, unnest(['all', CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END, CASE WHEN lv > ln(30) THEN 'busy' ELSE 'quiet' END,
   CASE WHEN date < DATE '1998-01-01' THEN 'early' ELSE 'late' END]) AS regime FROM reg WHERE dnext IS NOT NULL AND reg.dev IS NOT NULL""")


@query("e39_regime_splits", with_(f"""
WITH w AS (SELECT regime, dnext - avg(dnext) OVER e AS y, dev - avg(dev) OVER e AS x FROM rg WINDOW e AS (PARTITION BY regime, entity))
SELECT regime, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w GROUP BY 1""", REGIME).replace("\nWITH w AS", ",\nw AS"))
def e39(t):
    lab = F.array(F.lit("all"), F.when(F.weekday("date") >= 5, "weekend").otherwise("weekday"), F.when(F.col("lv") > F.log(F.lit(30.0)), "busy").otherwise("quiet"),
                  F.when(F.col("date") < "1998-01-01", "early").otherwise("late"))
    d = reg(t).withColumn("regime", F.explode(lab))
    return M.panel_ols(d, "dnext", ["dev"], fe=["entity"], by=["regime"]).select("regime", "n", rnd("coef", 5).alias("coef"))


@query("e40_horse_race", with_(f"""
WITH m AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM wd)
SELECT 'volume' AS spec, n, {r('ay * ay / aa / yy')} AS r2_within FROM m UNION ALL SELECT 'count', n, {r('by_ * by_ / bb / yy')} FROM m UNION ALL
SELECT 'both', n, {r('((bb * ay - ab * by_) * ay + (aa * by_ - ab * ay) * by_) / (aa * bb - ab * ab) / yy')} FROM m""", WITHIN).replace("\nWITH m AS", ",\nm AS"))
def e40(t):
    d = M.horse_race(reg(t), "logp", {"volume": ["lv"], "count": ["k"], "both": ["lv", "k"]}, fe=["entity"])
    return d.select("spec", "n", rnd("r2_within").alias("r2_within"))


CHANNELS = ("ch", """SELECT entity, channel, h, x, y FROM (SELECT entity, unnest(['flow', 'flow', 'stock', 'stock']) AS channel, unnest([1, 7, 1, 7]) AS h, unnest([lv, lv, ls, ls]) AS x, unnest([y1, y7, y1, y7]) AS y FROM
  (SELECT entity, ln(volume) AS lv, ln(sum(volume) OVER we) AS ls, lead(logp, 1) OVER we - logp AS y1, lead(logp, 7) OVER we - logp AS y7 FROM pr WINDOW we AS (PARTITION BY entity ORDER BY date))) WHERE y IS NOT NULL""")


@query("e41_elasticity_grid", with_(f"""
WITH w AS (SELECT channel, h, x - avg(x) OVER e AS x, y - avg(y) OVER e AS y FROM ch WINDOW e AS (PARTITION BY channel, h, entity))
SELECT channel, h, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w GROUP BY 1, 2""", CHANNELS).replace("\nWITH w AS", ",\nw AS"))
def e41(t):
    w = W.series()
    d = W.running_sum(t.pr, "volume", "stock")
    y = {h: F.lead("logp", h).over(w) - F.col("logp") for h in (1, 7)}
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(h).alias("h"), F.log(v).alias("x"), y[h].alias("y")) for c, v in (("flow", "volume"), ("stock", "stock")) for h in (1, 7)])
    d = d.select("entity", "date", cells.alias("cs")).select("entity", "date", F.explode("cs").alias("c")).select("entity", "date", "c.*")
    return M.panel_ols(d, "y", ["x"], fe=["entity"], cluster=["entity"], by=["channel", "h"]).select("channel", "h", "n", rnd("coef", 5).alias("coef"))


@query("e42_long_horizon_family")
def e42(t):
    """Measures x horizons with entity effects, step-up flags over the family and a Fama-MacBeth re-test."""
    w = W.series()
    d = W.running_sum(t.prm, "volume", "stock")
    lv = F.log("volume")
    measures = {"flow": lv, "cumulative": F.log("stock"), "acceleration": lv - 2 * F.lag(lv, 1).over(w) + F.lag(lv, 2).over(w),
                "threshold": (F.col("volume") > F.avg("volume").over(Window.partitionBy("entity"))).cast("double")}
    y = {h: F.lead("logp", h).over(w) - F.col("logp") for h in (1, 3, 6)}
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(h).alias("h"), x.alias("x"), y[h].alias("y")) for m, x in measures.items() for h in (1, 3, 6)])
    g = d.select("entity", "date", cells.alias("cs")).select("entity", "date", F.explode("cs").alias("c")).select("entity", "date", "c.*")
    est = M.panel_ols(g, "y", ["x"], fe=["entity"], cluster=["entity", "date"], by=["measure", "h"])
    est = I.bh(I.normal_tail(est, "t", "p"), "p", ["measure", "h"])
    sl = g.where("x is not null and y is not null").groupBy("measure", "h", "date").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("k")).where("k >= 8")
    fm = I.nw_mean(sl, "slope", "date", ["measure", "h"], "h").select("measure", "h", F.col("mean").alias("fm_mean"), F.col("t").alias("fm_t"))
    j = est.join(fm, ["measure", "h"], "left")
    return j.select("measure", "h", "n", "coef", "t", "p", "bh_step_up", "fm_mean", "fm_t", (F.signum("coef") != F.signum("fm_mean")).alias("sign_flip"))


STEPS = (1, 3, 6, 12)
_LONG = [(m, h) for m in ("flow", "cumulative", "acceleration", "threshold") for h in STEPS]
_CELLX = {"flow": "lv", "cumulative": "lstock", "acceleration": "accel", "threshold": "high"}
SPLIT = (("lh0", f"""SELECT entity, date, logp, ln(volume) AS lv, ln(sum(volume) OVER we) AS lstock, ln(volume) - 2 * lag(ln(volume)) OVER we + lag(ln(volume), 2) OVER we AS accel,
  CASE WHEN volume > avg(volume) OVER (PARTITION BY entity) THEN 1.0 ELSE 0.0 END AS high, {', '.join(f"lead(logp, {h}) OVER we - logp AS y{h}, lead(date, {h}) OVER we AS d{h}" for h in STEPS)} FROM prm WINDOW we AS (PARTITION BY entity ORDER BY date)"""),
         ("lhc", "SELECT dd[CAST(floor(n * 0.5) AS BIGINT) + 1] AS cut FROM (SELECT list(date ORDER BY date) AS dd, count(*) AS n FROM (SELECT DISTINCT date FROM prm))"),
         ("lh1", "SELECT entity, date, unnest([" + ", ".join(f"'{m}|{h}'" for m, h in _LONG) + "]) AS cell, unnest([" + ", ".join(_CELLX[m] for m, _ in _LONG) + "]) AS x, unnest([" + ", ".join(f"y{h}" for _, h in _LONG) + "]) AS y, unnest(["
          + ", ".join(f"d{h}" for _, h in _LONG) + "]) AS until FROM lh0"),
         ("lh2", "SELECT cell, entity, date, x, y, until < cut AS first_half FROM lh1, lhc WHERE x IS NOT NULL AND y IS NOT NULL AND (until < cut OR date >= cut)"),
         ("lh3", "SELECT cell, entity, x - avg(x) OVER e AS x, y - avg(y) OVER e AS y FROM lh2 WHERE first_half WINDOW e AS (PARTITION BY cell, entity)"),
         ("lh4", "SELECT cell, count(*) AS n, count(*) - 1 - count(DISTINCT entity) AS dof, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM lh3 GROUP BY 1"),
         ("lh5", "SELECT cell, n, xy / xx AS coef, xy / xx / sqrt((yy - xy * xy / xx) / dof / xx) AS t FROM lh4"),
         ("lh6", "SELECT cell, date, regr_slope(y, x) AS slope FROM lh2 WHERE NOT first_half GROUP BY 1, 2 HAVING count(*) >= 8 AND var_pop(x) > 0"),
         ("lh7", nw_sql("lh6", "slope", "date", "CAST(split_part(cell, '|', 2) AS INT)", "cell")),
         ("lh8", "SELECT cell, floor(date_diff('month', min(date), max(date)) / CAST(split_part(cell, '|', 2) AS INT)) AS windows FROM lh6 GROUP BY 1"),
         ("lh9", f"SELECT split_part(cell, '|', 1) AS measure, CAST(split_part(cell, '|', 2) AS INT) AS h, lh5.n, coef, t, {tail_sql('t')} AS p, mean AS slope, mean / nullif(se, 0) AS t_retest, windows FROM lh5 LEFT JOIN lh7 USING (cell) LEFT JOIN lh8 USING (cell)"),
         ("lhs", """SELECT *, CASE WHEN p >= 0.05 OR p IS NULL THEN 'not selected' WHEN windows < 3 OR windows IS NULL OR t_retest IS NULL THEN 'not estimable' WHEN sign(slope) <> sign(coef) THEN 'reversed'
  WHEN abs(t_retest) > 2 THEN 'survives' ELSE 'fades' END AS state FROM lh9"""))


def split_family(t):
    """Cells chosen on the first half of the dates, with targets that end in it, and tested again date by date on the second."""
    w = W.series()
    d = W.running_sum(t.prm, "volume", "stock")
    lv = F.log("volume")
    measures = {"flow": lv, "cumulative": F.log("stock"), "acceleration": lv - 2 * F.lag(lv, 1).over(w) + F.lag(lv, 2).over(w),
                "threshold": (F.col("volume") > F.avg("volume").over(Window.partitionBy("entity"))).cast("double")}
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(h).alias("h"), x.alias("x"), (F.lead("logp", h).over(w) - F.col("logp")).alias("y"), F.lead("date", h).over(w).alias("until"))
                      for m, x in measures.items() for h in STEPS])
    g = d.select("entity", "date", cells.alias("cs")).select("entity", "date", F.explode("cs").alias("c")).select("entity", "date", "c.*").where("x is not null and y is not null")
    g = J.with_scalars(g, V.cut_dates(t.prm, "date", cut=0.5), "s")
    est = M.panel_ols(g.where("until < s.cut").drop("s"), "y", ["x"], fe=["entity"], by=["measure", "h"])
    late = g.where("date >= s.cut").groupBy("measure", "h", "date").agg(F.count("*").alias("k"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("cxy"))
    late = late.where("k >= 8 and vx > 0").withColumn("slope", F.col("cxy") / F.col("vx"))
    fm = I.nw_mean(late, "slope", "date", ["measure", "h"], "h").select("measure", "h", F.col("mean").alias("slope"), F.col("t").alias("t_retest"))
    span = late.groupBy("measure", "h").agg(F.floor(F.months_between(F.max("date"), F.min("date")) / F.col("h")).alias("windows"))
    both = I.normal_tail(est, "t", "p").join(fm, ["measure", "h"], "left").join(span, ["measure", "h"], "left")
    return I.retest_states(both, "coef", "p", "slope", "t_retest", "windows")


@query("e42b_split_retest", with_(f"SELECT measure, h, n, {r('coef', 5)} AS coef, {r('t', 4)} AS t, {r('p', 4)} AS p, {r('slope', 5)} AS slope, {r('t_retest', 4)} AS t_retest, CAST(windows AS BIGINT) AS windows, state FROM lhs", *SPLIT))
def e42b(t):
    d = split_family(t)
    return d.select("measure", "h", "n", rnd("coef", 5).alias("coef"), rnd("t", 4).alias("t"), rnd("p", 4).alias("p"), rnd("slope", 5).alias("slope"), rnd("t_retest", 4).alias("t_retest"), F.col("windows").cast("long").alias("windows"), "state")


@query("e42c_retest_summary", with_("""SELECT measure, count(*) AS cells, count(*) FILTER (state <> 'not selected') AS selected, count(*) FILTER (state NOT IN ('not selected', 'not estimable')) AS estimable,
 count(*) FILTER (state = 'reversed') AS reversed, count(*) FILTER (state = 'survives') AS survive FROM lhs GROUP BY 1""", *SPLIT))
def e42c(t):
    """Of each measure's cells the selected, estimable, reversed and surviving ones."""
    return I.retest_summary(split_family(t), ["measure"])


@query("e43_exposure_grid", with_(f"""
WITH b AS (SELECT entity, logp, lead(logp) OVER we - logp AS y1, lead(logp, 3) OVER we - logp AS y3, lag(lv, 1) OVER we AS l1, lag(lv, 2) OVER we AS l2,
   CASE WHEN count(lv) OVER f >= 3 THEN avg(lv) OVER f END AS ma3 FROM (SELECT * FROM regm) WINDOW we AS (PARTITION BY entity ORDER BY date), f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
c AS (SELECT * FROM b WHERE y1 IS NOT NULL AND y3 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND ma3 IS NOT NULL),
g AS (SELECT entity, unnest(['lag1', 'lag2', 'ma3', 'lag1', 'lag2', 'ma3']) AS exposure, unnest([1, 1, 1, 3, 3, 3]) AS h, unnest([l1, l2, ma3, l1, l2, ma3]) AS x, unnest([y1, y1, y1, y3, y3, y3]) AS y FROM c),
w AS (SELECT exposure, h, x - avg(x) OVER e AS x, y - avg(y) OVER e AS y FROM g WINDOW e AS (PARTITION BY exposure, h, entity))
SELECT exposure, h, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w GROUP BY 1, 2""").replace("\nWITH b AS", ",\nb AS"))
def e43(t):
    from gridloom.operators.features import exposure_grid
    return exposure_grid(reg(t, "devm"), "logp", "lv", lags=[1, 2], windows=[3], horizons=[1, 3]).select("exposure", "h", "n", rnd("coef", 5).alias("coef"))


@query("e44_sensitivity_grid", with_(f"""
WITH c AS (SELECT entity, ret_row AS y, lv AS x, unnest(list_filter([1, 2, 3], lambda m: k >= m)) AS min_trades FROM reg WHERE ret_row IS NOT NULL),
w AS (SELECT min_trades, x - avg(x) OVER e AS x, y - avg(y) OVER e AS y FROM c WINDOW e AS (PARTITION BY min_trades, entity))
SELECT min_trades, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w GROUP BY 1""").replace("\nWITH c AS", ",\nc AS"))
def e44(t):
    d = reg(t).withColumn("min_trades", F.explode(F.expr("filter(array(1, 2, 3), m -> k >= m)")))
    return M.panel_ols(d, "ret_row", ["lv"], fe=["entity"], by=["min_trades"]).select("min_trades", "n", rnd("coef", 5).alias("coef"))


@query("e45_quantile_regression")
def e45(t):
    d = reg(t).where("dnext is not null and dev is not null")
    return E.quantile_regression(M.demean(d.select("entity", "dnext", "dev"), ["dnext", "dev"], ["entity"]), "dnext", "dev", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("e46_mann_whitney", with_(f"""
WITH s AS (SELECT price, isodow(date) >= 6 AS f, (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0) AS rk FROM panel),
g AS (SELECT sum(rk) FILTER (f) AS r1, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, count(*) AS n FROM s), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u FROM g),
ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM panel GROUP BY price))
SELECT n1 AS n_on, n2 AS n_off, {r('u', 1)} AS u, {r('(u - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1))))', 5)} AS z FROM u, ti""").replace("\nWITH s AS", ",\ns AS"))
def e46(t):
    return E.mann_whitney(t.panel.withColumn("f", F.weekday("date") >= 5), "f", "price").select("n_on", "n_off", rnd("u", 1).alias("u"), rnd("z", 5).alias("z"))


@query("e47_cross_section_specs", with_(f"""
WITH x AS (SELECT entity, avg(logp) AS y, ln(sum(volume)) AS s1, ln(sum(n)) AS s2, ln(max(volume)) AS s3 FROM pr GROUP BY 1),
g AS (SELECT unnest(['volume', 'trades', 'largest']) AS measure, y, unnest([s1, s2, s3]) AS s FROM x)
SELECT measure, count(*) AS n, {r('regr_slope(y, s)', 5)} AS coef, {r('regr_r2(y, s)', 5)} AS r2_within FROM g GROUP BY 1""").replace("\nWITH x AS", ",\nx AS"))
def e47(t):
    x = t.pr.groupBy("entity").agg(F.avg("logp").alias("y"), F.log(F.sum("volume")).alias("volume"), F.log(F.sum("n")).alias("trades"), F.log(F.max("volume")).alias("largest"))
    g = x.unpivot(["entity", "y"], ["volume", "trades", "largest"], "measure", "s")
    return rounded(M.panel_ols(g, "y", ["s"], by=["measure"]).where("term = 's'"), "coef", "r2_within", keep=("measure", "n"))


NESTED = (("nx", "SELECT entity, avg(logp) AS y, ln(sum(price * volume)) AS value, ln(sum(volume) / sum(n)) AS trade FROM pr GROUP BY 1"),
          ("ng", "SELECT unnest(['value', 'trade', 'people']) AS measure, y, mean_balance / 1000 AS bal, unnest([value, trade, ln(population)]) AS s FROM nx JOIN dim USING (entity) WHERE population > 0"),
          ("nm", "SELECT measure, count(*) AS n, var_pop(s) AS ss, var_pop(bal) AS bb, covar_pop(s, bal) AS sb, covar_pop(s, y) AS sy, covar_pop(bal, y) AS ty, var_pop(y) AS yy FROM ng GROUP BY 1"),
          ("ns", """SELECT measure, 'size' AS spec, n, 1 AS k, sy / ss AS coef, sy * sy / ss / yy AS r2 FROM nm
 UNION ALL SELECT measure, 'size, balance', n, 2, (bb * sy - sb * ty) / (ss * bb - sb * sb), ((bb * sy - sb * ty) * sy + (ss * ty - sb * sy) * ty) / (ss * bb - sb * sb) / yy FROM nm"""))


@query("e47b_cross_section_nested", with_(f"SELECT measure, spec, n, {r('coef', 5)} AS coef, {r('r2', 5)} AS r2, {r('1 - (1 - r2) * (n - 1) / (n - 1 - k)', 5)} AS r2_adjusted FROM ns", *NESTED))
def e47b(t):
    """Further size measures, alone and beside the mean balance: what the second regressor adds."""
    x = t.pr.groupBy("entity").agg(F.avg("logp").alias("y"), F.log(F.sum(F.col("price") * F.col("volume"))).alias("value"), F.log(F.sum("volume") / F.sum("n")).alias("trade"))
    x = J.enrich(x, t.dim.where("population > 0").select("entity", F.log("population").alias("people"), (F.col("mean_balance") / 1000).alias("bal")), ["entity"], "inner")
    g = x.unpivot(["entity", "y", "bal"], ["value", "trade", "people"], "measure", "s")
    # centred by the absorbed measure: moments about the means keep the digits that an intercept in the Gram matrix loses
    specs = [M.panel_ols(g, "y", xs, fe=["measure"], by=["measure"]).where("term = 's'").select("measure", F.lit(name).alias("spec"), "n", F.lit(len(xs)).alias("k"), "coef", F.col("r2_within").alias("r2"))
             for name, xs in (("size", ["s"]), ("size, balance", ["s", "bal"]))]
    d = specs[0].unionByName(specs[1]).withColumn("r2_adjusted", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 1 - F.col("k")))
    return rounded(d, "coef", "r2", "r2_adjusted", keep=("measure", "spec", "n"))


@query("e48_price_measures", with_(f"""
WITH m AS (SELECT s.entity, s.date, ln(volume) AS x, unnest(['sell', 'buy', 'book', 'mean']) AS measure, unnest([sell_price, buy_price, book_price, price]) AS p FROM sides s JOIN panel q ON s.entity = q.entity AND s.date = q.date),
w AS (SELECT measure, ln(p) - avg(ln(p)) OVER e AS y, x - avg(x) OVER e AS x FROM m WHERE p IS NOT NULL WINDOW e AS (PARTITION BY measure, entity))
SELECT measure, count(*) AS n, {r('sum(x * y) / sum(x * x)', 5)} AS coef FROM w GROUP BY 1""").replace("\nWITH m AS", ",\nm AS"))
def e48(t):
    d = t.sides.join(t.panel.select("entity", "date", F.col("price").alias("mean"), F.log("volume").alias("x")), ["entity", "date"])
    d = d.select("entity", "date", "x", F.col("sell_price").alias("sell"), F.col("buy_price").alias("buy"), F.col("book_price").alias("book"), "mean")
    d = d.unpivot(["entity", "date", "x"], ["sell", "buy", "book", "mean"], "measure", "p").withColumn("y", F.log("p"))
    return M.panel_ols(d, "y", ["x"], fe=["entity"], by=["measure"]).select("measure", "n", rnd("coef", 5).alias("coef"))


@query("e49_permutation_entropy", with_(f"""
WITH l AS (SELECT entity, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, value AS c FROM (SELECT category AS entity, hour_ts, value FROM hourly) WINDOW w AS (PARTITION BY entity ORDER BY hour_ts)),
p AS (SELECT entity, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS pat FROM l WHERE a IS NOT NULL),
k AS (SELECT entity, pat, count(*) AS c, sum(count(*)) OVER (PARTITION BY entity) AS n FROM p GROUP BY 1, 2)
SELECT entity, CAST(max(n) AS BIGINT) AS n, {r('-sum(c / n * ln(c / n)) / ln(6)')} AS entropy FROM k GROUP BY 1""").replace("\nWITH l AS", ",\nl AS"))
def e49(t):
    d = t.hourly.select(F.col("category").alias("entity"), F.col("hour_ts").alias("date"), "value")
    return E.permutation_entropy(d, "value", 3).select("entity", "n", rnd("entropy").alias("entropy"))


@query("e50_sample_entropy", with_(f"""
WITH t AS (SELECT entity, ret_row, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS n, avg(ret_row) OVER (PARTITION BY entity) AS m, stddev_pop(ret_row) OVER (PARTITION BY entity) AS s FROM prm WHERE ret_row IS NOT NULL),
z AS (SELECT entity, i, n, (ret_row - m) / nullif(s, 0) AS z FROM t),
e AS (SELECT a.entity, a.i, a.n, a.z AS z0, b.z AS z1, c.z AS z2 FROM z a LEFT JOIN z b ON a.entity = b.entity AND b.i = a.i + 1 LEFT JOIN z c ON c.entity = a.entity AND c.i = a.i + 2),
p AS (SELECT x.entity, max(x.n) AS n, count(*) FILTER (greatest(abs(x.z0 - y.z0), abs(x.z1 - y.z1)) <= 0.2) AS b,
   count(*) FILTER (greatest(abs(x.z0 - y.z0), abs(x.z1 - y.z1), abs(x.z2 - y.z2)) <= 0.2) AS a FROM e x LEFT JOIN e y ON x.entity = y.entity AND x.i <> y.i AND x.i <= x.n - 2 AND y.i <= y.n - 2 GROUP BY 1)
SELECT CAST(entity AS BIGINT) AS entity, n, b AS pairs_m, a AS pairs_m1, {r('CASE WHEN a > 0 AND b > 0 THEN -ln(CAST(a AS DOUBLE) / b) END')} AS sampen FROM p""").replace("\nWITH t AS", ",\nt AS"))
def e50(t):
    return E.sample_entropy(t.prm, "ret_row").select(F.col("entity").cast("long").alias("entity"), "n", "pairs_m", "pairs_m1", rnd("sampen").alias("sampen"))


def _lag_sql(lags: int = 90, degree: int = 3, leads: int = 7, horizons=(7, 14, 30, 60, 90)) -> str:
    """Least squares by successive orthogonalisation in SQL; errors of a combination b from w = X (X'X)^-1 b."""
    from gridloom.operators.lagged import basis

    grid = basis(lags, degree)
    k = degree + 1 + 2
    mix = lambda name, first, ws: " + ".join(f"{name}{first + i} * {float(v)!r}" for i, v in enumerate(ws))
    zs = [mix("x", 0, grid[:, p]) for p in range(degree + 1)] + [mix("f", 1, [1 / leads] * leads), mix("f", 1, [i - (leads + 1) / 2 for i in range(1, leads + 1)])]
    ctes = [("dl0", f"SELECT entity, ret_row AS y, {', '.join(f'lag(lv, {i}) OVER we AS x{i}' for i in range(lags + 1))}, {', '.join(f'lead(lv, {i}) OVER we AS f{i}' for i in range(1, leads + 1))} FROM (SELECT *, ln(volume) AS lv FROM pr) WINDOW we AS (PARTITION BY entity ORDER BY date)"),
            ("dl1", f"SELECT entity, y, {', '.join(f'{z} AS z{j}' for j, z in enumerate(zs))} FROM dl0 WHERE y IS NOT NULL AND x{lags} IS NOT NULL AND f{leads} IS NOT NULL"),
            ("dl2", f"SELECT entity, y - avg(y) OVER e AS y, {', '.join(f'z{j} - avg(z{j}) OVER e AS q{j}' for j in range(k))} FROM dl1 WINDOW e AS (PARTITION BY entity)")]
    # step j: q_j is final; take it out of the later ones, keeping the ratios r_j_i
    for j in range(k):
        later = range(j + 1, k)
        ctes += [(f"rj{j}", f"SELECT sum(q{j} * q{j}) AS d, sum(q{j} * y) / sum(q{j} * q{j}) AS g{''.join(f', sum(q{j} * q{i}) / sum(q{j} * q{j}) AS r{i}' for i in later)} FROM dl{2 + j}"),
                 (f"dl{3 + j}", f"SELECT entity, y, {', '.join([f'q{i}' for i in range(j + 1)] + [f'q{i} - rj{j}.r{i} * q{j} AS q{i}' for i in later])} FROM dl{2 + j}, rj{j}")]
    last = f"dl{2 + k}"
    ctes.append(("dlu", f"SELECT entity, y - {' - '.join(f'rj{j}.g * q{j}' for j in range(k))} AS u, {', '.join(f'q{j}' for j in range(k))} FROM {last}, {', '.join(f'rj{j}' for j in range(k))}"))
    ctes.append(("dls", f"SELECT entity, {', '.join(f'sum(q{j} * u) AS s{j}' for j in range(k))}, count(*) AS n FROM dlu GROUP BY 1"))
    theta = {}
    for j in range(k - 1, -1, -1):
        theta[j] = f"rj{j}.g" + "".join(f" - rj{j}.r{i} * t{i}" for i in range(j + 1, k))
    froms = ", ".join(f"rj{j}" for j in range(k))
    step = f"(SELECT {theta[k - 1]} AS t{k - 1} FROM {froms})"
    for j in range(k - 2, -1, -1):
        step = f"(SELECT p.*, {theta[j]} AS t{j} FROM {step} p, rj{j})"
    ctes.append(("dlt", f"SELECT * FROM {step}"))
    combos = [(kind, h, [float(x) for x in g]) for kind, h, g in [("beta", i, grid[i]) for i in range(lags + 1)] + [("cumulative", h, grid[: h + 1].sum(axis=0)) for h in horizons]]
    rows = ", ".join(f"('{kind}', {h}, {', '.join(repr(x) for x in g)}, 0.0, 0.0)" for kind, h, g in combos)
    cols = ", ".join(f"b{j}" for j in range(k))
    ctes.append(("dlb", f"SELECT * FROM (VALUES {rows}) v(kind, k, {cols})"))
    step = "(SELECT kind, k, " + cols + ", b0 AS c0 FROM dlb)"
    for j in range(1, k):
        step = f"(SELECT p.*, b{j}{''.join(f' - rj{i}.r{j} * c{i}' for i in range(j))} AS c{j} FROM {step} p, {', '.join(f'rj{i}' for i in range(j))})"
    ctes.append(("dlc", f"SELECT kind, k, {cols}, {', '.join(f'c{j} / rj{j}.d AS c{j}' for j in range(k))} FROM {step} p, {froms}"))
    inf = " + ".join(f"c{j} * s{j}" for j in range(k))
    est = " + ".join(f"b{j} * t{j}" for j in range(degree + 1))
    body = f"""SELECT kind, CAST(k AS BIGINT) AS k, {r('any_value(est)', 7)} AS estimate, {r('sqrt(sum(pow(inf, 2)) * count(*) / (count(*) - 1))', 7)} AS se, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT kind, k, n, {est} AS est, {inf} AS inf FROM dlc, dls, dlt) GROUP BY 1, 2"""
    return with_(body, *ctes)


@query("e51_distributed_lag", _lag_sql())
def e51(t):
    """Response of returns to log volume over the lags 0 to 90: curve and cumulative response with clustered errors."""
    d = LG.distributed_lag(t.pr.withColumn("lv", F.log("volume")), "ret_row", "lv")
    return d.where("kind in ('beta', 'cumulative')").select("kind", "k", rnd("estimate", 7).alias("estimate"), rnd("se", 7).alias("se"), "n")


@query("e51b_absorption")
def e51b(t):
    """Share absorbed by horizon with delta-method errors, the half time where identified, the placebo leads."""
    return LG.distributed_lag(t.pr.withColumn("lv", F.log("volume")), "ret_row", "lv").where("kind not in ('beta', 'cumulative')")


@query("e52_cumulative_level", with_(f"SELECT count(*) AS n, {r('sum(x * y) / sum(x * x)', 4)} AS coef FROM tw",
    ("lvl", "SELECT entity, date, logp AS y, ln(sum(volume) OVER (PARTITION BY entity ORDER BY date)) AS x FROM prm"), *two_way_sql("lvl", ["y", "x"])))
def e52(t):
    d = W.running_sum(t.prm, "volume", "stock").withColumn("ls", F.log("stock"))
    return M.panel_ols(d, "logp", ["ls"], fe=["entity", "date"], cluster=["entity", "date"]).select("n", rnd("coef", 4).alias("coef"))


# ------------------------------------------------------------------ pairs


@query("j13_pairwise_gaps", with_(f"""
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM prm)), v AS (SELECT entity, i, nd, logp FROM prm JOIN d USING (date)),
g AS (SELECT a.entity AS a, b.entity AS b, a.i, a.nd, a.logp - b.logp AS gap FROM v a JOIN v b ON a.i = b.i AND a.entity < b.entity),
p AS (SELECT g.a, g.b, g.i, g.nd, l.gap AS x, f.gap - g.gap AS y FROM g JOIN g l ON l.a = g.a AND l.b = g.b AND l.i = g.i - 1 JOIN g f ON f.a = g.a AND f.b = g.b AND f.i = g.i + 1),
m AS (SELECT a, b, regr_slope(y, x) FILTER (i <= floor(nd * 0.6)) AS s, regr_intercept(y, x) FILTER (i <= floor(nd * 0.6)) AS c, count(*) FILTER (i <= floor(nd * 0.6)) AS ntr FROM p GROUP BY 1, 2),
t AS (SELECT p.a, p.b, max(s) AS s, 1 - sum(pow(c + s * x - y, 2)) / sum(y * y) AS r2, count(*) AS n_test FROM p JOIN m ON p.a = m.a AND p.b = m.b WHERE i > floor(nd * 0.6) AND ntr >= 30 GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT CAST(t.a AS BIGINT) AS a, CAST(t.b AS BIGINT) AS b, {r('t.s', 5)} AS slope, {r('t.r2', 5)} AS r2_oos, {r('q.m', 5)} AS mean_abs_gap, n_test FROM t JOIN (SELECT a, b, avg(abs(gap)) AS m FROM g GROUP BY 1, 2) q ON t.a = q.a AND t.b = q.b""").replace("\nWITH d AS", ",\nd AS"))
def j13(t):
    d = P.pair_gaps(t.prm, "entity", "date", "logp")
    return d.select("a", "b", rnd("slope", 5).alias("slope"), rnd("r2_oos", 5).alias("r2_oos"), rnd("mean_abs_gap", 5).alias("mean_abs_gap"), "n_test")


@query("a20_mean_pairwise_corr", with_(f"""
SELECT {r('avg(c)', 5)} AS mean_corr, count(*) AS pairs FROM (SELECT a.entity, b.entity, corr(a.ret_row, b.ret_row) AS c FROM pr a JOIN pr b ON a.date = b.date AND a.entity < b.entity WHERE a.ret_row IS NOT NULL AND b.ret_row IS NOT NULL GROUP BY 1, 2)"""))
def a20(t):
    d = P.off_diagonal_mean(P.pair_correlations(t.pr, "entity", "date", "ret_row"))
    return d.select(rnd("mean_corr", 5).alias("mean_corr"), "pairs")
