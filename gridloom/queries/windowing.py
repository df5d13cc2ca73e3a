"""Window functions over entity series and cross-sections."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions.num import div, log_floor, rnd
from gridloom.operators import joins as J, windows as W
from gridloom.registry import query
from gridloom.session import materialise
from gridloom.sqltext import define, r, with_

WE = "WINDOW we AS (PARTITION BY entity ORDER BY date)"


@query("w1_lag_lead_diff", with_(f"""
SELECT entity, date, {r("lag(price) OVER we", 4)} AS lag1, {r("lead(price, 2) OVER we", 4)} AS lead2, {r("logp - lag(logp) OVER we")} AS diff FROM pr {WE}"""))
def w1(t):
    w = W.series()
    return t.pr.select("entity", "date", rnd(F.lag("price").over(w), 4).alias("lag1"), rnd(F.lead("price", 2).over(w), 4).alias("lead2"),
                       rnd(F.col("logp") - F.lag("logp").over(w)).alias("diff"))


@query("w2_gap_checked_return", with_(f"SELECT entity, date, gap AS gap_days, {r('ret')} AS ret FROM pr"))
def w2(t):
    return W.gap_checked_return(t.panel, "price").select("entity", "date", "gap_days", rnd("ret").alias("ret"))


define("med15", """SELECT entity, date, price, CASE WHEN count(price) OVER f >= 5 THEN quantile_cont(price, 0.5) OVER f END AS med FROM panel
  WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
define("mad15", """SELECT *, abs(price - med) AS ad, CASE WHEN count(abs(price - med)) OVER f >= 5 THEN quantile_cont(abs(price - med), 0.5) OVER f END AS mad FROM med15
  WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")


@query("w3_centred_rolling_median", with_(f"SELECT entity, date, {r('med', 4)} AS med FROM med15"))
def w3(t):
    return t.panel.select("entity", "date", rnd(W.rolling_median("price", 15, 5), 4).alias("med"))


@query("w4_mad_outlier_scrub", with_(f"""
SELECT entity, date, {r('mad', 4)} AS mad, coalesce(ad > greatest(2.5 * mad, 0.12 * med), false) AS is_outlier,
 {r("CASE WHEN NOT coalesce(ad > greatest(2.5 * mad, 0.12 * med), false) THEN price END", 4)} AS price_clean FROM mad15"""))
def w4(t):
    return W.mad_scrub(t.panel, "price", k=2.5).select("entity", "date", rnd("mad", 4).alias("mad"), "is_outlier", rnd("price_clean", 4).alias("price_clean"))


@query("w5_rolling_min_periods", with_(f"""
SELECT entity, date, {r("CASE WHEN count(ret_row) OVER f >= 7 THEN avg(ret_row) OVER f END")} AS mean14, {r("CASE WHEN count(ret_row) OVER f >= 7 THEN stddev(ret_row) OVER f END")} AS sd14,
 {r("CASE WHEN count(ret_row) OVER f >= 7 THEN sum(ret_row) OVER f END")} AS sum14, {r("CASE WHEN count(ret_row) OVER f >= 7 THEN skewness(ret_row) OVER f END", 4)} AS skew14
FROM pr WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 13 PRECEDING)"""))
def w5(t):
    return t.pr.select("entity", "date", *[rnd(W.rolling("ret_row", 14, h), 4 if h == "skew" else 6).alias(f"{h}14") for h in ("mean", "sd", "sum", "skew")])


@query("w6_lagged_rolling", with_(f"""
SELECT entity, date, {r("CASE WHEN count(logp) OVER f >= 10 THEN avg(logp) OVER f END")} AS lag_mean10, {r("CASE WHEN count(logp) OVER f >= 10 THEN stddev(logp) OVER f END")} AS lag_sd10
FROM pr WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def w6(t):
    return t.pr.select("entity", "date", rnd(W.rolling("logp", 10, "mean", min_obs=10, lag=1)).alias("lag_mean10"),
                       rnd(W.rolling("logp", 10, "sd", min_obs=10, lag=1)).alias("lag_sd10"))


EWMA_SQL = """SELECT a.entity, a.date, count(b.ret) AS n, sum(pow(0.5, (a.i - b.i) / 3.0)) AS w, sum(pow(0.5, (a.i - b.i) / 3.0 * 2)) AS w2,
  sum(pow(0.5, (a.i - b.i) / 3.0) * b.ret) AS x, sum(pow(0.5, (a.i - b.i) / 3.0) * b.ret * b.ret) AS xx
 FROM ix a JOIN ix b ON a.entity = b.entity AND b.i <= a.i AND b.ret IS NOT NULL GROUP BY 1, 2"""


@query("w7_ewma_mean_sd", with_(f"""
SELECT ix.entity, ix.date, {r("CASE WHEN n >= 3 THEN x / w END")} AS ew_mean,
 {r("CASE WHEN n >= 3 THEN sqrt(greatest((xx / w - (x / w) * (x / w)) * w * w / (w * w - w2), 0)) END")} AS ew_sd
FROM ix LEFT JOIN ew USING (entity, date)""",
    ("ix", "SELECT entity, date, ret, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM prm"), ("ew", EWMA_SQL)))
def w7(t):
    d = t.prm.select("entity", "date", "ret")
    return W.ewma(d, "ret", 3.0, "ew_mean", "ew_sd").select("entity", "date", rnd("ew_mean").alias("ew_mean"), rnd("ew_sd").alias("ew_sd"))


@query("w8_running_stock", with_(f"""
SELECT entity, date, {r("sum(volume) OVER we", 2)} AS stock, count(*) OVER we AS days_seen FROM panel {WE}"""))
def w8(t):
    d = W.running_sum(t.panel, "volume", "stock")
    return d.select("entity", "date", rnd("stock", 2).alias("stock"),
                    F.count("*").over(W.series().rowsBetween(Window.unboundedPreceding, 0)).alias("days_seen"))


@query("w9_drawdown", with_(f"""
SELECT entity, {r("min(dd)")} AS max_drawdown, arg_min(date, (round(dd * 1e9), date)) AS trough FROM
 (SELECT entity, date, price / max(price) OVER we - 1 AS dd FROM panel_m {WE}) GROUP BY 1"""))
def w9(t):
    d = W.drawdown(t.panel_m, "price")
    return d.groupBy("entity").agg(rnd(F.min("drawdown")).alias("max_drawdown"),
                                   F.min_by("date", F.struct(F.round(F.col("drawdown") * 1e9), "date")).alias("trough"))


@query("w10_cross_deviation", with_(f"SELECT entity, date, {r('dev')} AS dev FROM dev"))
def w10(t):
    return W.cross_deviation(t.pr, "logp").select("entity", "date", rnd("dev").alias("dev"))


@query("w11_cross_section_ranks", with_(f"""
SELECT entity, date, {r("(logp - avg(logp) OVER d) / nullif(stddev(logp) OVER d, 0)")} AS z, {r("logp - quantile_cont(logp, 0.5) OVER d")} AS from_median,
 {r("(rank() OVER (PARTITION BY date ORDER BY logp) + (count(*) OVER (PARTITION BY date, logp) - 1) / 2.0) / count(*) OVER d")} AS rank_pct
FROM pr WINDOW d AS (PARTITION BY date)"""))
def w11(t):
    x = W.cross_section(materialise(t.pr, "panel"), "logp", ["date"])
    return x.select("entity", "date", rnd("z").alias("z"), rnd("from_median").alias("from_median"), rnd("rank_pct").alias("rank_pct"))


@query("w12_within_entity_rank", with_(f"""
SELECT entity, date, {r("(rank() OVER (PARTITION BY entity ORDER BY volume) + (count(*) OVER (PARTITION BY entity, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY entity)")} AS rank_pct FROM panel"""))
def w12(t):
    return W.cross_rank_pct(t.panel, "volume", ["entity"], "rk").select("entity", "date", rnd("rk").alias("rank_pct"))


@query("w13_first_value", with_(f"""
SELECT entity, date, {r("dev - first_value(dev) OVER (PARTITION BY entity ORDER BY date)")} AS from_first FROM dev WHERE dev.dev IS NOT NULL"""))
def w13(t):
    d = t.dev.where("dev is not null")
    f = F.first("dev").over(W.series().rowsBetween(Window.unboundedPreceding, 0))
    return d.select("entity", "date", rnd(F.col("dev") - f).alias("from_first"))


@query("w14_sessions", with_(f"""
SELECT entity, episode, min(date) AS start_date, max(date) AS end_date, count(*) AS days, {r("avg(abs(dev))")} AS mean_dev FROM
 (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY date) AS BIGINT) AS episode FROM
  (SELECT entity, date, dev, date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS g FROM dev WHERE abs(dev.dev) > 0.1)) GROUP BY 1, 2"""))
def w14(t):
    d = W.sessions(t.dev.where("abs(dev) > 0.1").select("entity", "date", "dev"), 7)
    return d.groupBy("entity", "episode").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                                              F.count("*").alias("days"), rnd(F.avg(F.abs("dev"))).alias("mean_dev"))


@query("w15_bounded_fill", with_(f"""
WITH f AS (SELECT entity, date, price, last_value(price IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER a AS pd,
  first_value(price IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER b AS nd FROM sp
  WINDOW a AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, date, {r("CASE WHEN date - pd <= 2 THEN pv END", 4)} AS ffilled,
 {r("CASE WHEN date - pd <= 2 AND nv IS NOT NULL THEN CASE WHEN nd = pd THEN pv ELSE pv + (nv - pv) * (date - pd) / (nd - pd) END END", 4)} AS interpolated FROM f""",
    ("sp", """SELECT g.entity, g.date, price FROM (SELECT entity, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel GROUP BY entity) g
      LEFT JOIN panel p ON p.entity = g.entity AND p.date = g.date""")).replace("\nWITH f AS", ",\nf AS"))
def w15(t):
    p = t.panel.select("entity", "date", "price")
    d = J.date_spine(p, "entity", "date").join(p, ["entity", "date"], "left")
    d = W.bounded_fill(d, "price", "ffilled", 2)
    d = W.bounded_fill(d, "price", "interpolated", 2, "linear")
    return d.select("entity", "date", rnd("ffilled", 4).alias("ffilled"), rnd("interpolated", 4).alias("interpolated"))


@query("w16_window_growth", with_(f"""
SELECT entity, date, {r("ln(greatest(volume, 1)) - CASE WHEN lag(volume, 7) OVER we IS NOT NULL THEN ln(greatest(lag(volume, 7) OVER we, 1)) END")} AS g7, {r("ln(greatest(volume, 1)) - CASE WHEN lag(volume, 30) OVER we IS NOT NULL THEN ln(greatest(lag(volume, 30) OVER we, 1)) END")} AS g30 FROM panel {WE}"""))
def w16(t):
    w = W.series()
    return t.panel.select("entity", "date", *[rnd(log_floor("volume") - F.when(F.lag("volume", k).over(w).isNotNull(), log_floor(F.lag("volume", k).over(w)))).alias(f"g{k}") for k in (7, 30)])


@query("w17_windowed_acceleration", with_(f"""
SELECT entity, date, {r("lr - lag(lr, 7) OVER we")} AS accel FROM (SELECT entity, date, CASE WHEN count(*) OVER f >= 7 THEN ln(sum(volume) OVER f) END AS lr FROM panel
 WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 13 PRECEDING)) {WE}"""))
def w17(t):
    d = t.panel.select("entity", "date", F.log(W.rolling("volume", 14, "sum")).alias("lr"))
    return d.select("entity", "date", rnd(F.col("lr") - F.lag("lr", 7).over(W.series())).alias("accel"))


@query("w18_forward_volatility", with_(f"""
SELECT entity, date, {r("CASE WHEN count(ret_row) OVER f >= 5 THEN stddev(ret_row) OVER f * sqrt(365) END")} AS y_vol7 FROM pr
WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"""))
def w18(t):
    f = W.series().rowsBetween(1, 7)
    return t.pr.select("entity", "date", rnd(W.guarded(F.stddev("ret_row").over(f), F.count("ret_row").over(f), 5) * F.sqrt(F.lit(365.0))).alias("y_vol7"))


INDEX_SQL = (
    ("days", "SELECT date, count(*) AS n_entities, avg(logp) AS basket_log, stddev(logp) AS disp, lag(date) OVER (ORDER BY date) AS pd FROM pr GROUP BY date"),
    ("step", "SELECT date, logp - lag(logp) OVER we AS d, lag(date) OVER we AS op, logp, volume FROM pr WINDOW we AS (PARTITION BY entity ORDER BY date)"),
    ("agg", """SELECT s.date, avg(d) FILTER (op = pd) AS chain_ret, count(d) FILTER (op = pd) AS n_pairs, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) FILTER (d IS NOT NULL) AS BIGINT) AS n_up,
        sum(logp * volume) / sum(volume) AS vw_log FROM step s JOIN days USING (date) GROUP BY 1"""),
    ("fst", "SELECT min(date) AS d0 FROM days WHERE n_entities >= 10"),
    ("idx", """SELECT days.date, n_entities, n_pairs, n_up, basket_log, vw_log, chain_ret, CASE WHEN n_entities >= 10 THEN disp END AS disp, n_entities >= 10 AS index_valid,
        CASE WHEN days.date >= d0 THEN (SELECT basket_log FROM days, fst WHERE date = d0) + sum(CASE WHEN days.date > d0 THEN coalesce(chain_ret, 0) ELSE 0 END) OVER (ORDER BY days.date) END AS chain_log
        FROM days JOIN agg USING (date), fst"""))


@query("w19_chain_linked_index", with_(f"""
SELECT date, n_entities, n_pairs, n_up, {r("basket_log")} AS basket_log, {r("vw_log")} AS vw_log, {r("chain_ret")} AS chain_ret, {r("chain_log")} AS chain_log,
 {r("disp")} AS disp, index_valid FROM idx""", *INDEX_SQL))
def w19(t):
    d = W.chain_index(t.pr, "logp", 10, "volume")
    return d.select("date", "n_entities", "n_pairs", "n_up", *[rnd(c).alias(c) for c in ("basket_log", "vw_log", "chain_ret", "chain_log", "disp")],
                    "index_valid")


def _full(x, n):
    return f"CASE WHEN count({x}) OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING) >= {n} THEN avg({x}) OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING) END"


TECH = (("dd", "SELECT *, price - lag(price) OVER (PARTITION BY entity ORDER BY date) AS d FROM panel"),
        ("ud", "SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM dd"),
        ("tech", f"""SELECT entity, date, price, {_full('price', 50)} AS ma50, {_full('price', 200)} AS ma200, {_full('up', 14)} AS up14, {_full('dn', 14)} AS dn14, {_full('price', 20)} AS m20,
          CASE WHEN count(*) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) >= 20 THEN stddev(price) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) END AS sd20 FROM ud"""))


@query("w20_technicals", with_(f"""
SELECT entity, date, {r("ma50", 4)} AS ma50, {r("ma200", 4)} AS ma200, {r("CASE WHEN dn14 > 0 THEN 100 - 100 / (1 + up14 / dn14) END", 4)} AS rsi14,
 {r("CASE WHEN sd20 > 0 THEN (price - m20) / sd20 END", 5)} AS bb_z, price > ma50 AS above_ma50, ma50 > ma200 AS golden_cross FROM tech""", *TECH))
def w20(t):
    d = W.technicals(t.panel, "price")
    return d.select("entity", "date", rnd("ma50", 4).alias("ma50"), rnd("ma200", 4).alias("ma200"), rnd("rsi14", 4).alias("rsi14"), rnd("bb_z", 5).alias("bb_z"),
                    (F.col("price") > F.col("ma50")).alias("above_ma50"), (F.col("ma50") > F.col("ma200")).alias("golden_cross"))


@query("w21_single_shift", with_(f"""
SELECT entity, date, {r("lag(logp) OVER we")} AS logp, {r("lag(volume) OVER we")} AS volume, {r("lag(ret_row) OVER we")} AS ret_row, isodow(date) - 1 AS dow FROM pr {WE}"""))
def w21(t):
    from gridloom.operators.features import shift_features
    d = t.pr.select("entity", "date", "logp", "volume", "ret_row", F.weekday("date").cast("long").alias("dow"))
    s = shift_features(d, ["logp", "volume", "ret_row"])
    return s.select("entity", "date", rnd("logp").alias("logp"), rnd("volume").alias("volume"), rnd("ret_row").alias("ret_row"), "dow")


@query("w22_leakage_assertion", with_(f"""
SELECT feature, {r("c")} AS corr, abs(c) < 0.25 AS ok FROM (
 SELECT 'lag_ret' AS feature, corr(l1, y) AS c FROM f UNION ALL SELECT 'lag_logp', corr(l2, y) FROM f UNION ALL SELECT 'lag_volume', corr(l3, y) FROM f UNION ALL SELECT 'logp', corr(logp, y) FROM f)""",
    ("f", f"SELECT logp, lag(ret_row) OVER we AS l1, lag(logp) OVER we AS l2, lag(volume) OVER we AS l3, lead(logp) OVER we - logp AS y FROM pr {WE}")))
def w22(t):
    from gridloom.operators.features import leakage
    w = W.series()
    d = t.pr.select("logp", F.lag("ret_row").over(w).alias("lag_ret"), F.lag("logp").over(w).alias("lag_logp"), F.lag("volume").over(w).alias("lag_volume"),
                    (F.lead("logp").over(w) - F.col("logp")).alias("y"))
    return leakage(d, ["lag_ret", "lag_logp", "lag_volume", "logp"], "y").select("feature", rnd("corr").alias("corr"), "ok")


@query("w23_monotone_check", with_("""
SELECT entity, count(*) FILTER (stock < prev) AS violations FROM (SELECT entity, stock, lag(stock) OVER (PARTITION BY entity ORDER BY date) AS prev FROM
 (SELECT entity, date, sum(volume) OVER (PARTITION BY entity ORDER BY date) AS stock FROM panel)) GROUP BY 1"""))
def w23(t):
    from gridloom.operators.quality import monotone_violations
    return monotone_violations(W.running_sum(t.panel, "volume", "stock"), "stock")
