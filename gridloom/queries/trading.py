"""Order book, strategy studies and scenarios."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions.num import div, rnd
from gridloom.operators import book as B, evaluation as V, joins as J, quantiles as Q, scenarios as N, strategy as G, windows as W
from gridloom.queries.aggregates import qbin_sql
from gridloom.queries.econometric import nw_sql
from gridloom.registry import query
from gridloom.session import materialise
from gridloom.sqltext import define, r, with_

define("offers", "SELECT *, 0.02 * value AS fee_uncapped, least(greatest(0.02 * value, 2000.0), 8000.0) AS fee, least(greatest(0.02 * value, 2000.0), 8000.0) / value * 100 AS eff FROM book")


@query("b1_book_offers", with_(f"SELECT offer_id, entity, side, amount, {r('price', 4)} AS price, {r('value', 2)} AS value, {r('fee', 4)} AS fee, {r('eff')} AS eff_rate_pct FROM offers"))
def b1(t):
    return B.with_fees(t.book).select("offer_id", "entity", "side", "amount", rnd("price", 4).alias("price"), rnd("value", 2).alias("value"),
                                      rnd("fee", 4).alias("fee"), rnd("eff_rate_pct").alias("eff_rate_pct"))


@query("b2_book_summary", with_(f"""
SELECT entity, count(*) FILTER (side = 'sell') AS n_sellers, count(*) FILTER (side = 'buy') AS n_buyers, {r("min(price) FILTER (side = 'sell')", 4)} AS best_ask,
 {r("max(price) FILTER (side = 'buy')", 4)} AS best_bid, CAST(sum(amount) FILTER (side = 'sell') AS BIGINT) AS sell_depth, CAST(sum(amount) FILTER (side = 'buy') AS BIGINT) AS buy_depth,
 {r("avg(CAST(name = 'HOUSEHOLD' AS INT)) FILTER (side = 'sell')")} AS anon_sell, count(*) FILTER (side = 'buy' AND price < 1000) AS buyers_below,
 CAST(coalesce(sum(amount) FILTER (side = 'buy' AND price < 1000), 0) AS BIGINT) AS depth_below,
 {r("(min(price) FILTER (side = 'sell') - max(price) FILTER (side = 'buy')) / ((min(price) FILTER (side = 'sell') + max(price) FILTER (side = 'buy')) / 2) * 100", 5)} AS spread_pct,
 {r("CAST(sum(amount) FILTER (side = 'buy') AS DOUBLE) / sum(amount) FILTER (side = 'sell')")} AS depth_ratio FROM book GROUP BY 1"""))
def b2(t):
    d = B.book_summary(t.book, 1000.0, "HOUSEHOLD")
    return d.select("entity", "n_sellers", "n_buyers", rnd("best_ask", 4).alias("best_ask"), rnd("best_bid", 4).alias("best_bid"), "sell_depth", "buy_depth",
                    rnd("anon_sell").alias("anon_sell"), "buyers_below", "depth_below", rnd("spread_pct", 5).alias("spread_pct"), rnd("depth_ratio").alias("depth_ratio"))


@query("b3_fee_schedule_study", with_(f"""
SELECT count(*) AS n, {r('avg(CAST(fee_uncapped > 8000 AS INT))')} AS capped_by_count, {r('sum(CASE WHEN fee_uncapped > 8000 THEN value ELSE 0 END) / sum(value)')} AS capped_by_value,
 {r('CAST(sum(CASE WHEN fee_uncapped > 8000 THEN amount ELSE 0 END) AS DOUBLE) / sum(amount)')} AS capped_by_units, count(*) FILTER (fee_uncapped < 2000) AS n_at_floor,
 {r('quantile_cont(price, 0.5)', 4)} AS median_price, CAST(ceil(400000.0 / quantile_cont(price, 0.5) / 25) * 25 AS BIGINT) AS cap_binds_lot FROM offers"""))
def b3(t):
    d = B.fee_study(t.book)
    return d.select("n", rnd("capped_by_count").alias("capped_by_count"), rnd("capped_by_value").alias("capped_by_value"), rnd("capped_by_units").alias("capped_by_units"),
                    "n_at_floor", rnd("median_price", 4).alias("median_price"), "cap_binds_lot")


@query("b3b_round_trip_by_size", with_(f"""
SELECT bin AS decile, {r('quantile_cont(amt, 0.5)', 2)} AS median_amount, {r('2 * quantile_cont(eff, 0.5)', 5)} AS roundtrip_pct FROM bo GROUP BY 1""",
    ("am", "SELECT CAST(amount AS DOUBLE) AS amt, eff FROM offers"), ("bo", qbin_sql("am", "amt", 10))))
def b3b(t):
    return B.round_trip_by_size(t.book).select("decile", rnd("median_amount", 2).alias("median_amount"), rnd("roundtrip_pct", 5).alias("roundtrip_pct"))


@query("b4_size_band_participation", with_(f"""
SELECT CASE WHEN amount >= 200 THEN 'wholesale' WHEN amount >= 100 THEN 'dealer' WHEN amount >= 50 THEN 'regular' ELSE 'small' END AS band, count(*) AS offers,
 CAST(sum(amount) AS BIGINT) AS units, {r('CAST(sum(amount) AS DOUBLE) / (SELECT sum(amount) FROM book)')} AS unit_share,
 {r("CAST(sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS DOUBLE) / sum(amount)")} AS buy_share FROM book GROUP BY 1"""))
def b4(t):
    d = B.size_bands(t.book, [0, 50, 100, 200], ["small", "regular", "dealer", "wholesale"])
    return d.select("band", "offers", "units", rnd("unit_share").alias("unit_share"), rnd("buy_share").alias("buy_share"))


@query("b5_executable_depth", with_(f"""
WITH m AS (SELECT entity, quantile_cont(price, 0.5) AS ref FROM book GROUP BY 1), f AS (SELECT entity, quantile_cont(volume, 0.5) AS flow FROM panel GROUP BY 1)
SELECT b.entity, CAST(sum(amount) AS BIGINT) AS depth, CAST(coalesce(sum(amount) FILTER (price / ref - 1 > -0.05), 0) AS BIGINT) AS near_depth,
 {r('CAST(coalesce(sum(amount) FILTER (price / ref - 1 > -0.05), 0) AS DOUBLE) / sum(amount)')} AS near_share, {r('sum(amount) / max(flow)', 4)} AS depth_over_flow
FROM book b JOIN m USING (entity) JOIN f USING (entity) WHERE side = 'buy' GROUP BY 1""").replace("\nWITH m AS", ",\nm AS"))
def b5(t):
    ref = Q.quantile_wide(t.book, "price", {"ref": 0.5}, ["entity"])
    flow = t.panel.groupBy("entity").agg(F.percentile("volume", F.lit(0.5)).alias("flow"))
    d = B.executable_depth(t.book, ref, flow)
    return d.select("entity", "depth", "near_depth", rnd("near_share").alias("near_share"), rnd("depth_over_flow", 4).alias("depth_over_flow"))


@query("b6_venue_depth", with_(f"""
WITH p AS (SELECT name AS venue, CAST(sum(amount) AS BIGINT) AS depth, sum(value) / sum(amount) AS price FROM book GROUP BY 1)
SELECT count(*) AS n_pools, CAST(sum(depth) AS BIGINT) AS depth, arg_max(venue, (depth, venue)) AS deepest, {r('arg_max(price, (depth, venue))', 4)} AS price, {r('min(price)', 4)} AS price_lo, {r('max(price)', 4)} AS price_hi FROM p""").replace("\nWITH p AS", ",\np AS"))
def b6(t):
    p = t.book.groupBy(F.col("name").alias("venue")).agg(F.sum("amount").alias("depth"), (F.sum("value") / F.sum("amount")).alias("price"))
    return B.venues(p, "venue", "depth", "price").select("n_pools", "depth", "deepest", rnd("price", 4).alias("price"), rnd("price_lo", 4).alias("price_lo"), rnd("price_hi", 4).alias("price_hi"))


# ------------------------------------------------------------------ signal studies

define("sig", """SELECT entity, date, dev, dl AS dev_lag, abs(dl) AS absdev, h, -sign(dl) * (fut - dev) AS gross, hold FROM (SELECT entity, date, dev, dl, unnest([1, 7, 30]) AS h, unnest([f1, f7, f30]) AS fut, unnest([g1, g7, g30]) AS hold FROM
  (SELECT entity, date, dev, lag(dev) OVER we AS dl, lead(dev, 1) OVER we AS f1, lead(dev, 7) OVER we AS f7, lead(dev, 30) OVER we AS f30,
    lead(logp, 1) OVER we - logp AS g1, lead(logp, 7) OVER we - logp AS g7, lead(logp, 30) OVER we - logp AS g30 FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date)))""")
define("past", "SELECT * FROM sig WHERE absdev > 0.02 AND gross IS NOT NULL")


def qbin_by_sql(src, value, k, by):
    edges = ", ".join(f"quantile_cont({value}, {i / k!r})" for i in range(k + 1))
    on = " AND ".join(f"s.{c} = e.{c}" for c in by)
    return (f"SELECT s.*, greatest(len(list_filter(e.edges, lambda x: x < s.{value})), 1) AS decile FROM {src} s JOIN "
            f"(SELECT {', '.join(by)}, list_distinct([{edges}]) AS edges FROM {src} GROUP BY {', '.join(by)}) e ON {on}")


define("binned_past", qbin_by_sql("past", "absdev", 10, ["h"]))


def score_sql(trades: str, by: list[str], name: str = "x"):
    """CTEs and body for the score table of ``trades`` (columns by..., h, date, absdev, gross, net)."""
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in by)
    ct = [(f"{name}_t", f"SELECT *, {key} AS kk FROM ({trades})"), (f"{name}_d", f"SELECT kk, max(h) AS hh, date, avg(net) AS v FROM {name}_t GROUP BY kk, date"),
          (f"{name}_n", nw_sql(f"{name}_d", "v", "date", "hh", "kk").replace("SELECT kk, v AS x,", "SELECT kk, hh, v AS x,", 1))]
    body = f"""SELECT {', '.join('g.' + c for c in by)}, g.n, {r('net_pct', 5)} AS net_pct, {r('hit', 5)} AS share_profitable, {r('t_naive', 3)} AS t_naive, {r('mean / se', 3)} AS t_stat, windows
 FROM (SELECT kk, {', '.join(f'max({c}) AS {c}' for c in by)}, count(*) AS n, avg(net) * 100 AS net_pct, avg(CAST(net > 0 AS INT)) AS hit, avg(net) / (stddev(net) / sqrt(count(net))) AS t_naive,
   CAST(floor((max(date) - min(date)) / CAST(max(h) AS DOUBLE)) AS BIGINT) AS windows FROM {name}_t GROUP BY kk) g JOIN {name}_n s ON g.kk = s.kk"""
    return ct, body


def scored(df, by):
    return df.select(*by, "n", rnd("net_pct", 5).alias("net_pct"), rnd("share_profitable", 5).alias("share_profitable"), rnd("t_naive", 3).alias("t_naive"), rnd("t_stat", 3).alias("t_stat"), "windows")


_ct, _body = score_sql("SELECT entity, date, h, decile, absdev, gross, basis, gross - cost AS net FROM (SELECT *, unnest(['small offer', 'above the fee cap']) AS basis, unnest([0.04, 0.01]) AS cost FROM binned_past)", ["h", "decile", "basis"])


@query("b7_signal_grid", with_(_body, *_ct))
def b7(t):
    return scored(G.signal_grid(t.dev, [1, 7, 30]), ["h", "decile", "basis"])


TOP = "SELECT entity, date, h, absdev, gross, gross - 0.01 AS net FROM binned_past WHERE decile = 10"
_ct9, _body9 = score_sql(TOP, ["h"])


@query("b8_model_ranked_selection")
def b8(t):
    """Daily rank of a linear model's prediction; net return of the extreme decile on held-out dates."""
    from gridloom.operators.features import deviation_features
    from gridloom.operators.learning import fit_linear_split
    f = deviation_features(t.dev)
    pred = fit_linear_split(f, ["dev_lag", "dev_mean3", "dev_mean7", "ret_lag"], "y", "date", share=0.7)
    p = W.cross_rank_pct(pred, "prediction", ["date"], "rk").where("rk >= 0.9 or rk <= 0.1")
    p = p.withColumn("h", F.lit(1)).withColumn("absdev", F.abs("dev_lag")).withColumn("gross", F.when(F.col("rk") >= 0.9, F.col("y")).otherwise(-F.col("y")))
    return G.score(p.withColumn("net", F.col("gross") - 0.01), ["h"])


@query("b9_overlap_inflation", with_("SELECT h, n, net_pct, t_naive, t_stat, windows FROM (" + _body9 + ")", *_ct9))
def b9(t):
    d = G.overlap_inflation(G.top_bin(t.dev, [1, 7, 30]))
    return d.select("h", "n", rnd("net_pct", 5).alias("net_pct"), rnd("t_naive", 3).alias("t_naive"), rnd("t_stat", 3).alias("t_stat"), "windows")


DELAY = ("dsig", """SELECT entity, date, abs(dl) AS absdev, h, -sign(dl) * (fut - entry) AS gross FROM (SELECT entity, date, dl, entry, unnest([7, 30]) AS h, unnest([f7, f30]) AS fut FROM
  (SELECT entity, date, lag(dev) OVER we AS dl, lead(dev) OVER we AS entry, lead(dev, 8) OVER we AS f7, lead(dev, 31) OVER we AS f30 FROM dev WINDOW we AS (PARTITION BY entity ORDER BY date))) WHERE abs(dl) > 0.02 AND fut - entry IS NOT NULL""")
_ct10, _body10 = score_sql("SELECT *, gross - 0.01 AS net FROM dbin WHERE decile = 10", ["h"])


@query("b10_delayed_entry", with_(_body10, DELAY, ("dbin", qbin_by_sql("dsig", "absdev", 10, ["h"])), *_ct10))
def b10(t):
    return scored(G.score(G.top_bin(t.dev, [7, 30], delay=1), ["h"]), ["h"])


@query("b11_concentration", with_(f"""
SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS n, {r('avg(net) * 100', 5)} AS mean_pct FROM ({TOP}) WHERE h = 30 GROUP BY 1"""))
def b11(t):
    d = G.top_bin(t.dev, [30])
    return d.groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), rnd(F.avg("net") * 100, 5).alias("mean_pct"))


@query("b11b_concentration_entities", with_(f"""
WITH e AS (SELECT entity, avg(net) AS m, count(*) AS c FROM ({TOP}) WHERE h = 30 GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (m > 0) AS profitable, CAST(sum(c) AS BIGINT) AS trades, {r('(SELECT sum(c) FROM (SELECT c FROM e ORDER BY m DESC, entity LIMIT 5)) / sum(c)')} AS top_share FROM e""").replace("\nWITH e AS", ",\ne AS"))
def b11b(t):
    d = G.concentration_by_entity(G.top_bin(t.dev, [30]))
    return d.select("entities", "profitable", "trades", rnd("top_share").alias("top_share"))


@query("b12_long_only_paired", with_(f"""
SELECT m.h, {r('cheap * 100', 5)} AS cheap_pct, {r('any_ * 100', 5)} AS any_pct, {r('rich * 100', 5)} AS rich_pct, n_cheap, {r('mean * 100', 5)} AS paired_pct, {r('mean / se', 3)} AS t, s.n AS n_dates
FROM (SELECT h, avg(hold) FILTER (dev_lag < -0.02) AS cheap, avg(hold) AS any_, avg(hold) FILTER (dev_lag > 0.02) AS rich, count(hold) FILTER (dev_lag < -0.02) AS n_cheap FROM lo GROUP BY 1) m JOIN nwr s ON s.h = m.h""",
    ("lo", "SELECT * FROM sig WHERE hold IS NOT NULL AND dev_lag IS NOT NULL"),
    ("ld", "SELECT h, date, avg(hold) FILTER (dev_lag < -0.02) - avg(hold) AS v FROM lo GROUP BY 1, 2 HAVING count(*) FILTER (dev_lag < -0.02) > 0"), ("nwr", nw_sql("ld", "v", "date", "h", "h"))))
def b12(t):
    d = G.long_only(t.dev, [1, 7, 30])
    return d.select("h", *[rnd(c, 5).alias(c) for c in ("cheap_pct", "any_pct", "rich_pct", "paired_pct")], "n_cheap", rnd("t", 3).alias("t"), "n_dates")


EPI = (("q9", "SELECT * FROM past WHERE h = 30"), ("qq", "SELECT * FROM q9 WHERE absdev >= (SELECT quantile_cont(absdev, 0.9) FROM q9)"),
       ("ep", """SELECT entity, episode, min(date) AS start_date, max(date) AS end_date, count(*) AS days, avg(absdev) AS mean_dev, avg(gross) AS gross FROM
         (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY date) AS BIGINT) AS episode FROM (SELECT *, date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS g FROM qq)) GROUP BY 1, 2"""))


def widest(t):
    q = G.qualifying(G.signals(t.dev, [30]))
    return J.with_scalars(q, Q.quantile_row(q, "absdev", {"c": 0.9}), "z").where("absdev >= z.c").drop("z")


@query("b13_episodes", with_(f"SELECT entity, episode, start_date, end_date, days, {r('mean_dev')} AS mean_dev, {r('gross')} AS gross FROM ep", *EPI))
def b13(t):
    return G.episodes(widest(t)).select("entity", "episode", "start_date", "end_date", "days", rnd("mean_dev").alias("mean_dev"), rnd("gross").alias("gross"))


@query("b13b_disjoint_bins", with_(f"SELECT n, {r('mean', 5)} AS mean, {r('mean / se', 3)} AS t FROM nwr", *EPI,
    ("bn", "SELECT CAST(floor((start_date - (SELECT min(start_date) FROM ep)) / 30.0) AS BIGINT) AS bin, avg(gross - 0.01) AS v FROM ep GROUP BY 1"), ("nwr", nw_sql("bn", "v", "bin", 1))))
def b13b(t):
    return G.disjoint_t(G.episodes(widest(t)), 30).select("n", rnd("mean", 5).alias("mean"), rnd("t", 3).alias("t"))


@query("b14_capacity", with_(f"""
SELECT count(*) AS episodes, {r('count(*) / (span / 30.44)', 4)} AS per_month, {r('count(*) / (span / 30.44) * 75', 3)} AS units_per_month, {r('count(*) / (span / 30.44) * 75 * px', 1)} AS value_per_month
FROM ep, (SELECT max(date) - min(date) AS span FROM dev), (SELECT avg(price) AS px FROM panel WHERE date = (SELECT max(date) FROM panel)) GROUP BY span, px""", *EPI))
def b14(t):
    p = J.with_scalars(t.panel, t.panel.agg(F.max("date").alias("d")), "m").where("date = m.d").agg(F.avg("price").alias("price"))
    net = G.top_bin(t.dev, [30]).agg((F.avg("net") * 100).alias("net_pct"))
    d = G.capacity(G.episodes(widest(t)), t.dev.agg(F.min("date").alias("lo"), F.max("date").alias("hi")), 75.0, p, net)
    return d.select("episodes", rnd("per_month", 4).alias("per_month"), rnd("units_per_month", 3).alias("units_per_month"), rnd("value_per_month", 1).alias("value_per_month"))


SPLIT = ("sp", "SELECT date AS split FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM dev)) WHERE i = floor(n * 0.7)")
HOLD = (SPLIT, ("hs", "SELECT s.*, CASE WHEN date <= split - h THEN 'train' WHEN date > split THEN 'holdout' END AS period FROM sig s, sp WHERE gross IS NOT NULL AND dev_lag IS NOT NULL"),
        ("hc", "SELECT h, quantile_cont(absdev, 0.9) AS cutoff FROM hs WHERE period = 'train' AND absdev > 0.02 GROUP BY 1"))
_ct15, _body15 = score_sql("SELECT hs.*, gross - 0.01 AS net FROM hs JOIN hc ON hs.h = hc.h WHERE period IS NOT NULL AND absdev >= cutoff", ["h", "period"])


@query("b15_true_holdout", with_(_body15, *HOLD, *_ct15))
def b15(t):
    return scored(G.holdout(t.dev, [1, 7, 30]), ["h", "period"])


def _regime_sql(within):
    per = "CASE WHEN date <= split THEN 'train' ELSE 'holdout' END" if within else "'all'"
    dd = (SPLIT, ("dsp", "SELECT date, stddev(dev) AS disp FROM dev GROUP BY 1"),
          ("rs", f"SELECT s.*, disp, {per} AS period FROM sig s JOIN dsp USING (date), sp WHERE gross IS NOT NULL AND dev_lag IS NOT NULL AND disp IS NOT NULL AND h IN (7, 30)"),
          ("rc", "SELECT period, h, quantile_cont(absdev, 0.9) AS cutoff FROM rs WHERE absdev > 0.02 GROUP BY 1, 2"),
          ("rb", "SELECT rs.*, gross - 0.01 AS net FROM rs JOIN rc ON rs.period = rc.period AND rs.h = rc.h WHERE absdev >= cutoff"),
          ("rt", qbin_by_sql("rb", "disp", 3, ["period", "h"])))
    ct, body = score_sql("SELECT *, decile AS tercile FROM rt", ["period", "h", "tercile"])
    return with_(body, *dd, *ct)


@query("b16_dispersion_regime", _regime_sql(False))
def b16(t):
    return scored(G.dispersion_regime(t.dev, [7, 30]), ["period", "h", "tercile"])


@query("b16b_regime_within_period", _regime_sql(True))
def b16b(t):
    return scored(G.dispersion_regime(t.dev, [7, 30], within=True), ["period", "h", "tercile"])


_ct17, _body17 = score_sql("SELECT x.*, gross - 0.01 AS net FROM sx x JOIN sc ON x.h = sc.h AND x.selector = sc.selector WHERE v >= cutoff", ["h", "selector"])


@query("b17_selector_comparison", with_(_body17, ("dsp", "SELECT date, stddev(dev) AS disp FROM dev GROUP BY 1"),
    ("sx", "SELECT entity, date, h, absdev, gross, unnest(['raw', 'normalised']) AS selector, unnest([absdev, absdev / disp]) AS v FROM sig JOIN dsp USING (date) WHERE gross IS NOT NULL AND dev_lag IS NOT NULL AND disp > 0"),
    ("sc", "SELECT h, selector, quantile_cont(v, 0.9) AS cutoff FROM sx GROUP BY 1, 2"), *_ct17))
def b17(t):
    return scored(G.selector_comparison(t.dev, [1, 7, 30]), ["h", "selector"])


@query("b18_gap_trading_rule", with_(f"""
SELECT basis, count(*) AS n_trades, {r('avg(gross) * 100', 5)} AS gross_pct, {r('avg(gross - cost) * 100', 5)} AS net_pct, {r('avg(CAST(gross > cost AS INT))', 5)} AS share_profitable,
 {r('avg(gross - cost) / (stddev(gross - cost) / sqrt(count(*)))', 3)} AS t_stat FROM (SELECT *, unnest(['small offer', 'above the fee cap']) AS basis, unnest([0.04, 0.01]) AS cost FROM past WHERE h = 7) GROUP BY 1"""))
def b18(t):
    d = G.with_cost(G.qualifying(G.signals(t.dev, [7])))
    return d.groupBy("basis").agg(F.count("*").alias("n_trades"), rnd(F.avg("gross") * 100, 5).alias("gross_pct"), rnd(F.avg("net") * 100, 5).alias("net_pct"),
                                  rnd(F.avg((F.col("net") > 0).cast("double")), 5).alias("share_profitable"),
                                  rnd(F.avg("net") / (F.stddev("net") / F.sqrt(F.count("net"))), 3).alias("t_stat"))


# ------------------------------------------------------------------ scenarios

PROBS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]


@query("b19_block_bootstrap_quantiles")
def b19(t):
    blocks = N.residual_blocks(t.prm, ["entity"], "ret", "date", 0.02)
    return N.bootstrap_quantiles(N.simulate(blocks, ["entity"], [1, 3, 6], 4000, block=4), ["entity"], PROBS)


ORIGINS = ("og", "SELECT DISTINCT date AS origin FROM panel_m WHERE date >= (SELECT dd[CAST(floor(len(dd) * 0.6) AS BIGINT) + 1] FROM (SELECT list(DISTINCT date ORDER BY date) AS dd FROM panel_m)) AND month(date) % 3 = 1")


@query("b20_rolling_origin_baselines", with_(f"""
WITH o AS (SELECT p.entity, og.origin, p.price AS p0, (SELECT price FROM panel_m q WHERE q.entity = p.entity AND q.date = CAST(og.origin - INTERVAL 6 MONTH AS DATE)) AS sn FROM og JOIN panel_m p ON p.date = og.origin),
x AS (SELECT o.*, h, a.price AS actual FROM (SELECT *, unnest([1, 3, 6]) AS h FROM o) o JOIN panel_m a ON a.entity = o.entity AND a.date = CAST(o.origin + to_months(CAST(h AS INT)) AS DATE))
SELECT h, 'rw' AS model, count(*) AS n, {r('avg(abs(p0 / actual - 1)) * 100', 4)} AS mape, {r('sqrt(avg(pow(ln(p0 / actual), 2))) * 100', 4)} AS rmsle, {r('avg(CAST(abs(p0 / actual - 1) <= 0.05 AS INT))', 5)} AS within FROM x GROUP BY 1 UNION ALL
SELECT h, 'seasonal', count(*), {r('avg(abs(sn / actual - 1)) * 100', 4)}, {r('sqrt(avg(pow(ln(sn / actual), 2))) * 100', 4)}, {r('avg(CAST(abs(sn / actual - 1) <= 0.05 AS INT))', 5)} FROM x WHERE sn IS NOT NULL GROUP BY 1""", ORIGINS).replace("\nWITH o AS", ",\no AS"))
def b20(t):
    p = t.panel_m.select("entity", "date", "price")
    og = J.with_scalars(p, V.cut_dates(p, "date", c=0.6), "_s").where("date >= _s.c and month(date) % 3 = 1").select("entity", F.col("date").alias("origin"), F.col("price").alias("rw"))
    sn = p.select("entity", F.add_months("date", 6).alias("origin"), F.col("price").alias("seasonal"))
    hs = F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("h")
    act = p.select("entity", F.col("date").alias("_d"), F.col("price").alias("actual"), hs).select("entity", F.expr("add_months(_d, -h)").alias("origin"), "h", "actual")
    x = og.join(sn, ["entity", "origin"], "left").join(act, ["entity", "origin"])
    m = x.unpivot(["h", "actual"], ["rw", "seasonal"], "model", "pred").where("pred is not null")
    return V.level_metrics(m, ["h", "model"], "actual", "pred").select("h", "model", "n", rnd("mape", 4).alias("mape"), rnd("rmsle", 4).alias("rmsle"), rnd("within", 5).alias("within"))


def _origin_sims(t, n_sim=4000):
    og = t.panel_m.select(F.col("date").alias("origin")).distinct()
    og = J.with_scalars(og, V.cut_dates(og, "origin", c=0.6), "_s").where("origin >= _s.c and month(origin) % 3 = 1").drop("_s")
    hist = N.rolling_origins(t.prm.select("entity", "date", "ret"), "date", og)
    blocks = N.residual_blocks(hist, ["entity", "origin"], "ret", "date", 0.02, min_obs=24)
    sims = N.simulate(blocks, ["entity", "origin"], [1, 3, 6], n_sim, block=4)
    hs = F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("h")
    lp = t.prm.select("entity", "date", "logp")
    fut = lp.select("entity", F.col("date").alias("_d"), F.col("logp").alias("f"), hs).select("entity", F.expr("add_months(_d, -h)").alias("origin"), "h", "f")
    act = fut.join(lp.withColumnRenamed("date", "origin"), ["entity", "origin"]).select("entity", "origin", "h", (F.col("f") - F.col("logp")).alias("actual"))
    return sims, act


@query("b20b_rolling_origin_coverage")
def b20b(t):
    sims, act = _origin_sims(t)
    return N.coverage_table(N.coverage(sims, act, ["entity", "origin"], [0.5, 0.8, 0.9]))


@query("b21_scenario_bands")
def b21(t):
    """Index level relative to today: probability of each band and its conditional median."""
    idx = W.chain_index(t.prm, "logp", 5).where("chain_ret is not null").withColumn("idx", F.lit("index"))
    blocks = N.residual_blocks(idx, ["idx"], "chain_ret", "date", 0.02)
    return N.band_probabilities(N.simulate(blocks, ["idx"], [1, 3], 40000, block=4), [0.8, 0.95, 1.05, 1.2])


@query("b21b_scenario_percentiles")
def b21b(t):
    """Percentiles of the simulated index level from a histogram of log paths, and where given levels stand among the paths."""
    idx = W.chain_index(t.prm, "logp", 5).where("chain_ret is not null").withColumn("idx", F.lit("index"))
    sims = materialise(N.simulate(N.residual_blocks(idx, ["idx"], "chain_ret", "date", 0.02), ["idx"], [1, 3, 6], 40000, block=4), "paths")
    q = N.histogram_quantiles(N.path_histogram(sims, [], 1e-4), [], PROBS, 1e-4).select("h", F.lit("quantile").alias("kind"), F.col("prob").alias("percentile"), F.exp("q").alias("level"))
    return q.unionByName(N.level_percentiles(sims, [], [0.8, 0.9, 1.0, 1.1, 1.25]).select("h", F.lit("level").alias("kind"), "percentile", "level"))


@query("b22_band_coverage_calibration")
def b22(t):
    sims, act = _origin_sims(t)
    cov = N.coverage(sims, act, ["entity", "origin"], [0.8])
    return V.pit_histogram(cov.where("h = 3").select("percentile"), "percentile", 10)


@query("b23_ew_volatility_benchmark", with_(f"""
WITH i AS (SELECT entity, date, ret * ret AS v, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM prm WHERE ret IS NOT NULL),
f AS (SELECT a.entity, a.date, a.v, sum(pow(0.94, a.i - 1 - b.i) * b.v) / sum(pow(0.94, a.i - 1 - b.i)) AS ew, count(*) AS k FROM i a JOIN i b ON a.entity = b.entity AND b.i <= a.i - 1 GROUP BY 1, 2, 3),
c AS (SELECT dd[CAST(floor(len(dd) * 0.65) AS BIGINT) + 1] AS cut FROM (SELECT list(DISTINCT date ORDER BY date) AS dd FROM i)),
m AS (SELECT entity, avg(v) AS m FROM i, c WHERE date < cut GROUP BY 1)
SELECT entity, count(*) AS n, {r('sqrt(avg(pow(v - ew, 2)))', 5)} AS rmse_ew, {r('sqrt(avg(pow(v - m, 2)))', 5)} AS rmse_mean FROM f JOIN m USING (entity), c WHERE date >= cut AND k >= 3 GROUP BY 1""").replace("\nWITH i AS", ",\ni AS"))
def b23(t):
    import math
    d = t.prm.where("ret is not null").select("entity", "date", (F.col("ret") ** 2).alias("v"))
    e = W.ewma(d, "v", math.log(0.5) / math.log(0.94), "ew", "_sd", 3)
    e = e.withColumn("ew", F.lag("ew").over(W.series()))
    cut = V.cut_dates(d, "date", c=0.65)
    m = J.with_scalars(d, cut, "_s").where("date < _s.c").groupBy("entity").agg(F.avg("v").alias("m"))
    x = J.with_scalars(e, cut, "_s").where("date >= _s.c and ew is not null").join(m, "entity")
    rm = lambda c: F.sqrt(F.avg((F.col("v") - F.col(c)) ** 2))
    return x.groupBy("entity").agg(F.count("*").alias("n"), rnd(rm("ew"), 5).alias("rmse_ew"), rnd(rm("m"), 5).alias("rmse_mean"))
