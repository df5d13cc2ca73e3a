"""Joins, sort/limit and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions.num import rnd
from gridloom.functions import scalar as S
from gridloom.operators import joins as J
from gridloom.registry import query
from gridloom.sqltext import r, with_


@query("j1_inner_composite", with_("""
SELECT entity, date, n, sell_qty FROM panel JOIN sides USING (entity, date) WHERE sell_price IS NOT NULL"""))
def j1(t):
    return t.panel.join(t.sides.where("sell_price is not null"), ["entity", "date"]).select("entity", "date", "n", "sell_qty")


@query("j2_left_enrichment_chain", with_(f"""
SELECT p.entity, p.date, region, kind, population, coalesce(ev_month_end, 0) AS ev_month_end,
  {r("(p.date - created) / 365.25")} AS age_years FROM panel p LEFT JOIN dim USING (entity) LEFT JOIN calendar USING (date)"""))
def j2(t):
    d = t.panel.join(t.dim, "entity", "left").join(t.calendar, "date", "left")
    return d.select("entity", "date", "region", "kind", "population",
                    F.coalesce("ev_month_end", F.lit(0)).alias("ev_month_end"),
                    rnd(F.datediff("date", "created") / 365.25).alias("age_years"))


@query("j3_full_outer", """
SELECT coalesce(a.k, b.k) AS entity, a.n_sup, b.n_cus FROM
 (SELECT s_nationkey AS k, count(*) AS n_sup FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) a
 FULL JOIN (SELECT c_nationkey AS k, count(*) AS n_cus FROM customer WHERE c_acctbal > 9800 GROUP BY 1) b ON a.k = b.k""")
def j3(t):
    a = t.supplier.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("entity")).agg(F.count("*").alias("n_sup"))
    b = t.customer.where("c_acctbal > 9800").groupBy(F.col("c_nationkey").alias("entity")).agg(F.count("*").alias("n_cus"))
    return a.join(b, "entity", "full")


@query("j4_right_keep_dimension", """
SELECT n_nationkey AS entity, n_name AS name, n_sup FROM (SELECT s_nationkey, count(*) AS n_sup FROM supplier
 WHERE s_acctbal > 5000 GROUP BY 1) RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def j4(t):
    a = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("entity")).agg(F.count("*").alias("n_sup"))
    d = t.nation.select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name"))
    return a.join(d, "entity", "right").select("entity", "name", "n_sup")


@query("j5_map_lookup", """
SELECT o_orderkey, coalesce(n_name, 'unknown') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j5(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = J.enrich(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"], "left", spread="o_orderkey")
    m = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(o, m, "c_nationkey", "n_name", "nation", F.lit("unknown")).select("o_orderkey", "nation")


@query("j6_left_semi", with_("""
SELECT entity, date, n FROM panel WHERE entity IN (SELECT entity FROM panel GROUP BY 1 HAVING count(*) >= 1400)"""))
def j6(t):
    ok = t.panel.groupBy("entity").agg(F.count("*").alias("k")).where("k >= 1400")
    return t.panel.join(ok, "entity", "left_semi").select("entity", "date", "n")


@query("j7_left_anti", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def j7(t):
    have = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.select("o_orderkey", "o_custkey").join(have, "o_orderkey", "left_anti")


@query("j8_date_spine", with_("""
SELECT g.entity, g.date, coalesce(n, 0) AS n, n IS NOT NULL AS observed FROM
 (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT entity FROM panel), (SELECT min(date) AS lo, max(date) AS hi FROM panel)) g
 LEFT JOIN panel p ON p.entity = g.entity AND p.date = g.date"""))
def j8(t):
    p = t.panel.select("entity", "date", "n")
    return J.date_spine(p, "entity", "date", full=True).join(p, ["entity", "date"], "left").select(
        "entity", "date", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("observed"))


@query("j9_event_window", with_("""
SELECT date, n_orders, EXISTS (SELECT 1 FROM calendar e WHERE e.ev_month_end = 1 AND c.date BETWEEN e.date - 3 AND e.date + 5) AS in_window
FROM calendar c"""))
def j9(t):
    cal = t.calendar
    return J.event_window(cal.select("date", "n_orders"), cal.where("ev_month_end = 1").select("date"), "date", -3, 5)


@query("j10_nearest_event_distance", with_("""
SELECT date, CASE WHEN p IS NULL THEN date - nx WHEN nx IS NULL THEN date - p
  WHEN abs(date - p) <= abs(date - nx) THEN date - p ELSE date - nx END AS days_to_event
FROM (SELECT date, (SELECT max(date) FROM calendar e WHERE e.ev_urgent = 1 AND e.date <= c.date) AS p,
             (SELECT min(date) FROM calendar e WHERE e.ev_urgent = 1 AND e.date >= c.date) AS nx FROM calendar c)"""))
def j10(t):
    cal = t.calendar
    return J.signed_distance(cal.select("date"), cal.where("ev_urgent = 1").select("date"), "date", "days_to_event")


@query("j11_backward_asof", with_("""
SELECT p.entity, p.date, coalesce(p.date - (SELECT max(m.date) FROM big m WHERE m.entity = p.entity AND m.date <= p.date), 9999) AS days_since,
  coalesce(p.date - (SELECT max(m.date) FROM big m WHERE m.entity = p.entity AND m.date <= p.date) BETWEEN 0 AND 90, false) AS recent,
  coalesce(p.date - (SELECT max(m.date) FROM big m WHERE m.entity = p.entity), 9999) AS days_since_any
FROM panel p""", ("big", "SELECT entity, date FROM panel WHERE volume >= 150")))
def j11(t):
    p = t.panel.select("entity", "date")
    big = t.panel.where("volume >= 150").select("entity", F.col("date").alias("mark"))
    d = J.asof_backward(p, big, "entity", "date", "mark")
    d = J.last_mark_any(d.drop("mark"), big, "entity", "mark", "any_mark")
    since = F.datediff("date", "last_mark")
    return d.select("entity", "date", F.coalesce(since, F.lit(9999)).cast("long").alias("days_since"),
                    F.coalesce(since.between(0, 90), F.lit(False)).alias("recent"),
                    F.coalesce(F.datediff("date", "any_mark"), F.lit(9999)).cast("long").alias("days_since_any"))


@query("j12_exact_horizon", with_(f"""
SELECT a.entity, a.date, h, {r("b.logp - a.logp")} AS fwd FROM pr a, (SELECT unnest([1, 7, 30]) AS h) g
LEFT JOIN pr b ON b.entity = a.entity AND b.date = a.date + h"""))
def j12(t):
    d = J.at_horizons(t.pr.select("entity", "date", "logp"), "entity", "date", "logp", [1, 7, 30], "fut")
    return d.select("entity", "date", "h", rnd(F.col("fut") - F.col("logp")).alias("fwd"))


@query("j14_leave_one_out_market", with_(f"""
SELECT a.entity, a.date, {r("(b.s - a.logp) / (b.n - 1)")} AS others FROM pr a
JOIN (SELECT date, sum(logp) AS s, count(*) AS n FROM pr GROUP BY 1 HAVING count(*) > 1) b USING (date)"""))
def j14(t):
    d = J.leave_one_out(t.pr, ["date"], "logp", "others")
    return d.where("others is not null").select("entity", "date", rnd("others").alias("others"))


@query("j15_peer_group_lag", with_(f"""
SELECT a.entity, a.date, {r("avg(b.logp)")} AS peers FROM pr a JOIN dim da ON a.entity = da.entity
LEFT JOIN (SELECT pr.*, region FROM pr JOIN dim USING (entity)) b ON b.date = a.date AND b.region = da.region AND b.entity <> a.entity
GROUP BY 1, 2"""))
def j15(t):
    d = t.pr.select("entity", "date", "logp").join(t.dim.select("entity", "region"), "entity")
    return J.peer_mean(d, ["date", "region"], "logp", "peers").select("entity", "date", rnd("peers").alias("peers"))


@query("j16_validated_cardinality", with_("""
SELECT 'dim' AS right_side, count(*) AS repeated FROM (SELECT entity FROM dim GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'joined rows', count(*) FROM panel JOIN dim USING (entity)"""))
def j16(t):
    one = lambda label, df: df.agg(F.count("*").alias("repeated")).select(F.lit(label).alias("right_side"), "repeated")
    joined = J.join_many_to_one(t.panel.select("entity", "date"), t.dim.select("entity", "region"), ["entity"], "inner")
    return (one("dim", J.duplicate_keys(t.dim, ["entity"]))
            .unionByName(one("lineitem", J.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])))
            .unionByName(one("joined rows", joined)))


@query("j17_rank_in_reference", with_(f"""
SELECT a.entity, a.date, count(b.price) AS n_ref, {r("CASE WHEN count(b.price) > 0 THEN CAST(count(b.price) FILTER (b.price <= a.price) AS DOUBLE) / count(b.price) END")} AS pct
FROM (SELECT panel.* FROM panel JOIN dim USING (entity) WHERE kind = 'optional') a
LEFT JOIN (SELECT panel.* FROM panel JOIN dim USING (entity) WHERE kind = 'open') b ON a.date = b.date GROUP BY 1, 2"""))
def j17(t):
    d = t.panel.join(t.dim.select("entity", "kind"), "entity").select("entity", "date", "price", "kind")
    out = J.rank_in_reference(d.where("kind = 'optional'").drop("kind"), d.where("kind = 'open'"), "date", "price", "pct")
    return out.select("entity", "date", "n_ref", rnd("pct").alias("pct"))


@query("j18_interval_overlap_count", with_("""
SELECT d.date, count(s.entity) AS expected FROM (SELECT DISTINCT date FROM calendar) d
LEFT JOIN (SELECT s_suppkey AS entity, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) s ON d.date BETWEEN s.lo AND s.hi GROUP BY 1"""))
def j18(t):
    spans = t.lines.groupBy("l_suppkey").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return J.alive_on_date(spans, "lo", "hi", t.calendar.select("date"), "date").select("date", F.col("expected").cast("long"))


@query("j19_catalogue_rate_join", f"""
WITH cat AS (SELECT p_brand AS k, avg(p_retailprice) AS rate FROM part GROUP BY 1),
ev AS (SELECT l_orderkey, l_quantity, CASE p_size % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_brand || 's' ELSE ' ' || p_brand || '?' END AS raw
       FROM lineitem JOIN part ON l_partkey = p_partkey),
nm AS (SELECT l_quantity, lower(trim(raw)) AS nk FROM ev)
SELECT how, count(*) AS n, {r("sum(l_quantity)", 3)} AS qty, {r("sum(l_quantity * rate)", 1)} AS val FROM
 (SELECT l_quantity, coalesce(a.rate, b.rate) AS rate, CASE WHEN a.k IS NOT NULL THEN 'exact' WHEN b.k IS NOT NULL THEN 'plural' ELSE 'none' END AS how
  FROM nm LEFT JOIN cat a ON nk = lower(a.k) LEFT JOIN cat b ON nk = lower(b.k) || 's') GROUP BY how""")
def j19(t):
    from gridloom.operators.production import rate_join
    cat = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("rate"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.expr(
        "case p_size % 3 when 0 then upper(p_brand) when 1 then concat(p_brand, 's') else concat(' ', p_brand, '?') end").alias("raw"))
    ev = J.enrich(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), p, ["l_partkey"], "inner", spread="l_orderkey")
    ev = ev.groupBy("raw").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    return rate_join(ev, cat, "raw", "name", "rate").groupBy("how").agg(
        F.sum("c").alias("n"), rnd(F.sum("q"), 3).alias("qty"), rnd(F.sum(F.col("q") * F.col("rate")), 1).alias("val"))


@query("j20_coverage_anti_join", """
SELECT n_name AS name, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) THEN 'covered' ELSE 'missing' END AS status
FROM nation""")
def j20(t):
    exp = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    act = t.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    return J.coverage_status(exp, act, ["k"]).select("name", "status")


@query("j9b_interval_flags", with_("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (w) AS in_window FROM
 (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d,
   EXISTS (SELECT 1 FROM calendar e WHERE e.ev_urgent = 1 AND CAST(o_orderdate AS DATE) BETWEEN e.date AND e.date + 2) AS w FROM orders) GROUP BY 1"""))
def j9b(t):
    o = t.orders.select("o_orderpriority", F.to_date("o_orderdate").alias("date"))
    g = o.groupBy("o_orderpriority", "date").agg(F.count("*").alias("n"))
    f = J.event_window(g, t.calendar.where("ev_urgent = 1").select("date"), "date", 0, 2)
    return f.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("in_window"), F.col("n")).otherwise(0)).alias("in_window"))


# ------------------------------------------------------------------ sort / limit / sets


@query("l1_order_head", with_(f"""
SELECT entity, date, {r("price", 4)} AS price FROM panel ORDER BY panel.price DESC, entity, date LIMIT 25"""))
def l1(t):
    return t.panel.orderBy(F.col("price").desc(), "entity", "date").limit(25).select("entity", "date", rnd("price", 4).alias("price"))


@query("l2_topk_per_group", with_(f"""
SELECT entity, date, {r("price", 4)} AS price, rk FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY price DESC, date) AS rk FROM panel) WHERE rk <= 3"""))
def l2(t):
    w = Window.partitionBy("entity").orderBy(F.col("price").desc(), "date")
    return t.panel.withColumn("rk", F.row_number().over(w).cast("long")).where("rk <= 3").select(
        "entity", "date", rnd("price", 4).alias("price"), "rk")


@query("l3_order_by_abs", with_(f"""
SELECT entity, date, {r("dev")} AS dev FROM dev WHERE dev.dev IS NOT NULL ORDER BY abs(dev.dev) DESC, entity, date LIMIT 20"""))
def l3(t):
    return t.dev.where("dev is not null").orderBy(F.abs("dev").desc(), "entity", "date").limit(20).select(
        "entity", "date", rnd("dev").alias("dev"))


@query("u1_union_missing_columns", with_("""
SELECT entity, date, n, CAST(NULL AS BIGINT) AS n_orders, 'panel' AS src FROM panel UNION ALL
SELECT CAST(NULL AS INTEGER), date, CAST(NULL AS BIGINT), n_orders, 'calendar' FROM calendar"""))
def u1(t):
    return t.panel.select("entity", "date", "n", F.lit("panel").alias("src")).unionByName(
        t.calendar.select("date", "n_orders", F.lit("calendar").alias("src")), allowMissingColumns=True)


@query("u2_drop_duplicates_keep_last", """
SELECT user_id, hour_ts, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT *, date_trunc('hour', ts) AS hour_ts FROM events) GROUP BY 1, 2""")
def u2(t):
    from gridloom.operators.aggs import last_row
    e = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"), "ts", "event_id")
    return last_row(e, ["user_id", "hour_ts"], ["ts", "event_id"]).select("user_id", "hour_ts", "event_id")


@query("u3_intersect_keys", with_("""
SELECT date FROM (SELECT date FROM panel WHERE volume > 120) INTERSECT SELECT date FROM calendar WHERE ev_urgent = 1"""))
def u3(t):
    return t.panel.where("volume > 120").select("date").intersect(t.calendar.where("ev_urgent = 1").select("date"))


@query("u4_except_keys", with_("""
SELECT date FROM panel EXCEPT SELECT date FROM calendar"""))
def u4(t):
    return t.panel.select("date").distinct().join(t.calendar.select("date"), "date", "left_anti")


@query("u5_vote_union", with_("""
SELECT entity, count(*) AS votes FROM (
 SELECT entity FROM panel GROUP BY 1 HAVING avg(price) > (SELECT avg(price) FROM panel) UNION ALL
 SELECT entity FROM panel GROUP BY 1 HAVING avg(volume) > (SELECT avg(volume) FROM panel) UNION ALL
 SELECT entity FROM dim WHERE population > (SELECT avg(population) FROM dim) UNION ALL
 SELECT entity FROM dim WHERE mean_balance > (SELECT avg(mean_balance) FROM dim)) GROUP BY 1 HAVING count(*) >= 3"""))
def u5(t):
    p, d = t.panel, t.dim
    pm = J.with_scalars(p.groupBy("entity").agg(F.avg("price").alias("price"), F.avg("volume").alias("volume")),
                        p.agg(F.avg("price").alias("price"), F.avg("volume").alias("volume")), "m")
    dm = J.with_scalars(d, d.agg(F.avg("population").alias("population"), F.avg("mean_balance").alias("mean_balance")), "m")
    picks = [x.where(F.col(c) > F.col(f"m.{c}")).select("entity") for x, c in
             ((pm, "price"), (pm, "volume"), (dm, "population"), (dm, "mean_balance"))]
    u = picks[0]
    for x in picks[1:]:
        u = u.unionByName(x)
    return u.groupBy("entity").agg(F.count("*").alias("votes")).where("votes >= 3")
