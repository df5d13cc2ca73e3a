"""Streaming forms drained with availableNow over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.num import cents, rnd
from gridloom.registry import query
from gridloom.session import scratch
from gridloom.sqltext import r
from gridloom.streaming import jobs as T


def stream(t):
    return T.file_stream(t.spark, f"{t.path}/events*.parquet", "ts")


@query("t1_capture_dedupe", "SELECT DISTINCT user_id, date_trunc('hour', ts) AS cap FROM events")
def t1(t):
    d = stream(t).withColumn("cap", F.date_trunc("hour", "ts"))
    return T.run_to_table(T.deduplicated(d, ["user_id", "cap"], "1 hour").select("user_id", "cap"), "t1").select("user_id", F.col("cap").cast("timestamp_ntz").alias("cap"))


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("t2_last_scan_of_day", f"""
SELECT CAST(ts AS DATE) AS date, user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS scans FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= {CLOSED}""")
def t2(t):
    return T.run_to_table(T.last_of_day(stream(t), ["user_id"], "event_type", "event_id", "1 hour"), "t2")


@query("t3_intraday_profile", f"""
SELECT date_trunc('hour', ts) AS start, event_type, {r('avg(value)')} AS mean, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def t3(t):
    d = T.run_to_table(T.windowed_mean(stream(t), ["event_type"], "value", "1 hour", None, "1 hour"), "t3")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", rnd("mean").alias("mean"), "n")


@query("t4_sliding_volatility", f"""
SELECT start, event_type, {r('stddev(value)')} AS sd, count(*) AS n FROM (SELECT *, unnest([date_trunc('day', ts) - to_days(k) FOR k IN range(0, 7)]) AS start FROM events)
GROUP BY 1, 2 HAVING start + INTERVAL 7 DAY <= {CLOSED}""")
def t4(t):
    d = T.run_to_table(T.windowed_mean(stream(t), ["event_type"], "value", "7 days", "1 day", "1 hour"), "t4")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", rnd("sd").alias("sd"), "n")


@query("t5_signal_episodes", f"""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n, {r('avg(value)')} AS mean FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""")
def t5(t):
    d = T.run_to_table(T.gap_episodes(stream(t), ["user_id"], "value", "12 hours", "1 hour"), "t5")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n", rnd("mean").alias("mean"))


@query("t6_late_corrections", """
SELECT user_id, CAST(ts AS DATE) AS date, round(coalesce(arg_max(value, (ts, event_id)) FILTER (event_id % 2 = 1), max(value)), 2) AS value FROM events GROUP BY 1, 2""")
def t6(t):
    base = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max("value").alias("value"))
    late = stream(t).where("event_id % 2 = 1").select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return T.apply_corrections(late, base, ["user_id", "date"], "date", scratch(t.spark, "t6"), ["ts", "event_id"]).select("user_id", "date", F.round("value", 2).alias("value"))


@query("t7_running_stock", "SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS stock FROM events GROUP BY 1")
def t7(t):
    return T.running_stock(stream(t).withColumn("c", cents("value")), "user_id", "c")


@query("t8_staleness_alert", f"""
WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
SELECT user_id, ts AS last_seen, ts + INTERVAL 2 DAY AS alert_at FROM g WHERE (nx IS NULL OR nx - ts >= INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY <= {CLOSED}""")
def t8(t):
    d = T.run_to_table(T.staleness_alerts(stream(t), "user_id", "2 days", "1 hour"), "t8")
    return d.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "alert_at")])


@query("t9_stream_static_enrich", """
SELECT n_name AS name, count(*) AS n FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1""")
def t9(t):
    dim = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    d = T.enriched(stream(t).withColumn("k", F.col("user_id") % 25), dim, ["k"]).select("event_id", "name")
    return T.run_to_table(d, "t9").groupBy("name").agg(F.count("*").alias("n"))


@query("t9b_stream_stream_join", """
SELECT o_orderkey, count(*) AS lines, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) - 120 AND CAST(o_orderdate AS DATE) + 120 GROUP BY 1""")
def t9b(t):
    o = T.file_stream(t.spark, f"{t.path}/orders*.parquet", "o_orderdate", "l_ts").select(F.col("o_orderkey").alias("key_l"), "l_ts")
    li = T.file_stream(t.spark, f"{t.path}/lineitem*.parquet", "l_shipdate", "r_ts").select(F.col("l_orderkey").alias("key_r"), "r_ts", F.round("l_quantity").cast("long").alias("q"))
    d = T.run_to_table(T.matched(o, li, "key", 120, "1 day").select(F.col("key_l").alias("o_orderkey"), "q"), "t9b", flush=False)
    return d.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum("q").alias("qty"))
