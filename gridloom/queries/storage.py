"""Sources, sinks and incremental tables.

File formats are exercised by writing a given table in that format below the shared folder and
reading it back, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions.num import rnd
from gridloom.operators import integrity as G, quality as Q, tables as K
from gridloom.queries.modelling import baselines
from gridloom.registry import query
from gridloom.session import scratch
from gridloom.sources import files, text as T
from gridloom.sqltext import define, r, with_


@query("s1_read_snapshots", with_(f"SELECT entity, date, {r('price', 4)} AS price, {r('volume', 2)} AS volume FROM panel"))
def s1(t):
    """Nested snapshot documents per entity and month, read back to rows."""
    path = scratch(t.spark, "snapshots")
    s = F.struct(F.lit(1).cast("long").alias("id"), F.unix_timestamp(F.col("date").cast("timestamp")).cast("double").alias("time"), "price", "volume")
    docs = t.panel.groupBy("entity", F.date_trunc("month", "date").alias("m")).agg(F.array(F.collect_list(s)).alias("snapshots"))
    docs.select("entity", F.lit("ok").alias("status"), "snapshots").repartition("entity", F.year(F.timestamp_seconds(F.col("snapshots")[0][0]["time"]))).write.partitionBy("entity").json(path)
    d = files.read_snapshots(t.spark, path, multi_line=False)
    return d.select("entity", F.to_date("ts").alias("date"), rnd("price", 4).alias("price"), rnd("volume", 2).alias("volume"))


@query("s2_read_order_books", with_(f"SELECT entity, side, name, amount, {r('price', 4)} AS price, CAST(time AS DATE) AS day FROM book"))
def s2(t):
    path = scratch(t.spark, "books")
    o = F.struct("name", "amount", "price", F.unix_timestamp(F.col("time").cast("timestamp")).cast("double").alias("time"))
    side = lambda k: F.collect_list(F.when(F.col("side") == k, o))
    docs = t.book.groupBy("entity", F.col("time").alias("m"), F.floor(F.col("offer_id") / 1000)).agg(side("sell").alias("sellers"), side("buy").alias("buyers"))
    docs.select("entity", F.unix_timestamp(F.col("m").cast("timestamp")).cast("double").alias("update_time"), "sellers", "buyers").repartition("entity", F.year(F.timestamp_seconds("update_time"))).write.partitionBy("entity").json(path)
    d = files.read_order_books(t.spark, path, multi_line=False)
    return d.select("entity", "side", "name", "amount", rnd("price", 4).alias("price"), F.to_date(F.timestamp_seconds("time")).alias("day"))


@query("s3_read_event_counts", with_("SELECT entity, date, category, n FROM counts"))
def s3(t):
    path = scratch(t.spark, "counts")
    docs = t.counts.groupBy("entity", "date").agg(F.collect_list(F.struct("category", "n")).alias("entries"))
    docs.repartition("date", F.col("entity") % 2).write.partitionBy("date").json(path)
    return files.read_event_counts(t.spark, path, multi_line=False)


@query("s4_read_csv_typed", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_totalprice FROM orders")
def s4(t):
    path = scratch(t.spark, "csv")
    K.write_text_table(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority", "o_totalprice"), path)
    return files.read_csv_typed(t.spark, path, "o_orderkey long, o_orderdate date, o_orderpriority string, o_totalprice double")


@query("s5_read_tsv_headerless", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def s5(t):
    path = scratch(t.spark, "tsv")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("sep", "\t").csv(path)
    return files.read_tsv_headerless(t.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")


@query("s6_read_csv_gz", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s6(t):
    path = scratch(t.spark, "gz")
    K.write_text_table(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path, gzip=True)
    return files.read_csv_gz(t.spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", partitions=8)


@query("s7_read_parquet_cols", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s7(t):
    return files.read_parquet_cols(t.spark, f"{t.path}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("s8_extract_embedded_series", with_(f"SELECT entity, date, {r('price', 4)} AS value FROM panel_m"))
def s8(t):
    """Monthly series embedded in a page per entity (one malformed label and one surplus value each)."""
    s = t.panel_m.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("a"))
    lab = F.to_json(F.concat(F.transform("a", lambda x: x["date"].cast("string")), F.array(F.lit("n/a"))))
    val = F.to_json(F.concat(F.transform("a", lambda x: x["price"]), F.array(F.lit(1.0), F.lit(2.0))))
    pages = s.select("entity", F.concat(F.lit("<html><script>const dataAll = {labels:"), lab, F.lit(", values:"), val, F.lit("};</script></html>")).alias("html"))
    return T.embedded_series(pages, "entity", "html", "dataAll").select("entity", "date", rnd("value", 4).alias("value"))


@query("s9_extract_html_cells", """
SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, hrefs[pos] AS c_0, labels[pos] AS c_1 FROM
 (SELECT page_id, hrefs, labels, unnest(range(1, len(hrefs) + 1)) AS pos FROM
  (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels FROM pages))""")
def s9(t):
    return T.html_cells(t.pages, "page_id", "html", r'<li><a href="([^"]*)">([^<]*)</a></li>')


@query("s10_choose_block", """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT doc_id, pos - 1 AS pos, parts[pos] AS block FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM l)),
s AS (SELECT doc_id, pos, CAST(len(regexp_extract_all(block, '[,.]')) AS BIGINT) AS samples FROM e WHERE length(block) > 0)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, samples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (samples >= 12) DESC,
  CASE WHEN samples >= 12 THEN pos END, samples DESC, pos) AS rn FROM s) WHERE rn = 1""")
def s10(t):
    d = T.kv_blocks(t.documents.select("doc_id", "text"), "doc_id", "text", "[,.]", 12)
    return d.where("chosen").select("doc_id", "pos", "samples")


@query("s10b_parse_kv_lines", """
SELECT p_partkey, p_name AS name, CAST(p_partkey % 90 + 1 AS DOUBLE) AS times, CAST(p_size AS DOUBLE) AS amount_lo, CAST(p_size + 5 AS DOUBLE) AS amount_hi,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 90 + 1 + p_size AS DOUBLE) END AS total FROM part""")
def s10b(t):
    s = lambda c: c.cast("string")
    times, size = F.col("p_partkey") % 90 + 1, F.col("p_size")
    amt = F.concat(F.lit("amount:"), s(size), F.lit("-"), s(size + 5))
    tim = F.concat(F.lit("times:"), s(times))
    tot = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("total:"), s(times + size)))
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(", ", "p_name", amt, tim, tot)).otherwise(F.concat_ws(", ", "p_name", tim, amt, tot))
    return t.part.select("p_partkey", line.alias("line")).select("p_partkey", *T.kv_row(F.col("line")))


@query("s11_census_from_counts", with_("SELECT entity, category, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1, 2"))
def s11(t):
    pages = t.counts.groupBy("entity", "date").agg(F.to_json(F.collect_list(F.struct("category", "n"))).alias("doc"))
    return T.census(pages, "entity", F.from_json("doc", "array<struct<category: string, n: long>>"))


@query("s12_ingest_manifest", """
SELECT event_type AS source, count(*) AS rows, max(ts) AS last_run, arg_max(props, ts) AS status FROM events GROUP BY 1""")
def s12(t):
    return files.ingest_manifest(t.events.withColumnRenamed("event_type", "source"), "source", "ts", "props")


@query("s13_null_share_profile", f"""
SELECT 'l_tax' AS column_name, {r("avg(CAST(l_tax = 0 AS INT))")} AS null_share FROM lineitem UNION ALL
SELECT 'l_discount', {r("avg(CAST(l_discount = 0 AS INT))")} FROM lineitem UNION ALL SELECT 'l_quantity', {r("avg(CAST(l_quantity = 0 AS INT))")} FROM lineitem""")
def s13(t):
    return files.null_share_profile(t.lineitem, ["l_tax", "l_discount", "l_quantity"], 0.0).select("column_name", rnd("null_share").alias("null_share"))


# ------------------------------------------------------------------ sinks and incremental tables


@query("k1_write_table", with_(f"SELECT entity, date, {r('price', 4)} AS price, CAST(year(date) AS INTEGER) AS year FROM panel"))
def k1(t):
    path = scratch(t.spark, "panel")
    K.write_parquet(t.panel.withColumn("year", F.year("date")).repartition("year", F.month("date") % 3), path, ["year"])
    return t.spark.read.parquet(path).select("entity", "date", rnd("price", 4).alias("price"), F.col("year").cast("int").alias("year"))


@query("k2_append_history_keep_last", """
WITH u AS (SELECT user_id, date_trunc('hour', ts) AS cap, 0 AS ld, event_id, value FROM events WHERE event_id % 3 <> 0 UNION ALL
 SELECT user_id, date_trunc('hour', ts), 1, event_id, value + 1 FROM events WHERE event_id % 3 <> 1)
SELECT user_id, cap, arg_max(event_id, (ld, event_id)) AS event_id, round(arg_max(value, (ld, event_id)), 2) AS value FROM u GROUP BY 1, 2""")
def k2(t):
    e = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("cap"), "event_id", "value")
    new = e.where("event_id % 3 <> 1").withColumn("value", F.col("value") + 1)
    out = K.append_keep_last(e.where("event_id % 3 <> 0"), new, ["user_id", "cap"], ["event_id"])
    return out.select("user_id", "cap", "event_id", F.round("value", 2).alias("value"))


@query("k3_upsert_carry_forward", with_(f"""
SELECT entity, date, {r("CASE WHEN date >= DATE '2001-01-01' THEN price * 1.01 ELSE price END", 4)} AS price FROM panel WHERE date < DATE '2001-01-01' OR n > 0"""))
def k3(t):
    p = t.panel.select("entity", "date", "price")
    new = p.where("date >= '2001-01-01'").withColumn("price", F.col("price") * 1.01)
    return K.upsert(p, new, ["entity", "date"]).select("entity", "date", rnd("price", 4).alias("price"))


@query("k4_anti_load", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def k4(t):
    loaded = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.not_loaded(t.orders.select("o_orderkey", "o_custkey"), loaded, ["o_orderkey"])


def _blocks(t):
    p = t.panel.join(t.dim.select("entity", F.col("region").alias("block")), "entity")
    return p.groupBy("block", "entity").agg(F.avg("volume").alias("value"))


@query("k5_merge_metric_blocks", with_(f"""
SELECT region AS block, entity, {r("CASE WHEN region IN ('ASIA', 'EUROPE') THEN -avg(volume) ELSE avg(volume) END")} AS value FROM panel JOIN dim USING (entity)
WHERE NOT (region IN ('ASIA', 'EUROPE') AND entity % 2 = 0) GROUP BY 1, 2"""))
def k5(t):
    old = _blocks(t)
    new = old.where("block in ('ASIA', 'EUROPE') and entity % 2 <> 0").withColumn("value", -F.col("value"))
    return K.merge_blocks(old, new).select("block", "entity", rnd("value").alias("value"))


@query("k6_require_blocks", with_("""
SELECT r_name AS block FROM region WHERE r_name NOT IN (SELECT region FROM panel JOIN dim USING (entity) WHERE price > 8000 AND volume > 30)"""))
def k6(t):
    p = t.panel.where("price > 8000 and volume > 30").join(t.dim.select("entity", F.col("region").alias("block")), "entity")
    return Q.missing_blocks(p, t.region.select(F.col("r_name").alias("block")), "block")


@query("k7_require_columns", with_("SELECT entity, date, n FROM panel"))
def k7(t):
    return Q.require_columns(t.panel, {"entity": "int", "date": "date", "n": "bigint"})


@query("k8_export_mart", with_(f"SELECT entity, date, {r('price', 4)} AS price FROM panel WHERE date >= DATE '2001-01-01' AND n >= 2"))
def k8(t):
    return K.export_mart(t.panel, ["entity", "date", "price"], (F.col("date") >= "2001-01-01") & (F.col("n") >= 2)).select(
        "entity", "date", rnd("price", 4).alias("price"))


@query("k9_weekly_fallback_mart", with_("""
SELECT entity, CAST(date_trunc('week', date - 1) AS DATE) + 7 AS date, 'n' AS series, CAST(sum(n) AS DOUBLE) AS value FROM panel GROUP BY 1, 2 UNION ALL
SELECT entity, CAST(date_trunc('week', date - 1) AS DATE) + 7, 'volume', sum(volume) FROM panel GROUP BY 1, 2"""))
def k9(t):
    w = K.at_grain(t.panel, "week", ["entity"], "date", ["n", "volume"])
    return w.select("entity", "date", F.col("n").cast("double").alias("n"), "volume").unpivot(["entity", "date"], ["n", "volume"], "series", "value")


@query("k9b_daily_mart", with_("""
SELECT entity, date, 'n' AS series, CAST(n AS DOUBLE) AS value FROM panel UNION ALL SELECT entity, date, 'volume', volume FROM panel"""))
def k9b(t):
    w = K.at_grain(t.panel, "day", ["entity"], "date", ["n", "volume"])
    return w.select("entity", "date", F.col("n").cast("double").alias("n"), "volume").unpivot(["entity", "date"], ["n", "volume"], "series", "value")


# ------------------------------------------------------------------ quality


@query("q3_expectations", with_("""
SELECT 'unique key' AS "check", (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY entity, date HAVING count(*) > 1)) AS violations,
 (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY entity, date HAVING count(*) > 1)) = 0 AS passed UNION ALL
SELECT 'price positive', count(*) FILTER (NOT price > 0), count(*) FILTER (NOT price > 0) = 0 FROM panel UNION ALL
SELECT 'volume range', count(*) FILTER (NOT volume BETWEEN 1 AND 200), count(*) FILTER (NOT volume BETWEEN 1 AND 200) = 0 FROM panel UNION ALL
SELECT 'volume at least n', count(*) FILTER (NOT volume >= n), count(*) FILTER (NOT volume >= n) = 0 FROM panel UNION ALL
SELECT 'n small', count(*) FILTER (NOT n IN (1, 2, 3)), count(*) FILTER (NOT n IN (1, 2, 3)) = 0 FROM panel UNION ALL
SELECT 'full grid', (SELECT count(DISTINCT entity) * count(DISTINCT date) - count(*) FROM panel), (SELECT count(DISTINCT entity) * count(DISTINCT date) = count(*) FROM panel)"""))
def q3(t):
    c = F.col
    checks = Q.row_checks(t.panel, {
        "price positive": c("price") > 0, "volume range": c("volume").between(1, 200), "volume at least n": c("volume") >= c("n"), "n small": c("n").isin(1, 2, 3)})
    return Q.unique_key(t.panel, ["entity", "date"], "unique key").unionByName(checks).unionByName(Q.full_grid(t.panel, "entity", "date", "full grid"))


# forecasts of four rules; the published winner of every seventh entity and the bounds of every ninth carry a fault, which must show
define("fcl", """SELECT entity, date, y, unnest(['drift', 'naive', 'seasonal', 'zero']) AS model, unnest([drift, naive, seasonal, zero]) AS yhat FROM bl WHERE y IS NOT NULL""")
define("bnd", """SELECT entity, CASE WHEN entity % 9 = 4 THEN q75 ELSE q25 END AS lo50, CASE WHEN entity % 9 = 4 THEN q25 ELSE q75 END AS hi50, q05 AS lo90, q95 AS hi90 FROM
  (SELECT entity, quantile_cont(price, 0.05) AS q05, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75, quantile_cont(price, 0.95) AS q95 FROM panel GROUP BY 1)""")


def _forecasts(t):
    return baselines(t).where("y is not null").unpivot(["entity", "date", "y"], ["drift", "naive", "seasonal", "zero"], "model", "yhat")


@query("q3b_model_expectations", with_("""
SELECT 'matched n' AS "check", CAST(count(*) FILTER (lo <> hi OR k <> 4) AS BIGINT) AS violations, count(*) FILTER (lo <> hi OR k <> 4) = 0 AS passed FROM
  (SELECT entity, min(n) AS lo, max(n) AS hi, count(*) AS k FROM (SELECT entity, model, count(*) AS n FROM fcl WHERE yhat IS NOT NULL GROUP BY 1, 2) GROUP BY 1) UNION ALL
SELECT 'matched n, complete rows', count(*) FILTER (lo <> hi), count(*) FILTER (lo <> hi) = 0 FROM
  (SELECT entity, min(n) AS lo, max(n) AS hi FROM (SELECT entity, model, count(*) AS n FROM fcl JOIN bl USING (entity, date) WHERE drift IS NOT NULL AND naive IS NOT NULL AND seasonal IS NOT NULL GROUP BY 1, 2) GROUP BY 1) UNION ALL
SELECT 'finite', count(*) FILTER (yhat IS NULL OR NOT isfinite(yhat)), count(*) FILTER (yhat IS NULL OR NOT isfinite(yhat)) = 0 FROM fcl UNION ALL
SELECT 'interval order', count(*) FILTER (NOT (lo90 <= lo50 AND lo50 <= hi50 AND hi50 <= hi90)), count(*) FILTER (NOT (lo90 <= lo50 AND lo50 <= hi50 AND hi50 <= hi90)) = 0 FROM bnd"""))
def q3b(t):
    """Forecasts on equal samples, finite, and bounds in order."""
    from gridloom.operators.quantiles import quantile_wide
    p, full = _forecasts(t), baselines(t).where("y is not null and drift is not null and naive is not null and seasonal is not null")
    full = full.unpivot(["entity", "date", "y"], ["drift", "naive", "seasonal", "zero"], "model", "yhat")
    q = quantile_wide(t.panel, "price", {"lo90": 0.05, "lo50": 0.25, "hi50": 0.75, "hi90": 0.95}, ["entity"])
    bad = F.col("entity") % 9 == 4
    q = q.select("lo90", F.when(bad, F.col("hi50")).otherwise(F.col("lo50")).alias("lo50"), F.when(bad, F.col("lo50")).otherwise(F.col("hi50")).alias("hi50"), "hi90")
    return (G.matched_n(p, "model", ["entity"], "y", "yhat").unionByName(G.matched_n(full, "model", ["entity"], "y", "yhat", "matched n, complete rows"))
            .unionByName(G.finite_values(p, ["yhat"])).unionByName(G.ordered_bounds(q, ["lo90", "lo50", "hi50", "hi90"])))


@query("q4b_winner_recomputed", with_("""
WITH e AS (SELECT entity, model, round(sqrt(avg(pow(y - yhat, 2))), 9) AS e FROM fcl WHERE yhat IS NOT NULL GROUP BY 1, 2), w AS (SELECT entity, arg_min(model, (e, model)) AS best FROM e GROUP BY 1)
SELECT entity, CASE WHEN entity % 7 = 3 THEN 'naive' ELSE best END AS published, best AS recomputed, CASE WHEN entity % 7 = 3 THEN 'naive' ELSE best END = best AS agrees FROM w""").replace("\nWITH e AS", ",\ne AS"))
def q4b(t):
    """The published winner of each entity against the one its predictions give."""
    p = _forecasts(t)
    e = p.where("yhat is not null").groupBy("entity", "model").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), F.lit(2)))).alias("e"))
    pub = e.groupBy("entity").agg(F.min_by("model", F.struct(F.round("e", 9), "model")).alias("model"))
    pub = pub.withColumn("model", F.when(F.col("entity") % 7 == 3, "naive").otherwise(F.col("model")))
    return G.winners(pub, p, ["entity"], "model", "y", "yhat")


@query("q4_recompute_reconcile", with_(f"""
SELECT entity, entity % 7 <> 3 AS agrees, {r("sqrt(avg(ret * ret))")} AS recomputed FROM pr WHERE ret IS NOT NULL GROUP BY 1"""))
def q4(t):
    """Published errors against recomputed ones; the published table carries a fault of 1 % in every seventh entity, which must show."""
    from gridloom.operators.evaluation import recompute_agreement
    d = t.pr.where("ret is not null")
    pub = d.groupBy("entity").agg((F.sqrt(F.avg(F.col("ret") ** 2)) * F.when(F.col("entity") % 7 == 3, 1.01).otherwise(1.0)).alias("rmse"))
    again = d.groupBy("entity").agg(F.sqrt(F.var_pop("ret") + F.avg("ret") ** 2).alias("rmse"))
    return recompute_agreement(pub, again, ["entity"], "rmse", 1e-9).select("entity", "agrees", rnd("recomputed").alias("recomputed"))


@query("q5_cross_table_agreement", with_("""
SELECT fact, CAST(count(*) AS BIGINT) AS sources, CAST(max(v) - min(v) AS BIGINT) AS spread, max(v) = min(v) AS agrees FROM (
 SELECT 'order count' AS fact, count(*) AS v FROM orders UNION ALL SELECT 'order count', sum(n_orders) FROM calendar UNION ALL
 SELECT 'line count', count(*) FROM lineitem UNION ALL SELECT 'line count', sum(n) FROM panel UNION ALL
 SELECT 'orders with lines', count(*) FROM orders UNION ALL SELECT 'orders with lines', count(DISTINCT l_orderkey) FROM lineitem) GROUP BY 1"""))
def q5(t):
    def fact(name, src, df, e):
        return df.agg(e.alias("value")).select(F.lit(name).alias("fact"), F.lit(src).alias("source"), F.col("value").cast("long"))

    u = (fact("order count", "orders", t.orders, F.count("*")).unionByName(fact("order count", "calendar", t.calendar, F.sum("n_orders")))
         .unionByName(fact("line count", "lineitem", t.lineitem, F.count("*"))).unionByName(fact("line count", "panel", t.panel, F.sum("n")))
         .unionByName(fact("orders with lines", "orders", t.orders, F.count("*"))).unionByName(fact("orders with lines", "lineitem", t.lineitem, F.countDistinct("l_orderkey"))))
    return Q.agreement(u, "fact", "value", 0)


# a copy of the orders that misses one row in the first month, states another price in the second, swaps two prices in the third
_COPY = """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice FROM orders"""
define("oc0", _COPY)
define("ocm", "SELECT month, min(o_orderkey) AS k1, max(o_orderkey) AS k2, row_number() OVER (ORDER BY month) AS i FROM oc0 GROUP BY 1")
define("occ", """SELECT o.o_orderkey, o.month, CASE WHEN i = 2 AND o.o_orderkey = k1 THEN o.o_totalprice + 1 WHEN i = 3 AND o.o_orderkey = k1 THEN b.o_totalprice WHEN i = 3 AND o.o_orderkey = k2 THEN a.o_totalprice ELSE o.o_totalprice END AS o_totalprice
FROM oc0 o JOIN ocm m ON o.month = m.month JOIN oc0 a ON a.o_orderkey = k1 JOIN oc0 b ON b.o_orderkey = k2 WHERE NOT (i = 1 AND o.o_orderkey = k1)""")


@query("q5b_row_sets", with_("""
WITH l AS (SELECT month, o_orderkey, o_totalprice, count(*) AS n FROM oc0 GROUP BY ALL), r AS (SELECT month, o_orderkey, o_totalprice, count(*) AS n FROM occ GROUP BY ALL),
x AS (SELECT month, count(*) AS bad FROM (SELECT coalesce(l.month, r.month) AS month, l.n AS a, r.n AS b FROM l FULL JOIN r USING (month, o_orderkey, o_totalprice)) WHERE a IS DISTINCT FROM b GROUP BY 1)
SELECT m.month, (SELECT count(*) FROM oc0 WHERE oc0.month = m.month) AS rows_left, (SELECT count(*) FROM occ WHERE occ.month = m.month) AS rows_right, coalesce(bad, 0) = 0 AS equal FROM ocm m LEFT JOIN x USING (month)""").replace("\nWITH l AS", ",\nl AS"))
def q5b(t):
    """Months in which two copies of a table hold the same rows, by fingerprints; planted faults must show."""
    from gridloom.operators.joins import enrich
    left = t.orders.select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), "o_totalprice")
    m = left.groupBy("month").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("a"), F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("b"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("month")))  # a row per month
    c = F.col
    first, last = c("o_orderkey") == c("a.o_orderkey"), c("o_orderkey") == c("b.o_orderkey")
    right = enrich(left, m, ["month"], spread="o_orderkey").where(~((c("i") == 1) & first))
    price = F.when((c("i") == 2) & first, c("o_totalprice") + 1).when((c("i") == 3) & first, c("b.o_totalprice")).when((c("i") == 3) & last, c("a.o_totalprice")).otherwise(c("o_totalprice"))
    return G.same_rows(left, right.select("o_orderkey", "month", price.alias("o_totalprice")), ["o_orderkey", "o_totalprice"], ["month"])


@query("q5c_key_sets", with_("""
SELECT 'orders, lines' AS tables, (SELECT count(*) FROM orders) AS rows_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS rows_right,
  NOT EXISTS (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) AND NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AS equal UNION ALL
SELECT 'days, calendar', (SELECT count(DISTINCT date) FROM panel), (SELECT count(*) FROM calendar), NOT EXISTS (SELECT date FROM panel EXCEPT SELECT date FROM calendar) AND NOT EXISTS (SELECT date FROM calendar EXCEPT SELECT date FROM panel) UNION ALL
SELECT 'entities, dim', (SELECT count(DISTINCT entity) FROM panel), (SELECT count(*) FROM dim), NOT EXISTS (SELECT entity FROM panel EXCEPT SELECT entity FROM dim) AND NOT EXISTS (SELECT entity FROM dim EXCEPT SELECT entity FROM panel)"""))
def q5c(t):
    """Whether two tables hold the same keys, by fingerprints of the distinct keys."""
    pairs = [("orders, lines", t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))),
             ("days, calendar", t.panel.select(F.col("date").alias("k")), t.calendar.select(F.col("date").alias("k"))), ("entities, dim", t.panel.select(F.col("entity").alias("k")), t.dim.select(F.col("entity").alias("k")))]
    out = None
    for name, a, b in pairs:
        one = G.same_keys(a, b, ["k"]).select(F.lit(name).alias("tables"), "rows_left", "rows_right", "equal")
        out = one if out is None else out.unionByName(one)
    return out


@query("q6_freshness", """
WITH g AS (SELECT c_nationkey AS source, max(CAST(o_orderdate AS DATE)) AS latest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT source, latest, (SELECT max(latest) FROM g) - latest AS age_days, (SELECT max(latest) FROM g) - latest > 7 AS stale FROM g""")
def q6(t):
    from gridloom.operators.joins import enrich
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    d = enrich(t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d")), c, ["o_custkey"], "inner", spread="o_orderkey")
    return Q.freshness(d, "source", "d", 7)


define("stp", "SELECT c_nationkey AS source, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")


def _stamps(t):
    from gridloom.operators.joins import enrich
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    return enrich(t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d")), c, ["o_custkey"], "inner", spread="o_orderkey")


@query("q6b_stale_majority", with_("""
WITH g AS (SELECT source, max(d) AS latest FROM stp GROUP BY 1), n AS (SELECT days, (SELECT max(d) FROM stp) + days AS now FROM (SELECT unnest([0, 5, 9]) AS days))
SELECT CAST(days AS BIGINT) AS days_later, count(*) AS sources, CAST(count(*) FILTER (now - latest > 7) AS BIGINT) AS stale, CAST(quantile_cont(now - latest, 0.5) AS DOUBLE) AS median_age, count(*) FILTER (now - latest > 7) * 2 <= count(*) AS passed FROM g, n GROUP BY 1""").replace("\nWITH g AS", ",\ng AS"))
def q6b(t):
    """Whether most sources are stale on the last day, five days and nine days later."""
    s = _stamps(t)
    out = None
    for days in (0, 5, 9):
        now = F.date_add(s.agg(F.max("d").alias("last")).scalar(), days)
        one = G.stale_majority(s, "source", "d", now, 7).select(F.lit(days).cast("long").alias("days_later"), "sources", "stale", "median_age", "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query("q6c_torn_snapshots", with_("""
WITH p AS (SELECT CAST(date_trunc('month', d) AS DATE) AS snapshot, source, max(d) AS stamp FROM stp GROUP BY 1, 2), g AS (SELECT snapshot, count(*) AS parts, min(stamp) AS first_part, max(stamp) AS last_part FROM p GROUP BY 1)
SELECT snapshot, parts, first_part, last_part, CASE WHEN month(snapshot) % 4 = 1 THEN first_part ELSE last_part END AS built, month(snapshot) % 4 = 1 AND first_part < last_part AS torn FROM g""").replace("\nWITH p AS", ",\np AS"))
def q6c(t):
    """Monthly snapshots of many sources; every fourth was built when its first source had arrived, which must show."""
    p = _stamps(t).groupBy(F.to_date(F.date_trunc("month", "d")).alias("snapshot"), "source").agg(F.max("d").alias("stamp"))
    built = p.groupBy("snapshot").agg(F.min("stamp").alias("lo"), F.max("stamp").alias("hi")).select("snapshot", F.when(F.month("snapshot") % 4 == 1, F.col("lo")).otherwise(F.col("hi")).alias("built"))
    return G.torn_snapshots(p, "snapshot", "stamp", built, "built")


@query("q6d_panel_end", with_("""
SELECT (SELECT max(date) FROM panel) AS panel_end, (SELECT max(date) FROM lines) AS source_end, CAST((SELECT max(date) FROM lines) - (SELECT max(date) FROM panel) AS BIGINT) AS days_behind, (SELECT max(date) FROM lines) - (SELECT max(date) FROM panel) <= 1 AS passed UNION ALL
SELECT (SELECT max(date) FROM panel_m), (SELECT max(date) FROM lines), CAST((SELECT max(date) FROM lines) - (SELECT max(date) FROM panel_m) AS BIGINT), (SELECT max(date) FROM lines) - (SELECT max(date) FROM panel_m) <= 1"""))
def q6d(t):
    """Whether a panel reaches the last day of its source: the daily one, and the monthly one, whose dates stop at the month's start."""
    return G.end_against_source(t.panel, "date", t.lines, "date").unionByName(G.end_against_source(t.panel_m, "date", t.lines, "date"))


@query("q7b_exact_ratio", with_("""
SELECT 'dollars to cents' AS "check", CAST(count(*) FILTER (abs(round(l_extendedprice * 100) - l_extendedprice * 100) > 1e-9 * greatest(abs(l_extendedprice * 100), 1)) AS BIGINT) AS violations,
  count(*) FILTER (abs(round(l_extendedprice * 100) - l_extendedprice * 100) > 1e-9 * greatest(abs(l_extendedprice * 100), 1)) = 0 AS passed FROM lineitem UNION ALL
SELECT 'scaled twice', count(*) FILTER (l_quantity * CASE WHEN l_linenumber = 1 THEN 625 ELSE 25 END <> l_quantity * 25), count(*) FILTER (l_quantity * CASE WHEN l_linenumber = 1 THEN 625 ELSE 25 END <> l_quantity * 25) = 0 FROM lineitem"""))
def q7b(t):
    """Converted units against their source; the second copy scales first lines twice, which must show."""
    c = F.col
    d = t.lineitem.select(c("l_extendedprice").cast("double").alias("price"), F.round(c("l_extendedprice").cast("double") * 100).alias("cents"), c("l_quantity").cast("double").alias("lots"),
                          (c("l_quantity").cast("double") * F.when(c("l_linenumber") == 1, 625).otherwise(25)).alias("units"))
    return G.exact_ratio(d, "cents", "price", 100.0, name="dollars to cents").unionByName(G.exact_ratio(d, "units", "lots", 25.0, name="scaled twice"))


@query("q7_unit_check", with_("""
SELECT 'whole units' AS "check", count(*) FILTER (l_quantity <> round(l_quantity)) AS violations, count(*) FILTER (l_quantity <> round(l_quantity)) = 0 AS passed FROM lineitem UNION ALL
SELECT 'multiple of lot', count(*) FILTER (CAST(l_quantity AS BIGINT) % 5 <> 0), count(*) FILTER (CAST(l_quantity AS BIGINT) % 5 <> 0) = 0 FROM lineitem"""))
def q7(t):
    q = F.col("l_quantity")
    return Q.row_checks(t.lineitem, {"whole units": q == F.round(q), "multiple of lot": q.cast("long") % 5 == 0})


@query("q8_eligibility", with_("""
SELECT entity, count(*) AS n, count(*) >= 1400 AND kind = 'open' AND min(date) - created >= 60 AS converged FROM panel JOIN dim USING (entity) GROUP BY entity, kind, created"""))
def q8(t):
    g = t.panel.groupBy("entity").agg(F.count("*").alias("n"), F.min("date").alias("first"))
    d = g.join(t.dim.select("entity", "kind", "created"), "entity")
    ok = (F.col("n") >= 1400) & (F.col("kind") == "open") & (F.datediff("first", "created") >= 60)
    return d.select("entity", "n", ok.alias("converged"))


@query("q9_audit_counters", with_("""
SELECT 'input' AS step, count(*) AS rows FROM sides UNION ALL SELECT 'has sell', count(*) FILTER (sell_price IS NOT NULL) FROM sides UNION ALL
SELECT 'has buy', count(*) FILTER (sell_price IS NOT NULL AND buy_price IS NOT NULL) FROM sides UNION ALL
SELECT 'in band', count(*) FILTER (sell_price / buy_price BETWEEN 0.5 AND 2) FROM sides"""))
def q9(t):
    c = F.col
    return Q.audit(t.sides, [("has sell", c("sell_price").isNotNull()), ("has buy", c("buy_price").isNotNull()),
                             ("in band", (c("sell_price") / c("buy_price")).between(0.5, 2.0))])
