"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import cents, div, rnd
from gridloom.operators import aggs as A, joins as J, quantiles as Q
from gridloom.registry import query
from gridloom.sqltext import r, with_


@query("a1_entity_summary", with_(f"""
SELECT entity, count(*) AS n, {r("arg_min(price, date)", 4)} AS px_first, {r("arg_max(price, date)", 4)} AS px_last,
 {r("quantile_cont(price, 0.5)", 4)} AS px_median, {r("min(price)", 4)} AS px_min, {r("max(price)", 4)} AS px_max,
 {r("stddev(ret)")} AS ret_sd, {r("quantile_cont(volume, 0.5)", 2)} AS volume_median FROM pr GROUP BY 1"""))
def a1(t):
    d = A.entity_summary(t.pr, "price", "ret", "volume")
    return d.select("entity", "n", *[rnd(c, 4).alias(c) for c in ("px_first", "px_last", "px_median", "px_min", "px_max")],
                    rnd("ret_sd").alias("ret_sd"), rnd("volume_median", 2).alias("volume_median"))


@query("a2_last_row_per_key", """
SELECT user_id, CAST(ts AS DATE) AS date, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
 arg_max(value, (ts, event_id)) FILTER (event_type <> 'error') AS last_ok_value FROM events GROUP BY 1, 2""")
def a2(t):
    e = t.events.select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", "event_type",
                        F.when(F.col("event_type") != "error", F.col("value")).alias("last_ok_value"))
    keys, order = ["user_id", "date"], ["ts", "event_id"]
    last = A.last_row(e.drop("last_ok_value"), keys, order).select(*keys, "event_id", "event_type")
    return last.join(A.last_non_null(e, keys, order, ["last_ok_value"]), keys)


@query("a3_two_level_count", with_("""
SELECT entity, count(DISTINCT date) AS days, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS busy_days FROM
 (SELECT entity, date, sum(n) AS n FROM counts GROUP BY 1, 2) GROUP BY 1"""))
def a3(t):
    d = t.counts.groupBy("entity", "date").agg(F.sum("n").alias("n"))
    return d.groupBy("entity").agg(F.count("*").alias("days"), F.sum((F.col("n") > 1).cast("long")).alias("busy_days"))


@query("a4_period_aggregates", with_(f"""
SELECT entity, {r("avg(volume) FILTER (date > (SELECT max(date) FROM panel) - 365)")} AS year_mean,
 {r("avg(volume) FILTER (date > (SELECT max(date) FROM panel) - 90)")} AS quarter_mean, {r("avg(volume)")} AS all_mean FROM panel GROUP BY 1"""))
def a4(t):
    p = J.with_scalars(t.panel, t.panel.agg(F.max("date").alias("end")))
    last = lambda k: F.avg(F.when(F.col("date") > F.date_sub(F.col("s.end"), k), F.col("volume")))
    return p.groupBy("entity").agg(rnd(last(365)).alias("year_mean"), rnd(last(90)).alias("quarter_mean"),
                                   rnd(F.avg("volume")).alias("all_mean"))


@query("a5_coverage_by_year", with_(f"""
SELECT year(date) AS year, sum(k)::BIGINT AS cells, {r("quantile_cont(k, 0.5)", 2)} AS median_entities, min(k) AS min_entities
FROM (SELECT date, count(DISTINCT entity) AS k FROM panel GROUP BY 1) GROUP BY 1"""))
def a5(t):
    d = t.panel.groupBy("date").agg(F.count("*").alias("k"))
    return d.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.sum("k").alias("cells"), rnd(F.percentile("k", F.lit(0.5)), 2).alias("median_entities"), F.min("k").alias("min_entities"))


@query("a6_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def a6(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_orderpriority").limit(3)


@query("a7_net_flow", """
WITH f AS (SELECT c_nationkey AS o, s_nationkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT coalesce(a.d, b.o) AS entity, coalesce(i, 0) AS inflow, coalesce(q, 0) AS outflow, coalesce(i, 0) - coalesce(q, 0) AS net
FROM (SELECT d, count(*) AS i FROM f GROUP BY 1) a FULL JOIN (SELECT o, count(*) AS q FROM f GROUP BY 1) b ON a.d = b.o""")
def a7(t):
    # combined per order before the join, so a repeated order key does not travel row by row
    li = t.lines.groupBy("l_orderkey", F.col("entity").alias("destination")).agg(F.count("*").alias("moves"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin"))
    oc = J.enrich(o, c, ["o_custkey"], "inner", spread="l_orderkey")
    return A.net_flow(li.join(oc, "l_orderkey"), "origin", "destination", "moves")


@query("a8_weighted_stats", f"""
WITH g AS (SELECT l_returnflag, l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM g)
SELECT l_returnflag, {r("sum(v * w) / sum(w)")} AS w_mean, {r("min(v) FILTER (cum * 2 >= tot)")} AS w_median,
  CAST(sum(CASE WHEN v >= 40 THEN w ELSE 0 END) AS BIGINT) AS w_above FROM c GROUP BY 1""")
def a8(t):
    d = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("lines"))
    return A.weighted_stats(d, ["l_returnflag"], "l_quantity", "lines", 40).select(
        "l_returnflag", rnd("w_mean").alias("w_mean"), rnd("w_median").alias("w_median"), "w_above")


@query("a9_concentration", with_(f"""
SELECT entity, date, {r("sum(s * s)")} AS hhi, {r("sum(s) FILTER (rk <= 2)")} AS top_share, count(*) AS n_categories FROM
 (SELECT entity, date, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity, date) AS s,
   row_number() OVER (PARTITION BY entity, date ORDER BY n DESC, category) AS rk FROM counts) GROUP BY 1, 2"""))
def a9(t):
    return A.concentration(t.counts, ["entity", "date"], "n", 2).select(
        "entity", "date", rnd("hhi").alias("hhi"), rnd("top_share").alias("top_share"), "n_categories")


@query("a10_global_topk_mix", with_(f"""
SELECT entity, date, category, {r("share")} AS share FROM (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity, date) AS share FROM counts)
WHERE category IN (SELECT category FROM counts GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 3)"""))
def a10(t):
    return A.category_mix(t.counts, ["entity", "date"], "category", "n", 3).select("entity", "date", "category", rnd("share").alias("share"))


@query("a11_argmax_attribute", with_(f"""
SELECT entity, arg_max(category, (value_cents, category)) AS top_category, {r("max(value_cents) / 100.0", 2)} AS top_value FROM
 (SELECT entity, category, sum(value_cents)::BIGINT AS value_cents FROM counts GROUP BY 1, 2) GROUP BY 1"""))
def a11(t):
    g = t.counts.groupBy("entity", "category").agg(F.sum("value_cents").alias("v"))
    return g.groupBy("entity").agg(F.max_by("category", F.struct("v", "category")).alias("top_category"),
                                   rnd(F.max("v") / 100.0, 2).alias("top_value"))


@query("a12_set_union_rollup", with_("""
SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, bool_or(p_size > 48) AS any_large, min(CAST(l_shipdate AS DATE)) AS first_seen,
 max(CAST(l_shipdate AS DATE)) AS last_seen, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""))
def a12(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    d = J.enrich(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date")), p, ["l_partkey"], "inner", spread="l_orderkey")
    return d.groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"), F.bool_or(F.col("p_size") > 48).alias("any_large"),
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a13_quantile_set", with_(f"""
SELECT CAST(p AS DOUBLE) AS prob, {r("quantile_cont(price, p)", 4)} AS q FROM panel, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS p) GROUP BY p"""
    .replace("quantile_cont(price, p)", "CASE p " + " ".join(f"WHEN {x} THEN quantile_cont(price, {x})" for x in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + " END")))
def a13(t):
    q = Q.exact_quantiles(t.panel, "price", [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])
    return q.select("prob", rnd("q", 4).alias("q"))


def qbin_sql(src: str, value: str, k: int, out: str = "bin") -> str:
    """Right-closed quantile bins with the lowest value included and duplicate edges dropped."""
    edges = ", ".join(f"quantile_cont({value}, {i / k!r})" for i in range(k + 1))
    return (f"SELECT s.*, CASE WHEN s.{value} IS NOT NULL THEN greatest(len(list_filter(e.edges, lambda x: x < s.{value})), 1) END AS {out} "
            f"FROM {src} s, (SELECT list_distinct([{edges}]) AS edges FROM {src}) e")


@query("a14_quantile_bins", with_(f"""
SELECT bin, count(*) AS n, {r("avg(volume)")} AS mean_volume, {r("min(volume)")} AS lo, {r("max(volume)")} AS hi FROM binned GROUP BY 1""",
    ("binned", qbin_sql("panel", "volume", 10))))
def a14(t):
    d = Q.quantile_bins(t.panel, "volume", 10, "bin")
    return d.groupBy("bin").agg(F.count("*").alias("n"), rnd(F.avg("volume")).alias("mean_volume"),
                                rnd(F.min("volume")).alias("lo"), rnd(F.max("volume")).alias("hi"))


@query("a15_resample_weekly", with_(f"""
SELECT entity, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, {r("avg(dev)")} AS dev_w, count(*) AS n FROM dev GROUP BY 1, 2"""))
def a15(t):
    return t.dev.groupBy("entity", F.date_add(F.date_trunc("week", "date").cast("date"), 6).alias("week_end")).agg(
        rnd(F.avg("dev")).alias("dev_w"), F.count("*").alias("n"))


@query("a16_age_buckets", with_(f"""
SELECT CAST(floor((date - created) / 10.0) * 10 AS BIGINT) AS bucket, {r("quantile_cont(price, 0.5)", 4)} AS median_price, count(*) AS n
FROM panel JOIN dim USING (entity) WHERE date - created BETWEEN 0 AND 400 GROUP BY 1"""))
def a16(t):
    d = t.panel.join(t.dim.select("entity", "created"), "entity").withColumn("age", F.datediff("date", "created"))
    return d.where("age between 0 and 400").groupBy((F.floor(F.col("age") / 10) * 10).alias("bucket")).agg(
        rnd(F.percentile("price", F.lit(0.5)), 4).alias("median_price"), F.count("*").alias("n"))


@query("a17_time_to_threshold", with_(f"""
SELECT entity, min(date) FILTER (abs(dev) < 0.01) - min(date) AS days_to, {r("arg_min(price, date)", 4)} AS first_price
FROM dev GROUP BY 1 HAVING min(date) FILTER (abs(dev) < 0.01) IS NOT NULL"""))
def a17(t):
    hit = F.min(F.when(F.abs("dev") < 0.01, F.col("date")))
    return t.dev.groupBy("entity").agg(F.datediff(hit, F.min("date")).cast("long").alias("days_to"),
                                       rnd(F.min_by("price", "date"), 4).alias("first_price")).where("days_to is not null")


@query("a18_diurnal_profile", with_(f"""
WITH rel AS (SELECT category, (hour(hour_ts) + 22) % 24 AS h, value / avg(value) OVER (PARTITION BY category) AS rel FROM hourly),
g AS (SELECT category, h, avg(rel) AS m FROM rel GROUP BY 1, 2)
SELECT category, arg_max(h, (round(m * 1e9), h)) AS peak_hour, arg_min(h, (round(m * 1e9), h)) AS trough_hour, {r("max(m)")} AS peak, {r("min(m)")} AS trough,
 {r("1 / (avg(m) FILTER (h BETWEEN 8 AND 9))")} AS bias_factor FROM g GROUP BY 1""".replace("WITH rel AS", "WITH rel AS", 1)).replace("\nWITH rel AS", ",\nrel AS"))
def a18(t):
    w = Window.partitionBy("category")
    rel = t.hourly.select("category", F.pmod(F.hour("hour_ts") - 2, F.lit(24)).cast("long").alias("h"),
                          (F.col("value") / F.avg("value").over(w)).alias("rel"))
    g = rel.groupBy("category", "h").agg(F.avg("rel").alias("m")).withColumn("k", F.struct(F.round(F.col("m") * 1e9), "h"))
    return g.groupBy("category").agg(
        F.max_by("h", "k").alias("peak_hour"), F.min_by("h", "k").alias("trough_hour"), rnd(F.max("m")).alias("peak"),
        rnd(F.min("m")).alias("trough"), rnd(1 / F.avg(F.when(F.col("h").between(8, 9), F.col("m")))).alias("bias_factor"))


@query("a19_seasonality_table", with_(f"""
SELECT isodow(date) - 1 AS dow, count(ret) AS n, {r("avg(ret)")} AS mean, {r("stddev(ret)")} AS sd,
 {r("avg(ret) / (stddev(ret) / sqrt(count(ret)))", 5)} AS t FROM pr GROUP BY 1"""))
def a19(t):
    return t.pr.groupBy(F.weekday("date").cast("long").alias("dow")).agg(
        F.count("ret").alias("n"), rnd(F.avg("ret")).alias("mean"), rnd(F.stddev("ret")).alias("sd"),
        rnd(F.avg("ret") / (F.stddev("ret") / F.sqrt(F.count("ret"))), 5).alias("t"))


def rank_sql(src, value, part=""):
    p = f"PARTITION BY {part}" if part else ""
    pv = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return f"(rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({pv}) - 1) / 2.0)"


@query("a21_spearman", with_(f"""
SELECT {r("corr(rx, ry)")} AS rho, count(*) AS n FROM (SELECT {rank_sql('panel', 'price')} AS rx, {rank_sql('panel', 'volume')} AS ry FROM panel)"""))
def a21(t):
    return Q.spearman(t.panel, "price", "volume").select(rnd("rho").alias("rho"), "n")


@query("a22_multi_scope_metrics", with_(f"""
SELECT kind, region, count(*) AS n, {r("sqrt(avg(ret * ret))")} AS rmse, {r("avg(abs(ret))")} AS mae, CAST(grouping(kind, region) AS BIGINT) AS gid
FROM pr JOIN dim USING (entity) WHERE ret IS NOT NULL GROUP BY GROUPING SETS ((), (kind), (region), (kind, region))"""))
def a22(t):
    d = t.pr.where("ret is not null").join(t.dim.select("entity", "kind", "region"), "entity")
    return A.scoped(d, [[], ["kind"], ["region"], ["kind", "region"]], [
        F.count("*").alias("n"), rnd(F.sqrt(F.avg(F.col("ret") ** 2))).alias("rmse"),
        rnd(F.avg(F.abs("ret"))).alias("mae"), F.grouping_id("kind", "region").alias("gid")])


@query("a23_pivot_compare", with_(f"""
SELECT entity, {r("avg(price) FILTER (yr = 1996)", 4)} AS y1996, {r("avg(price) FILTER (yr = 2000)", 4)} AS y2000,
 {r("avg(price) FILTER (yr = 2000) - avg(price) FILTER (yr = 1996)", 4)} AS change FROM (SELECT *, year(date) AS yr FROM panel) GROUP BY 1"""))
def a23(t):
    d = t.panel.withColumn("yr", F.year("date")).where("yr in (1996, 2000)")
    p = d.groupBy("entity").pivot("yr", [1996, 2000]).agg(F.avg("price"))
    return p.select("entity", rnd("1996", 4).alias("y1996"), rnd("2000", 4).alias("y2000"), rnd(F.col("2000") - F.col("1996"), 4).alias("change"))


@query("a24_coverage_scaled_ratio", with_(f"""
SELECT year(date) AS year, {r("sum(volume) / (SELECT sum(n_orders) FROM calendar)")} AS naive_ratio,
 {r("sum(volume) / (count(DISTINCT date) / 365.25) / ((SELECT sum(n_orders) FROM calendar) / ((SELECT count(*) FROM calendar) / 365.25))")} AS scaled_ratio
FROM panel GROUP BY 1"""))
def a24(t):
    c = t.calendar.agg(F.sum("n_orders").alias("tot"), F.count("*").alias("days"))
    y = t.panel.groupBy(F.year("date").cast("long").alias("year")).agg(F.sum("volume").alias("v"), F.countDistinct("date").alias("d"))
    y = J.with_scalars(y, c)
    return y.select("year", rnd(F.col("v") / F.col("s.tot")).alias("naive_ratio"), rnd(
        F.col("v") / (F.col("d") / 365.25) / (F.col("s.tot") / (F.col("s.days") / 365.25))).alias("scaled_ratio"))


@query("a25_monthly_estimate", with_(f"""
SELECT year(date) AS year, month(date) AS month, {r("sum(n_orders) * m", 4)} AS estimate FROM calendar
JOIN (SELECT year(CAST(o_orderdate AS DATE)) AS y, avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS m FROM orders GROUP BY 1) ON y = year(date) GROUP BY 1, 2, m"""))
def a25(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg((F.avg(cents("o_totalprice")) / 100.0).alias("m"))
    g = t.calendar.groupBy(F.year("date").alias("y"), F.month("date").alias("month")).agg(F.sum("n_orders").alias("n"))
    return g.join(y, "y").select(F.col("y").cast("long").alias("year"), F.col("month").cast("long"), rnd(F.col("n") * F.col("m"), 4).alias("estimate"))


@query("a26_share_of_total", f"""
SELECT p_type, sum(q)::BIGINT AS total, {r("sum(q) / (SELECT sum(CAST(round(l_quantity) AS BIGINT)) FROM lineitem)")} AS share
FROM (SELECT p_type, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def a26(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    d = J.enrich(t.lines.select("l_orderkey", "l_partkey", "qty"), p, ["l_partkey"], "inner", spread="l_orderkey")
    return A.share_of_total(d, ["p_type"], "qty").select("p_type", "total", rnd("share").alias("share"))


@query("a27_breadth_dispersion", with_(f"""
SELECT date, count(*) AS n, {r("avg(CASE WHEN ret_row > 0 THEN 1.0 ELSE 0.0 END)")} AS breadth_up, {r("CASE WHEN count(*) >= 10 THEN stddev(logp) END")} AS dispersion FROM pr GROUP BY 1"""))
def a27(t):
    return t.pr.groupBy("date").agg(
        F.count("*").alias("n"), rnd(F.avg(F.when(F.col("ret_row") > 0, 1.0).otherwise(0.0))).alias("breadth_up"),
        rnd(F.when(F.count("*") >= 10, F.stddev("logp"))).alias("dispersion"))


@query("a28_pit_histogram", with_(f"""
WITH h AS (SELECT CAST(least(floor(round(pct * 10, 9)), 9) AS BIGINT) AS bin, count(*) AS n FROM pit GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n, {r("pow(coalesce(n, 0) - (SELECT count(*) FROM pit) / 10.0, 2) / ((SELECT count(*) FROM pit) / 10.0)", 5)} AS chi2_part
FROM (SELECT unnest(range(0, 10)) AS bin) b LEFT JOIN h ON h.bin = b.bin""", (
    "pit", f"SELECT ({rank_sql('dev', 'dev', 'date')} - 0.5) / count(*) OVER (PARTITION BY date) AS pct FROM dev WHERE dev.dev IS NOT NULL")).replace("\nWITH h AS", ",\nh AS"))
def a28(t):
    from gridloom.operators.evaluation import pit_histogram
    out = pit_histogram(_pit(t), "pct", 10)
    return out.select("bin", "n", rnd("chi2_part", 5).alias("chi2_part"))


def _pit(t):
    from gridloom.operators.joins import with_group
    from gridloom.operators.windows import cross_rank_pct
    d = cross_rank_pct(t.dev.where("dev is not null"), "dev", ["date"], "p")
    return with_group(d, ["date"], n_d=F.count("*")).select((F.col("p") - 0.5 / F.col("n_d")).alias("pct"))


@query("a28b_pit_summary", with_(f"""
SELECT count(*) AS n, {r('avg(pct)')} AS mean_percentile, {r('avg(CAST(pct BETWEEN 0.25 AND 0.75 AS INT))')} AS middle_half FROM pit""", (
    "pit", f"SELECT ({rank_sql('dev', 'dev', 'date')} - 0.5) / count(*) OVER (PARTITION BY date) AS pct FROM dev WHERE dev.dev IS NOT NULL")))
def a28b(t):
    from gridloom.operators.evaluation import pit_summary
    return pit_summary(_pit(t), "pct").select("n", rnd("mean_percentile").alias("mean_percentile"), rnd("middle_half").alias("middle_half"))


@query("a29_winner", with_(f"""
SELECT kind, arg_min(m, (round(rmse * 1e9), m)) AS winner, {r("min(rmse)")} AS best FROM (
 SELECT kind, 'zero' AS m, sqrt(avg(ret * ret)) AS rmse FROM p GROUP BY 1 UNION ALL
 SELECT kind, 'mean', stddev_pop(ret) FROM p GROUP BY 1 UNION ALL
 SELECT kind, 'naive', sqrt(avg(pow(ret - pr1, 2))) FROM p GROUP BY 1) GROUP BY 1""", (
    "p", "SELECT kind, ret, lag(ret) OVER (PARTITION BY entity ORDER BY date) AS pr1 FROM pr JOIN dim USING (entity)")))
def a29(t):
    from gridloom.operators.windows import row_lag
    d = row_lag(t.pr.join(t.dim.select("entity", "kind"), "entity"), "ret", "pr1")
    g = d.groupBy("kind").agg(F.sqrt(F.avg(F.col("ret") ** 2)).alias("zero"), F.stddev_pop("ret").alias("mean"),
                              F.sqrt(F.avg((F.col("ret") - F.col("pr1")) ** 2)).alias("naive"))
    m = g.unpivot(["kind"], ["zero", "mean", "naive"], "m", "rmse")
    return m.groupBy("kind").agg(F.min_by("m", F.struct(F.round(F.col("rmse") * 1e9), "m")).alias("winner"), rnd(F.min("rmse")).alias("best"))


@query("a30_test_ledger", with_(f"""
SELECT status, count(*) AS families, CAST(sum(n) AS BIGINT) AS tests, {r("avg(CAST(corrected AS DOUBLE))")} AS share_corrected FROM
 (SELECT region, count(*) AS n, CASE WHEN abs(avg(ret)) * sqrt(count(*)) > 0.05 * stddev(ret) THEN 'survives' ELSE 'fails' END AS status,
   count(*) > 4000 AS corrected FROM pr JOIN dim USING (entity) WHERE ret IS NOT NULL GROUP BY region) GROUP BY 1"""))
def a30(t):
    from gridloom.operators.evaluation import test_ledger
    d = t.pr.where("ret is not null").join(t.dim.select("entity", "region"), "entity")
    f = d.groupBy("region").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev("ret").alias("s")).select(
        F.col("region").alias("family"), "n",
        F.when(F.abs("m") * F.sqrt("n") > 0.05 * F.col("s"), "survives").otherwise("fails").alias("status"), (F.col("n") > 4000).alias("corrected"))
    return test_ledger(f).select("status", "families", "tests", rnd("share_corrected").alias("share_corrected"))


@query("a31_approximate_options")
def a31(t):
    """Approximate distinct and quantile as options beside the exact forms."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"),
                                                  F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median_price"))


@query("a32_cohort_first_values", with_(f"""
WITH f AS (SELECT entity, arg_min(price, date) AS first_price, min(date) AS first_date FROM panel GROUP BY 1)
SELECT kind, count(*) AS n, {r("quantile_cont(first_price, 0.5)", 4)} AS first_median, {r("min(first_price)", 4)} AS first_min,
 min(first_date) AS first_date FROM f JOIN dim USING (entity) GROUP BY 1""").replace("\nWITH f AS", ",\nf AS"))
def a32(t):
    f = A.first_row(t.panel.select("entity", "date", "price"), ["entity"], ["date"])
    return f.join(t.dim.select("entity", "kind"), "entity").groupBy("kind").agg(
        F.count("*").alias("n"), rnd(F.percentile("price", F.lit(0.5)), 4).alias("first_median"),
        rnd(F.min("price"), 4).alias("first_min"), F.min("date").alias("first_date"))


@query("a33_extremes_report", with_(f"""
(SELECT 'top rate' AS chk, entity, {r("price", 4)} AS value FROM panel ORDER BY panel.price DESC, entity, date LIMIT 20) UNION ALL
SELECT 'p99', NULL, {r("quantile_cont(price, 0.99)", 4)} FROM panel UNION ALL
(SELECT 'top intensity', entity, {r("sum(volume) / count(*)", 4)} FROM panel GROUP BY entity ORDER BY sum(volume) / count(*) DESC, entity LIMIT 10)"""))
def a33(t):
    p = t.panel
    a = p.orderBy(F.col("price").desc(), "entity", "date").limit(20).select(F.lit("top rate").alias("chk"), "entity", F.col("price").alias("value"))
    b = Q.exact_quantiles(p, "price", [0.99]).select(F.lit("p99").alias("chk"), F.lit(None).cast("int").alias("entity"), F.col("q").alias("value"))
    c = p.groupBy("entity").agg((F.sum("volume") / F.count("*")).alias("value")).orderBy(F.col("value").desc(), "entity").limit(10)
    return a.unionByName(b).unionByName(c.withColumn("chk", F.lit("top intensity"))).select("chk", "entity", rnd("value", 4).alias("value"))


@query("a34_chart_marts", with_(f"""
SELECT 'total' AS mart, CAST(date_trunc('month', date) AS DATE) AS bucket, NULL AS label, {r("sum(volume)")} AS value FROM panel GROUP BY 2 UNION ALL
SELECT 'entities', CAST(date_trunc('month', date) AS DATE), NULL, CAST(count(DISTINCT entity) AS DOUBLE) FROM panel GROUP BY 2 UNION ALL
SELECT 'median by kind', CAST(date_trunc('month', date) AS DATE), kind, {r("quantile_cont(price, 0.5)", 4)} FROM panel JOIN dim USING (entity) GROUP BY 2, 3"""))
def a34(t):
    m = F.date_trunc("month", "date").cast("date").alias("bucket")
    p = t.panel
    none = F.lit(None).cast("string").alias("label")
    a = p.groupBy(m).agg(rnd(F.sum("volume")).alias("value")).select(F.lit("total").alias("mart"), "bucket", none, "value")
    b = p.groupBy(m).agg(F.countDistinct("entity").cast("double").alias("value")).select(F.lit("entities").alias("mart"), "bucket", none, "value")
    c = p.join(t.dim.select("entity", F.col("kind").alias("label")), "entity").groupBy(m, "label").agg(
        rnd(F.percentile("price", F.lit(0.5)), 4).alias("value")).select(F.lit("median by kind").alias("mart"), "bucket", "label", "value")
    return a.unionByName(b).unionByName(c)
