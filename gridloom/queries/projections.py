"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import (
    div, finite, half_life, log1p_floor, log_floor, mean_skipnull, rnd, sign)
from gridloom.operators import quantiles as Q
from gridloom.operators.joins import with_scalars
from gridloom.registry import query
from gridloom.sqltext import r, with_, tail_sql

# ------------------------------------------------------------------ cleaning projections


@query("p1_sentinel_to_null", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN l_tax END AS tax,
       CASE WHEN l_discount <> 0 THEN l_discount END AS discount FROM lineitem""")
def p1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             S.sentinel_to_null("l_tax", 0).alias("tax"),
                             S.sentinel_to_null("l_discount", 0).alias("discount"))


@query("p2_coerce_numeric", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_num FROM orders""")
def p2(t):
    return t.orders.select("o_orderkey", S.coerce_double(F.substring("o_orderpriority", 1, 1)).alias("priority"),
                           S.coerce_double("o_orderstatus").alias("status_num"))


@query("p3_validity_gate", with_(f"""
SELECT entity, date, {r("CASE WHEN sell_qty > 0 AND sell_price > 1000 THEN sell_price END", 4)} AS sell_price,
       {r("CASE WHEN buy_qty > 0 AND buy_price > 1000 THEN buy_price END", 4)} AS buy_price FROM sides"""))
def p3(t):
    return t.sides.select("entity", "date",
                          rnd(S.validity_gate("sell_price", "sell_qty", 1000.0), 4).alias("sell_price"),
                          rnd(S.validity_gate("buy_price", "buy_qty", 1000.0), 4).alias("buy_price"))


@query("p4_rowwise_mean_skipnull", with_(f"""
SELECT entity, date, {r('''CASE WHEN sell_price IS NULL AND buy_price IS NULL AND book_price IS NULL THEN NULL ELSE
  (coalesce(sell_price, 0) + coalesce(buy_price, 0) + coalesce(book_price, 0)) /
  ((sell_price IS NOT NULL)::INT + (buy_price IS NOT NULL)::INT + (book_price IS NOT NULL)::INT) END''', 5)} AS mid
FROM sides"""))
def p4(t):
    return t.sides.select("entity", "date", rnd(mean_skipnull("sell_price", "buy_price", "book_price"), 5).alias("mid"))


@query("p5_fallback_with_provenance", with_(f"""
SELECT entity, date, {r("coalesce(sell_price, buy_price, book_price)", 5)} AS price,
  CASE WHEN sell_price IS NOT NULL THEN 'sell' WHEN buy_price IS NOT NULL THEN 'buy' ELSE 'book' END AS price_source
FROM sides"""))
def p5(t):
    return t.sides.select("entity", "date", rnd(F.coalesce("sell_price", "buy_price", "book_price"), 5).alias("price"),
                          S.first_match([(F.col("sell_price").isNotNull(), "sell"),
                                         (F.col("buy_price").isNotNull(), "buy")], "book").alias("price_source"))


@query("p6_ratio_band_filter", with_(f"""
SELECT entity, date, {r("CASE WHEN sell_price / buy_price BETWEEN 0.5 AND 2.0 THEN sell_price END", 5)} AS sell_in_band
FROM sides"""))
def p6(t):
    return t.sides.select("entity", "date", rnd(S.in_ratio_band("sell_price", "buy_price", 0.5, 2.0), 5).alias("sell_in_band"))


@query("p7_quantity_weighted_price", with_(f"""
SELECT entity, date, {r('''(coalesce(sell_price * sell_qty, 0) + coalesce(buy_price * buy_qty, 0)) /
  nullif((CASE WHEN sell_price IS NULL THEN 0 ELSE sell_qty END) + (CASE WHEN buy_price IS NULL THEN 0 ELSE buy_qty END), 0)''', 5)}
  AS price_vw FROM sides"""))
def p7(t):
    return t.sides.select("entity", "date", rnd(S.quantity_weighted(
        [("sell_price", "sell_qty"), ("buy_price", "buy_qty")]), 5).alias("price_vw"))


@query("p8_clip_log", with_(f"""
SELECT entity, date, {r("ln(greatest(volume - 20, 1))")} AS log_volume, {r("ln(1 + greatest(volume - 20, 0))")} AS log1p_volume
FROM panel"""))
def p8(t):
    return t.panel.select("entity", "date", rnd(log_floor(F.col("volume") - 20)).alias("log_volume"),
                          rnd(log1p_floor(F.col("volume") - 20)).alias("log1p_volume"))


GAP_EDGES = [0.0, 0.02, 0.04, 0.06, 0.10]
GAP_LABELS = ["0-2%", "2-4%", "4-6%", "6-10%", ">10%"]
GAP_CASE = ("CASE WHEN {x} >= 0.10 THEN '>10%' WHEN {x} >= 0.06 THEN '6-10%' WHEN {x} >= 0.04 THEN '4-6%' "
            "WHEN {x} >= 0.02 THEN '2-4%' WHEN {x} >= 0 THEN '0-2%' END")


@query("p9_cut_bins", with_(f"""
SELECT bin, count(*) AS n, {r("avg(a)")} AS mean_absdev
FROM (SELECT abs(dev) AS a, {GAP_CASE.format(x="abs(dev)")} AS bin FROM dev) GROUP BY bin"""))
def p9(t):
    d = t.dev.select(F.abs("dev").alias("a"))
    return d.groupBy(S.cut_bins("a", GAP_EDGES, GAP_LABELS).alias("bin")).agg(
        F.count("*").alias("n"), rnd(F.avg("a")).alias("mean_absdev"))


@query("p10_multi_branch_label", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promoted' WHEN p_size >= 40 AND p_retailprice > 1000 THEN 'large premium'
  WHEN p_size >= 40 THEN 'large' WHEN p_retailprice > 1000 THEN 'premium' ELSE 'plain' END AS label FROM part""")
def p10(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", S.first_match([
        (F.col("p_type") == "PROMO", "promoted"), ((size >= 40) & (price > 1000), "large premium"),
        (size >= 40, "large"), (price > 1000, "premium")], "plain").alias("label"))


@query("p11_prefix_exclude", """
SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '^[AEIOU]')) AS vowel_start
FROM documents WHERE NOT regexp_matches(text, '^[(\\[]') GROUP BY lang""")
def p11(t):
    d = t.documents.where(~F.col("text").rlike(r"^[(\[]"))
    return d.groupBy("lang").agg(F.count("*").alias("n"),
                                 F.count(F.when(F.col("text").rlike("^[AEIOU]"), 1)).alias("vowel_start"))


@query("p12_one_hot", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS st_f, CAST(o_orderstatus = 'O' AS DOUBLE) AS st_o,
       CAST(o_orderstatus = 'P' AS DOUBLE) AS st_p FROM orders""")
def p12(t):
    return t.orders.select("o_orderkey", *S.one_hot("o_orderstatus", ["F", "O", "P"], "st"))


@query("p13_finite_complete_case", with_(f"""
SELECT entity, date, {r("ln(sell_qty)")} AS a, {r("buy_qty / nullif(book_qty, 0)")} AS b FROM sides
WHERE sell_qty > 0 AND book_qty <> 0"""))
def p13(t):
    d = t.sides.select("entity", "date", F.expr("try_divide(buy_qty, book_qty)").alias("b"),
                       F.when(F.col("sell_qty") > 0, F.log("sell_qty")).otherwise(F.lit(float("-inf"))).alias("a"))
    d = d.select("entity", "date", finite("a").alias("a"), finite("b").alias("b")).dropna(subset=["a", "b"])
    return d.select("entity", "date", rnd("a").alias("a"), rnd("b").alias("b"))


TRAIN_END = "1999-07-01"


@query("p14_impute_train_median", with_(f"""
SELECT entity, date, {r("coalesce(ret, (SELECT quantile_cont(ret, 0.5) FROM pr WHERE date < DATE '" + TRAIN_END + "'))")} AS ret_filled
FROM pr"""))
def p14(t):
    med = Q.quantile_row(t.pr.where(F.col("date") < TRAIN_END), "ret", {"m": 0.5})
    return with_scalars(t.pr.select("entity", "date", "ret"), med).select(
        "entity", "date", rnd(F.coalesce("ret", "s.m")).alias("ret_filled"))


@query("p15_standardise_train", with_(f"""
SELECT entity, date, {r("(logp - m) / (s + 1e-9)")} AS z FROM pr,
  (SELECT avg(logp) AS m, stddev_pop(logp) AS s FROM pr WHERE date < DATE '{TRAIN_END}')"""))
def p15(t):
    st = t.pr.where(F.col("date") < TRAIN_END).agg(F.avg("logp").alias("m"), F.stddev_pop("logp").alias("sd"))
    return with_scalars(t.pr.select("entity", "date", "logp"), st).select(
        "entity", "date", rnd((F.col("logp") - F.col("s.m")) / (F.col("s.sd") + 1e-9)).alias("z"))


@query("p16_lot_convert", with_("""
SELECT entity, date, CAST(volume * 25 AS BIGINT) AS units, CAST(ceil(volume / 25) * 25 AS BIGINT) AS lot_units FROM panel"""))
def p16(t):
    return t.panel.select("entity", "date", (F.col("volume") * 25).cast("long").alias("units"),
                          S.lot_ceil("volume", 25).alias("lot_units"))


@query("p17_fee_capped", f"""
SELECT o_orderkey, {r("least(greatest(0.02 * o_totalprice, 2000.0), 8000.0)", 4)} AS fee,
       {r("least(greatest(0.02 * o_totalprice, 2000.0), 8000.0) / o_totalprice * 100")} AS eff_rate_pct FROM orders""")
def p17(t):
    fee = S.fee_capped("o_totalprice", 0.02, 2000.0, 8000.0)
    return t.orders.select("o_orderkey", rnd(fee, 4).alias("fee"), rnd(fee / F.col("o_totalprice") * 100).alias("eff_rate_pct"))


@query("p18_sample_rows")
def p18(t):
    """Deterministic 10 % sample by key hash (sampling is the feature)."""
    return t.orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) < 1).select("o_orderkey", "o_totalprice")


@query("p19_drop_constant_cols", """
SELECT column_name, varies FROM (
 SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax','one']) AS column_name,
        unnest([stddev(l_quantity) > 0, stddev(l_extendedprice) > 0, stddev(l_discount) > 0, stddev(l_tax) > 0, false]) AS varies
 FROM lineitem) WHERE varies""")
def p19(t):
    d = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(1.0).alias("one"))
    s = d.agg(*[(F.max(c) > F.min(c)).alias(c) for c in d.columns])
    return s.unpivot([], d.columns, "column_name", "varies").where("varies")


@query("p20_melt", with_(f"""
SELECT entity, date, side, {r("price", 4)} AS price FROM (
  SELECT entity, date, 'sell_price' AS side, sell_price AS price FROM sides UNION ALL
  SELECT entity, date, 'buy_price', buy_price FROM sides UNION ALL
  SELECT entity, date, 'book_price', book_price FROM sides) WHERE price IS NOT NULL"""))
def p20(t):
    m = t.sides.unpivot(["entity", "date"], ["sell_price", "buy_price", "book_price"], "side", "price")
    return m.where("price is not null").select("entity", "date", "side", rnd("price", 4).alias("price"))


# ------------------------------------------------------------------ scalar families


@query("f1_name_normalise", """
SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\\s+', ' ', 'g'))) AS norm FROM part""")
def f1(t):
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))
    return t.part.select("p_partkey", S.norm_name(raw).alias("norm"))


@query("f2_stable_id", "SELECT p_partkey, 'it_' || substr(sha1(lower(p_name)), 1, 12) AS id FROM part")
def f2(t):
    return t.part.select("p_partkey", S.stable_id("it_", "p_name").alias("id"))


@query("f3_slug", """
SELECT o_orderkey, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM orders""")
def f3(t):
    return t.orders.select("o_orderkey", S.slug("o_orderpriority").alias("slug"))


@query("f4_parse_range", """
SELECT p_partkey, TRY_CAST(regexp_extract(txt, '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS first_num,
  CAST(regexp_extract_all(txt, '(\\d+(?:\\.\\d+)?)', 1)[1] AS DOUBLE) AS lo,
  CAST(regexp_extract_all(txt, '(\\d+(?:\\.\\d+)?)', 1)[-1] AS DOUBLE) AS hi
FROM (SELECT p_partkey, p_brand || ' ' || p_size || '-' || (p_size + 5) AS txt FROM part)""")
def f4(t):
    txt = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 5).cast("string"))
    d = t.part.select("p_partkey", txt.alias("txt"))
    lo, hi = S.range_bounds("txt")
    return d.select("p_partkey", S.first_number("txt").alias("first_num"), lo.alias("lo"), hi.alias("hi"))


@query("f5_plural_candidates", """
SELECT DISTINCT p_name, form FROM (
 SELECT p_name, unnest([p_name || 's',
   CASE WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' ELSE p_name || 's' END,
   CASE WHEN regexp_matches(p_name, '[^aeiou]y$') THEN regexp_replace(p_name, 'y$', '') || 'ies' ELSE p_name || 's' END,
   CASE WHEN regexp_matches(p_name, 'fe?$') THEN regexp_replace(p_name, 'fe?$', '') || 'ves' ELSE p_name || 's' END,
   CASE WHEN regexp_matches(p_name, 'man$') THEN regexp_replace(p_name, 'man$', 'men') ELSE p_name || 's' END]) AS form
 FROM (SELECT DISTINCT p_name FROM part))""")
def f5(t):
    return t.part.select("p_name").distinct().select("p_name", F.explode(S.plural_forms("p_name")).alias("form"))


@query("f6_text_family", """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, starts_with(url, 'https') AS secure,
  contains(url, '?') AS has_query, array_to_string(string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.')[2:], '/') AS labels
FROM pages""")
def f6(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    parts = F.split(host, r"\.")
    return t.pages.select(
        "page_id", host.alias("host"), F.col("url").startswith("https").alias("secure"),
        F.col("url").contains("?").alias("has_query"),
        F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("labels"))


@query("f7_multi_format_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def f7(t):
    k = F.col("o_orderkey") % 3
    txt = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(k == 1, F.date_format("o_orderdate", "MMM dd yyyy")).otherwise(F.lit("not a date")))
    return t.orders.select("o_orderkey", S.parse_date(txt, ["yyyy-MM-dd", "MMM dd yyyy"]).alias("parsed"))


@query("f8_calendar_family", f"""
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, isodow(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS doy,
  month(o_orderdate) AS month, year(o_orderdate) AS year, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS age_days,
  {r("(CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 365.25")} AS age_years FROM orders""")
def f8(t):
    d = F.to_date("o_orderdate")
    age = F.datediff(d, F.lit("1995-01-01"))
    return t.orders.select(
        "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch_s"),
        F.weekday(d).cast("long").alias("dow"), F.dayofyear(d).cast("long").alias("doy"),
        F.month(d).cast("long").alias("month"), F.year(d).cast("long").alias("year"), age.cast("long").alias("age_days"),
        rnd(age / 365.25).alias("age_years"))


@query("f9_zone_hour_shift", """
SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin') AS local_hour, (hour(ts) + 22) % 24 AS fixed_hour FROM events""")
def f9(t):
    return t.events.select("event_id", S.local_hour("ts", "Europe/Berlin").cast("long").alias("local_hour"),
                           F.pmod(F.hour("ts") - 2, F.lit(24)).cast("long").alias("fixed_hour"))


@query("f10_cyclic_encodings", f"""
SELECT date, {r("sin(2 * pi() * (isodow(date) - 1) / 7.0)")} AS dow_sin, {r("cos(2 * pi() * (isodow(date) - 1) / 7.0)")} AS dow_cos,
  {r("sin(2 * pi() * dayofyear(date) / 365.25)")} AS doy_sin, {r("cos(2 * pi() * dayofyear(date) / 365.25)")} AS doy_cos
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""")
def f10(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    ws, wc = S.cyclic(F.weekday("date"), 7.0)
    ys, yc = S.cyclic(F.dayofyear("date"), 365.25)
    return d.select("date", rnd(ws).alias("dow_sin"), rnd(wc).alias("dow_cos"), rnd(ys).alias("doy_sin"), rnd(yc).alias("doy_cos"))


@query("f11_math_family", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r("ln(l_quantity)")} AS ln_q, {r("exp(-l_discount)")} AS exp_d, {r("sqrt(l_extendedprice)", 5)} AS sqrt_p,
  {r("sign(l_discount - 0.05)")} AS sgn, {r("abs(l_discount - 0.05)")} AS absd, {r("pow(l_quantity, 1.5)", 4)} AS powq,
  CAST(l_partkey % 7 AS BIGINT) AS modp, CAST(ceil(l_quantity / 7) AS BIGINT) AS ceilq,
  {r("CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(0.5) / ln(l_discount) END")} AS hl FROM lineitem""")
def f11(t):
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd(F.log("l_quantity")).alias("ln_q"), rnd(F.exp(-c("l_discount"))).alias("exp_d"),
        rnd(F.sqrt("l_extendedprice"), 5).alias("sqrt_p"), rnd(sign(c("l_discount") - 0.05)).alias("sgn"),
        rnd(F.abs(c("l_discount") - 0.05)).alias("absd"), rnd(F.pow("l_quantity", F.lit(1.5)), 4).alias("powq"),
        (c("l_partkey") % 7).alias("modp"), F.ceil(c("l_quantity") / 7).alias("ceilq"), rnd(half_life("l_discount")).alias("hl"))


@query("f12_array_family", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h, regexp_extract_all(html, '<p>([^<]*)', 1) AS p FROM pages)
SELECT page_id, CAST(len(h) AS BIGINT) AS n_links, CAST(least(len(h), len(p)) AS BIGINT) AS n_zip, array_to_string(h[1:3], '|') AS first3,
  CAST(len(list_filter(h, lambda x: x < '/n')) AS BIGINT) AS searchsorted, CAST(coalesce(list_sum(list_transform(range(1, least(len(h), len(p)) + 1), lambda i: length(h[i]) * length(p[i]))), 0) AS BIGINT) AS dot FROM a""")
def f12(t):
    """Zip, truncate to the shorter, slice, position in a sorted order: arrays of one page each."""
    a = t.pages.select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1).alias("h"),
                       F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1).alias("p"))
    a = a.withColumn("k", F.least(F.size("h"), F.size("p")))
    z = F.arrays_zip(F.slice("h", F.lit(1), F.col("k")).alias("a"), F.slice("p", F.lit(1), F.col("k")).alias("b"))
    return a.select(
        "page_id", F.size("h").cast("long").alias("n_links"), F.col("k").cast("long").alias("n_zip"),
        F.array_join(F.slice("h", 1, 3), "|").alias("first3"), F.size(F.filter("h", lambda x: x < "/n")).cast("long").alias("searchsorted"),
        F.aggregate(z, F.lit(0).cast("long"), lambda s, x: s + F.length(x["a"]).cast("long") * F.length(x["b"])).alias("dot"))


@query("f13_json_family", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS big FROM events""")
def f13(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), (k >= 50).alias("big"))


@query("f14_map_lookup", f"""
SELECT p_partkey, {r("p_retailprice * CASE p_type WHEN 'PROMO' THEN 0.9 WHEN 'ECONOMY' THEN 0.5 WHEN 'SMALL' THEN 0.65 ELSE 0.3 END", 4)} AS realised FROM part""")
def f14(t):
    rates = F.create_map(*[F.lit(x) for kv in (("PROMO", 0.9), ("ECONOMY", 0.5), ("SMALL", 0.65)) for x in kv])
    rate = F.coalesce(F.try_element_at(rates, F.col("p_type")), F.lit(0.3))
    return t.part.select("p_partkey", rnd(F.col("p_retailprice") * rate, 4).alias("realised"))


@query("f15b_chi_square_tail", f"""
WITH c AS (SELECT event_type, dayofweek(ts) AS d, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT event_type, sum(n) AS n, count(*) - 1 AS dof, count(*) * sum(n * n) / sum(n) - sum(n) AS chi2 FROM c GROUP BY 1)
SELECT event_type, CAST(dof AS BIGINT) AS dof, {r('chi2')} AS chi2, {r('exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8)', 8)} AS p_value FROM x""")
def f15b(t):
    """Are the week days of each category uniform?  The twin is the closed form for six degrees of freedom."""
    from gridloom.operators.inference import chi2_tail
    c = t.events.groupBy("event_type", F.dayofweek("ts").alias("d")).agg(F.count("*").alias("n"))
    x = c.groupBy("event_type").agg((F.count("*") - 1).alias("dof"), (F.count("*") * F.sum(F.col("n") * F.col("n")) / F.sum("n") - F.sum("n")).alias("chi2"))
    return chi2_tail(x, "chi2", "dof", "p_value").select("event_type", "dof", rnd("chi2").alias("chi2"), rnd("p_value", 8).alias("p_value"))


@query("f15_tail_probability", f"""
WITH g AS (SELECT event_type, (avg(value) - (SELECT avg(value) FROM events)) / (stddev(value) / sqrt(count(*))) AS t FROM events GROUP BY 1)
SELECT event_type, {r('t')} AS t_stat, {r(tail_sql('t'), 4)} AS p_value FROM g""")
def f15(t):
    """Two-sided normal tail of each category's mean-difference t-statistic (result rows only)."""
    from gridloom.operators.inference import normal_tail
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.count("*").alias("n"))
    g = with_scalars(g, t.events.agg(F.avg("value").alias("mu")), "a")
    return normal_tail(g.select("event_type", div(F.col("m") - F.col("a.mu"), F.col("s") / F.sqrt("n")).alias("t_stat")), "t_stat", "p_value").select("event_type", rnd("t_stat").alias("t_stat"), rnd("p_value", 4).alias("p_value"))
