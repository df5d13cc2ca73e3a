"""Event log x rate catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.num import rnd
from gridloom.operators import joins as J, production as R
from gridloom.registry import query
from gridloom.sqltext import define, r, with_

COINS = {"small ring": 1.0, "hot gear": 10.0}
RATES = {"PROMO": 0.9, "ECONOMY": 0.5, "SMALL": 0.65}

define("bids", "SELECT p_name AS item, p_brand AS buyer, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_retailprice END AS price, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS gated FROM part")
define("best", """SELECT item, max(price) AS max_price, coalesce(max(price) FILTER (NOT gated), 0) AS open_price FROM bids WHERE price > 0 GROUP BY 1""")
define("yields", """SELECT p_partkey, p_brand AS producer, p_type AS version, p_name AS item, p_type AS category, CAST(p_partkey % 90 + 1 AS DOUBLE) AS times,
  CAST(20 + (CAST(substr(p_brand, 7) AS INT) * 37 + length(p_type) * 911) % 20000 AS BIGINT) AS samples, CAST(p_size AS DOUBLE) AS amount_lo, CAST(p_size + 5 AS DOUBLE) AS amount_hi,
  p_partkey % 3 <> 0 AS has_amount, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_partkey % 90 + 1 + p_size AS DOUBLE) END AS total FROM part""")
define("expq", """SELECT *, times / samples AS frequency, CASE WHEN total >= times THEN total / samples ELSE times / samples * (amount_lo + amount_hi) / 2 END AS expected_qty,
  CASE WHEN total >= times THEN 'total over samples' WHEN total IS NOT NULL THEN 'midpoint, total inconsistent' WHEN has_amount THEN 'midpoint' ELSE 'unit assumed' END AS method,
  coalesce(total >= times, false) OR has_amount AS complete, total IS NOT NULL AND NOT coalesce(total >= times, false) AS inconsistent FROM yields""")
define("valued", """SELECT *, CASE WHEN kind = 'direct' THEN expected_qty * coin ELSE 0 END AS direct, CASE WHEN kind = 'sellable' THEN expected_qty * max_price ELSE 0 END AS sale,
  CASE WHEN kind = 'sellable' THEN expected_qty * open_price ELSE 0 END AS sale_open, CASE WHEN kind = 'sellable' THEN expected_qty * max_price * rate ELSE 0 END AS sale_realised FROM
  (SELECT *, CASE WHEN coin > 0 THEN 'direct' WHEN max_price > 0 THEN 'sellable' ELSE 'none' END AS kind, CASE WHEN coin > 0 THEN 1.0 ELSE CASE category WHEN 'PROMO' THEN 0.9 WHEN 'ECONOMY' THEN 0.5 WHEN 'SMALL' THEN 0.65 ELSE 0.3 END END AS rate FROM
   (SELECT expq.*, max_price, open_price, CASE item WHEN 'small ring' THEN 1.0 WHEN 'hot gear' THEN 10.0 ELSE 0.0 END AS coin FROM expq LEFT JOIN best USING (item)))""")
define("pages_v", """SELECT producer, version, max(samples) AS samples, count(*) AS items, count(*) FILTER (kind <> 'none') AS valued_items, count(*) FILTER (complete) AS complete_items,
  count(*) FILTER (inconsistent) AS inconsistent_items, sum(direct) AS direct, sum(sale) AS sale, sum(sale_open) AS sale_open, sum(sale_realised) AS sale_realised FROM valued GROUP BY 1, 2""")
define("cat", """SELECT producer, version, samples, items, valued_items, inconsistent_items, CAST(complete_items AS DOUBLE) / items AS completeness,
  CASE WHEN samples >= 10000 THEN 'high' WHEN samples >= 1000 THEN 'medium' WHEN samples >= 100 THEN 'low' ELSE 'insufficient' END AS confidence,
  CASE WHEN samples < 100 THEN 'insufficient_sample' WHEN complete_items = items THEN 'complete' ELSE 'partial' END AS status,
  CASE WHEN samples >= 100 THEN direct END AS direct, CASE WHEN samples >= 100 THEN sale END AS sale, CASE WHEN samples >= 100 THEN sale_open END AS sale_open, CASE WHEN samples >= 100 THEN sale_realised END AS sale_realised
  FROM (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY samples DESC, version DESC) AS rn FROM pages_v) WHERE rn = 1""")
define("cls", "SELECT DISTINCT p_brand AS producer, CAST(substr(p_brand, 7) AS INT) % 7 = 0 AS is_boss, CAST(substr(p_brand, 7) AS INT) % 11 = 0 AS known_zero FROM part")
define("tallies", "SELECT entity, date, p_brand AS producer, CAST(sum(qty) AS BIGINT) AS n FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
define("evd", """SELECT entity, date, n, k.producer, coalesce(is_boss, false) AS boss, coalesce(known_zero, false) AS zero, NOT coalesce(known_zero, false) AND coalesce(status IN ('complete', 'partial'), false) AS usable,
  confidence, completeness, direct, sale, sale_open, sale_realised, (direct + sale) * n AS contrib FROM tallies k LEFT JOIN cat USING (producer) LEFT JOIN cls USING (producer)""")
define("daily", """SELECT entity, date, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (boss), 0) AS BIGINT) AS boss_n, CAST(coalesce(sum(n) FILTER (NOT boss), 0) AS BIGINT) AS nonboss,
  CAST(coalesce(sum(n) FILTER (zero), 0) AS BIGINT) AS known_zero_n, CAST(coalesce(sum(n) FILTER (usable OR zero), 0) AS BIGINT) AS modeled_all, CAST(coalesce(sum(n) FILTER ((usable OR zero) AND NOT boss), 0) AS BIGINT) AS modeled_nonboss,
  coalesce(sum(direct * n) FILTER (usable AND NOT boss), 0) AS direct, coalesce(sum(sale * n) FILTER (usable AND NOT boss), 0) AS sale, coalesce(sum(sale_open * n) FILTER (usable AND NOT boss), 0) AS sale_open,
  coalesce(sum(sale_realised * n) FILTER (usable AND NOT boss), 0) AS sale_realised, coalesce(sum(contrib) FILTER (usable AND boss), 0) AS boss_value, coalesce(sum(contrib) FILTER (usable AND NOT boss AND confidence = 'low'), 0) AS low_conf_value,
  arg_max(producer, (round(contrib * 1e4), producer)) FILTER (usable AND NOT boss) AS top_key, max(contrib) FILTER (usable AND NOT boss) AS top_value FROM evd GROUP BY 1, 2""")
define("span", "SELECT entity, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1")
define("derived", """SELECT *, (modeled_nonboss / nullif(CAST(nonboss AS DOUBLE), 0)) AS coverage, direct + sale AS potential, reporting < ceil(expected * 0.8) AS partial_date FROM
  (SELECT daily.*, count(*) OVER (PARTITION BY date) AS reporting, (SELECT count(*) FROM span WHERE daily.date BETWEEN lo AND hi) AS expected FROM daily)""")


def offers(t):
    return t.part.select(
        F.col("p_name").alias("item"), F.col("p_brand").alias("buyer"),
        F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3").alias("gated"))


def yields(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    times = (k % 90 + 1).cast("double")
    samples = (20 + (F.substring("p_brand", 7, 9).cast("int") * 37 + F.length("p_type") * 911) % 20000).cast("long")
    total = F.when(k % 4 == 0, F.lit(None)).when(k % 7 == 0, 0.0).otherwise(times + size)
    return t.part.select("p_partkey", F.col("p_brand").alias("producer"), F.col("p_type").alias("version"), F.col("p_name").alias("item"), F.col("p_type").alias("category"),
                         times.alias("times"), samples.alias("samples"), size.cast("double").alias("amount_lo"), (size + 5).cast("double").alias("amount_hi"),
                         (k % 3 != 0).alias("has_amount"), total.alias("total"))


def valued(t):
    return R.value_items(R.expected_quantity(yields(t)), R.best_offer(offers(t)), COINS, RATES)


def catalogue(t):
    return R.rate_catalogue(valued(t), ["producer", "version"], "producer")


def classes(t):
    b = F.substring("p_brand", 7, 9).cast("int")
    return t.part.select(F.col("p_brand").alias("producer"), (b % 7 == 0).alias("is_boss"), (b % 11 == 0).alias("known_zero")).distinct()


def tallies(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("producer"))
    d = J.enrich(t.lines.select("l_orderkey", "l_partkey", "entity", "date", "qty"), p, ["l_partkey"], "inner", spread="l_orderkey")
    return d.groupBy("entity", "date", "producer").agg(F.sum("qty").alias("n"))


def daily(t):
    return R.value_events(tallies(t), catalogue(t), classes(t), "producer")


def derived(t):
    return R.derive_daily(daily(t), t.dim)


@query("r1_best_price_choice", with_("""
SELECT item, max_price, open_price, (SELECT string_agg(DISTINCT buyer, '; ' ORDER BY buyer) FROM bids n WHERE n.item = b.item AND n.price = b.max_price) AS best_buyers,
 coalesce((SELECT string_agg(DISTINCT buyer, '; ' ORDER BY buyer) FROM bids n WHERE n.item = b.item AND NOT gated AND n.price = b.open_price AND n.price > 0), '') AS open_buyers,
 CASE WHEN open_price >= max_price THEN 'open' WHEN open_price > 0 THEN 'best needs access' ELSE 'all need access' END AS access FROM best b"""))
def r1(t):
    return R.best_offer(offers(t))


@query("r2_expected_quantity", with_(f"SELECT p_partkey, {r('frequency')} AS frequency, {r('expected_qty', 7)} AS expected_qty, method, complete, inconsistent FROM expq"))
def r2(t):
    return R.expected_quantity(yields(t)).select("p_partkey", rnd("frequency").alias("frequency"), rnd("expected_qty", 7).alias("expected_qty"), "method", "complete", "inconsistent")


@query("r3_item_valuation", with_(f"SELECT p_partkey, kind, {r('rate')} AS rate, {r('direct', 5)} AS direct, {r('sale', 5)} AS sale, {r('sale_open', 5)} AS sale_open, {r('sale_realised', 5)} AS sale_realised FROM valued"))
def r3(t):
    return valued(t).select("p_partkey", "kind", rnd("rate").alias("rate"), *[rnd(c, 5).alias(c) for c in ("direct", "sale", "sale_open", "sale_realised")])


@query("r4_rate_catalogue", with_(f"SELECT producer, version, samples, items, valued_items, inconsistent_items, {r('completeness')} AS completeness, confidence, status, {r('direct', 5)} AS direct, {r('sale', 4)} AS sale, {r('sale_realised', 4)} AS sale_realised FROM cat"))
def r4(t):
    return catalogue(t).select("producer", "version", "samples", "items", "valued_items", "inconsistent_items", rnd("completeness").alias("completeness"), "confidence", "status",
                               rnd("direct", 5).alias("direct"), rnd("sale", 4).alias("sale"), rnd("sale_realised", 4).alias("sale_realised"))


@query("r5_daily_production", with_(f"""SELECT entity, date, total, boss_n, nonboss, known_zero_n, modeled_all, modeled_nonboss, {r('direct', 3)} AS direct, {r('sale', 3)} AS sale, {r('sale_open', 3)} AS sale_open,
 {r('boss_value', 3)} AS boss_value, {r('low_conf_value', 3)} AS low_conf_value, top_key, {r('top_value', 3)} AS top_value FROM daily"""))
def r5(t):
    d = daily(t).withColumnRenamed("boss", "boss_n")
    return d.select("entity", "date", "total", "boss_n", "nonboss", "known_zero_n", "modeled_all", "modeled_nonboss",
                    *[rnd(c, 3).alias(c) for c in ("direct", "sale", "sale_open", "boss_value", "low_conf_value")], "top_key", rnd("top_value", 3).alias("top_value"))


@query("r6_derived_daily", with_(f"""
SELECT d.entity, d.date, {r('coverage')} AS coverage, {r('potential', 3)} AS potential, {r('direct + 0.25 * sale', 3)} AS realised_25, {r('direct + 0.5 * sale', 3)} AS realised_50, {r('top_value / nullif(potential, 0)')} AS top_share,
 reporting, expected, partial_date, coalesce(coverage < 0.8, true) OR partial_date AS low_quality, {r('potential / population', 4)} AS per_head, {r('potential * 1000 / nullif(nonboss, 0)', 3)} AS per_1000,
 {r('sum(potential) OVER (PARTITION BY d.entity ORDER BY d.date)', 2)} AS cumulative FROM derived d LEFT JOIN dim ON dim.entity = d.entity"""))
def r6(t):
    d = derived(t)
    return d.select("entity", "date", rnd("coverage").alias("coverage"), rnd("potential", 3).alias("potential"), rnd("realised_25", 3).alias("realised_25"), rnd("realised_50", 3).alias("realised_50"),
                    rnd("top_share").alias("top_share"), "reporting", F.col("expected").cast("long").alias("expected"), "partial_date", "low_quality", rnd("per_head", 4).alias("per_head"),
                    rnd("per_1000", 3).alias("per_1000"), rnd("cumulative", 2).alias("cumulative"))


@query("r7_coverage_class", with_("""
SELECT producer, CASE WHEN is_boss THEN 'boss_separate' WHEN known_zero THEN 'known_zero' WHEN status IN ('complete', 'partial') THEN 'modeled' WHEN status = 'insufficient_sample' THEN 'insufficient_sample' ELSE 'missing' END AS coverage_class,
 NOT is_boss AND NOT known_zero AND coalesce(status IN ('complete', 'partial'), false) AS included,
 CASE WHEN is_boss THEN 'kept in the boss series' WHEN known_zero THEN 'counted as zero' WHEN status IN ('complete', 'partial') THEN '' WHEN status = 'insufficient_sample' THEN 'too few samples' ELSE 'no catalogue entry' END AS reason
FROM (SELECT DISTINCT p_brand AS producer FROM part) JOIN cls USING (producer) LEFT JOIN cat USING (producer)"""))
def r7(t):
    keys = t.part.select(F.col("p_brand").alias("producer")).distinct()
    return R.coverage_class(keys, catalogue(t), classes(t), "producer")


@query("r8_quality_metrics", with_(f"""
SELECT unnest(['entity_days', 'entities', 'events', 'coverage_all', 'coverage_nonboss', 'low_quality_share', 'low_conf_value_share']) AS metric,
 unnest([{r('count(*)')}, {r('count(DISTINCT entity)')}, {r('sum(total)')}, {r('sum(modeled_all) / CAST(sum(total) AS DOUBLE)')}, {r('sum(modeled_nonboss) / CAST(sum(nonboss) AS DOUBLE)')},
  {r('avg(CAST(coalesce(coverage < 0.8, true) OR partial_date AS INT))')}, {r('sum(low_conf_value) / sum(potential)')}]) AS value FROM derived"""))
def r8(t):
    return R.quality_metrics(derived(t)).select("metric", rnd("value").alias("value"))


@query("r9_join_health", with_(f"SELECT entity, {r('sum(modeled_all) / CAST(sum(total) AS DOUBLE)')} AS matched, sum(modeled_all) / CAST(sum(total) AS DOUBLE) >= 0.5 AS healthy FROM daily GROUP BY 1"))
def r9(t):
    return R.join_health(daily(t)).select("entity", rnd("matched").alias("matched"), "healthy")


@query("r10_daily_counts", with_(f"""
SELECT entity, date - 1 AS date, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN category IN ('error', 'purchase') THEN n ELSE 0 END) AS BIGINT) AS special, count(*) AS categories,
 {r('sum(s * s)')} AS hhi, {r('max(s)')} AS top_share FROM (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity, date) AS s FROM counts) GROUP BY entity, date"""))
def r10(t):
    d = R.daily_counts(t.counts, ["error", "purchase"])
    return d.select("entity", "date", "total", "special", "categories", rnd("hhi").alias("hhi"), rnd("top_share").alias("top_share"))


@query("r11_category_rollup", with_("""
SELECT producer, CAST(sum(n) AS BIGINT) AS total, producer AS spellings, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT entity) AS entities FROM tallies GROUP BY 1"""))
def r11(t):
    return R.category_rollup(tallies(t).withColumn("raw", F.col("producer")), "producer", "raw")
