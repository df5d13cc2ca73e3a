"""Event log x rate catalogue: offers, expected quantities, catalogue, daily production, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import div
from gridloom.operators.aggs import last_row
from gridloom.operators.joins import alive_on_date, enrich
from gridloom.session import materialise

# fixed values: confidence tiers by sample size
TIERS = [(10_000, "high"), (1_000, "medium"), (100, "low")]
# fixed values: share of list value realised per item category; the default covers the rest
REALISATION_DEFAULT = 0.30
LADDER = (0.25, 0.50, 0.75, 1.00)


def name_key(c) -> Column:
    """Join key of a name: lower case, one space, no trailing punctuation."""
    return S.norm_name(F.regexp_replace(c, r"\s+$", ""))


def key_table(catalogue: DataFrame, name: str, rate: str) -> DataFrame:
    """One row per accepted spelling: the name itself first, then plural forms that collide with no name."""
    base = catalogue.select(name_key(F.col(name)).alias("key"), F.col(rate).alias("rate"), F.lit(0).alias("prio"))
    plur = base.select(F.explode(S.plural_forms("key")).alias("key"), "rate", F.lit(1).alias("prio"))
    u = base.unionByName(plur)
    best = u.groupBy("key").agg(F.min_by(F.struct("rate", "prio"), F.struct("prio", "rate")).alias("r"))
    return best.select("key", F.col("r.rate").alias("rate"), F.col("r.prio").alias("prio"))


def rate_join(events: DataFrame, catalogue: DataFrame, raw: str, name: str, rate: str) -> DataFrame:
    """Attach a rate by normalised name with plural fallback; ``how`` says which matched.

    ``events`` comes aggregated to the raw name or finer counts; the key table is stored once and
    broadcast only when it is small.
    """
    keys = materialise(key_table(catalogue, name, rate), "keys")
    j = enrich(events.withColumn("key", name_key(F.col(raw))), keys, ["key"], "left", spread=raw)
    return j.withColumn("how", F.when(F.col("prio") == 0, "exact").when(F.col("prio") == 1, "plural").otherwise("none")).drop("prio")


# ------------------------------------------------------------------ offers and catalogue
def best_offer(offers: DataFrame, item: str = "item", buyer: str = "buyer", price: str = "price", gated: str = "gated") -> DataFrame:
    """Highest valid offer per item, highest ungated offer, the buyers paying them, and an access note."""
    d = offers.where(F.col(price) > 0)
    g = d.groupBy(item).agg(F.max(price).alias("max_price"), F.coalesce(F.max(F.when(~F.col(gated), F.col(price))), F.lit(0.0)).alias("open_price"))
    j = d.join(g, item)
    who = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(buyer)))), "; ")
    b = j.groupBy(item).agg(F.max("max_price").alias("max_price"), F.max("open_price").alias("open_price"),
                            who(F.col(price) == F.col("max_price")).alias("best_buyers"),
                            who(~F.col(gated) & (F.col(price) == F.col("open_price"))).alias("open_buyers"))
    note = F.when(F.col("open_price") >= F.col("max_price"), "open").when(F.col("open_price") > 0, "best needs access").otherwise("all need access")
    return b.withColumn("access", note)


def expected_quantity(rows: DataFrame, min_samples: int = 100) -> DataFrame:
    """Expected quantity per event: total / samples, else frequency times the range midpoint, else one unit.

    Needs times, samples, amount_lo, amount_hi, has_amount, total.
    """
    c = F.col
    freq = c("times") / c("samples")
    good = c("total").isNotNull() & (c("total") >= c("times"))
    qty = F.when(good, c("total") / c("samples")).otherwise(freq * (c("amount_lo") + c("amount_hi")) / 2)
    how = (F.when(good, "total over samples").when(c("total").isNotNull(), "midpoint, total inconsistent")
           .when(c("has_amount"), "midpoint").otherwise("unit assumed"))
    return (rows.withColumn("frequency", freq).withColumn("probability", F.least(freq, F.lit(1.0))).withColumn("expected_qty", qty)
            .withColumn("method", how).withColumn("complete", good | c("has_amount")).withColumn("inconsistent", c("total").isNotNull() & ~good)
            .withColumn("reliable", c("samples") >= min_samples))


def value_items(rows: DataFrame, prices: DataFrame, coins: dict[str, float], realisation: dict[str, float], item: str = "item", category: str = "category") -> DataFrame:
    """Direct, sellable or unsellable value per event with the realised share by category."""
    lit_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    coin = F.coalesce(F.try_element_at(lit_map(coins), F.col(item)), F.lit(0.0))
    d = rows.join(prices.select(item, "max_price", "open_price"), item, "left").withColumn("coin", coin)
    kind = F.when(F.col("coin") > 0, "direct").when(F.col("max_price") > 0, "sellable").otherwise("none")
    d = d.withColumn("kind", kind)
    rate = F.when(F.col("kind") == "direct", 1.0).otherwise(F.coalesce(F.try_element_at(lit_map(realisation), F.col(category)), F.lit(REALISATION_DEFAULT)))
    q = F.col("expected_qty")
    sell = lambda p: F.when(F.col("kind") == "sellable", q * F.col(p)).otherwise(0.0)
    return (d.withColumn("rate", rate).withColumn("direct", F.when(F.col("kind") == "direct", q * F.col("coin")).otherwise(0.0))
            .withColumn("sale", sell("max_price")).withColumn("sale_open", sell("open_price")).withColumn("sale_realised", F.col("sale") * F.col("rate")))


def tier(samples) -> Column:
    e = None
    for n, lab in TIERS:
        e = F.when(samples >= n, lab) if e is None else e.when(samples >= n, lab)
    return e.otherwise("insufficient")


def rate_catalogue(valued: DataFrame, page: Sequence[str], key: str, min_samples: int = 100) -> DataFrame:
    """Per page totals with completeness, status and tier; the page with most samples stands for its key."""
    p = valued.groupBy(*page).agg(
        F.max("samples").alias("samples"), F.count("*").alias("items"), F.sum((F.col("kind") != "none").cast("long")).alias("valued_items"),
        F.sum(F.col("complete").cast("long")).alias("complete_items"), F.sum(F.col("inconsistent").cast("long")).alias("inconsistent_items"),
        *[F.sum(c).alias(c) for c in ("direct", "sale", "sale_open", "sale_realised")])
    done = F.col("complete_items") / F.col("items")
    ok = F.col("samples") >= min_samples
    p = p.withColumn("completeness", done).withColumn("confidence", tier(F.col("samples")))
    p = p.withColumn("status", F.when(~ok, "insufficient_sample").when(done == 1, "complete").otherwise("partial"))
    for c in ("direct", "sale", "sale_open", "sale_realised"):
        p = p.withColumn(c, F.when(ok, F.col(c)))
    return last_row(p, [key], ["samples", *[c for c in page if c != key]])


# ------------------------------------------------------------------ daily production
def value_events(events: DataFrame, catalogue: DataFrame, classes: DataFrame, key: str, count: str = "n", by: Sequence[str] = ("entity", "date")) -> DataFrame:
    """Daily sums of counts and expected value by class, and the largest contributor.

    ``events`` is already summed to (entity, date, key), so the joins and the roll-up never see raw rows.
    """
    by = list(by)
    c = F.col
    cat = catalogue.select(key, "status", "confidence", "completeness", "direct", "sale", "sale_open", "sale_realised")
    # one dimension, stored once: its size on disk decides between a broadcast and a salted shuffle
    rates = materialise(cat.join(classes, key, "full"), "catalogue")
    d = enrich(events, rates, [key], "left", spread=by[-1])
    boss, zero = F.coalesce(c("is_boss"), F.lit(False)), F.coalesce(c("known_zero"), F.lit(False))
    usable = ~zero & F.coalesce(c("status").isin("complete", "partial"), F.lit(False))
    n = c(count)
    s = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0)))
    f = lambda cond, v: F.sum(F.when(cond, v).otherwise(0.0))
    contrib = (c("direct") + c("sale")) * n
    main = usable & ~boss
    return d.groupBy(*by).agg(
        F.sum(n).alias("total"), s(boss, n).alias("boss"), s(~boss, n).alias("nonboss"), s(zero, n).alias("known_zero_n"),
        s(usable | zero, n).alias("modeled_all"), s((usable | zero) & ~boss, n).alias("modeled_nonboss"), s(usable & (c("confidence") == "low"), n).alias("low_conf_n"),
        f(main, c("direct") * n).alias("direct"), f(main, c("sale") * n).alias("sale"), f(main, c("sale_open") * n).alias("sale_open"),
        f(main, c("sale_realised") * n).alias("sale_realised"), f(usable & boss, contrib).alias("boss_value"),
        f(main & (c("confidence") == "low"), contrib).alias("low_conf_value"), f(main & (c("completeness") < 1), contrib).alias("assumed_value"),
        F.max_by(key, F.when(main, F.struct(F.round(contrib * 1e4), c(key)))).alias("top_key"), F.max(F.when(main, contrib)).alias("top_value"))


def category_rollup(events: DataFrame, key: str, raw: str, entity="entity", date="date", count="n") -> DataFrame:
    """Totals, spellings, first and last date and number of entities per category."""
    return events.groupBy(key).agg(F.sum(count).alias("total"), F.array_join(F.array_sort(F.collect_set(raw)), "|").alias("spellings"),
                                   F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.countDistinct(entity).alias("entities"))


def derive_daily(raw: DataFrame, population: DataFrame, ladder: Sequence[float] = LADDER, min_coverage: float = 0.80, entity="entity", date="date") -> DataFrame:
    """Coverage, scenario ladder, rates per head, running totals and quality flags, after all merges."""
    c = F.col
    raw = materialise(raw, "daily")
    total = c("direct") + c("sale")
    d = raw.withColumn("coverage", div("modeled_nonboss", "nonboss")).withColumn("potential", total)
    d = d.withColumn("low_conf_share", div("low_conf_value", "potential")).withColumn("top_share", div("top_value", "potential"))
    for x in ladder:
        d = d.withColumn(f"realised_{int(x * 100)}", c("direct") + x * c("sale"))
    spans = raw.groupBy(entity).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    exp = alive_on_date(spans, "lo", "hi", raw.select(date), date)  # a row per date
    exp = exp.join(raw.groupBy(date).agg(F.count("*").alias("reporting")), date)
    d = d.join(exp, date, "left")
    d = d.withColumn("partial_date", c("reporting") < F.ceil(c("expected") * 0.80))
    d = d.withColumn("low_quality", F.coalesce(c("coverage") < min_coverage, F.lit(True)) | c("partial_date"))
    d = d.join(population.select(entity, "population"), entity, "left")
    run = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("per_head", div("potential", "population")).withColumn("per_1000", div(c("potential") * 1000, "nonboss"))
            .withColumn("cumulative", F.sum("potential").over(run)))


def coverage_class(keys: DataFrame, catalogue: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Boss, known zero, modelled, insufficient or missing, with a reason."""
    d = keys.join(catalogue.select(key, "status"), key, "left").join(classes, key, "left")
    boss, zero = F.coalesce(F.col("is_boss"), F.lit(False)), F.coalesce(F.col("known_zero"), F.lit(False))
    st = F.coalesce(F.col("status"), F.lit("absent"))
    lab = S.first_match([(boss, "boss_separate"), (zero, "known_zero"), (st.isin("complete", "partial"), "modeled"), (st == "insufficient_sample", "insufficient_sample")], "missing")
    why = S.first_match([(boss, "kept in the boss series"), (zero, "counted as zero"), (st.isin("complete", "partial"), ""), (st == "insufficient_sample", "too few samples")], "no catalogue entry")
    return d.select(key, lab.alias("coverage_class"), (lab == "modeled").alias("included"), why.alias("reason"))


def quality_metrics(daily: DataFrame) -> DataFrame:
    """(metric, value) table of the production table."""
    c = F.col
    a = daily.agg(F.count("*").cast("double").alias("entity_days"), F.countDistinct("entity").cast("double").alias("entities"),
                  F.sum("total").cast("double").alias("events"), (F.sum("modeled_all") / F.sum("total")).alias("coverage_all"),
                  (F.sum("modeled_nonboss") / F.sum("nonboss")).alias("coverage_nonboss"), F.avg(c("low_quality").cast("double")).alias("low_quality_share"),
                  (F.sum("low_conf_value") / F.sum("potential")).alias("low_conf_value_share"))
    return a.unpivot([], a.columns, "metric", "value")


def join_health(daily: DataFrame, floor: float = 0.5, entity="entity") -> DataFrame:
    """Entities whose modelled share of events falls below the floor."""
    g = daily.groupBy(entity).agg(F.sum("modeled_all").alias("m"), F.sum("total").alias("t"))
    return g.select(entity, div("m", "t").alias("matched"), (div("m", "t") >= floor).alias("healthy"))


def daily_counts(events: DataFrame, special: Sequence[str], shift_days: int = -1, entity="entity", date="date") -> DataFrame:
    """Totals, special and distinct categories, concentration; the date moves to the day described, zero days go."""
    c = F.col
    g = events.groupBy(entity, date).agg(
        F.sum("n").alias("total"), F.sum(F.when(c("category").isin(*special), c("n")).otherwise(0)).alias("special"),
        F.count("*").alias("categories"), F.sum(c("n").cast("double") * c("n")).alias("_sq"), F.max("n").alias("_top"))
    g = g.withColumn("hhi", div("_sq", c("total").cast("double") * c("total"))).withColumn("top_share", div("_top", "total")).drop("_sq", "_top")
    return g.where("total > 0").withColumn(date, F.date_add(date, shift_days))
