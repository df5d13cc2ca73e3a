"""Resampling intervals and their calibration.

A simulation is a set of block starts chosen by hash, so a retried task draws the same path.  Block
sums come from prefix sums of the residuals kept per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators.joins import with_scalars


def residual_blocks(df: DataFrame, keys: Sequence[str], ret: str, order: str, drift_cap: float, min_obs: int = 30, since: Column | None = None) -> DataFrame:
    """Per key: capped and shrunk drift and the prefix sums of the centred returns.

    All rows count unless the caller states a look-back ``since`` (a condition); a key holds at most
    one row per calendar day.
    """
    keys = list(keys)
    d = df.where(F.col(ret).isNotNull() & (F.lit(True) if since is None else since))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ret).alias("mu"), F.stddev(ret).alias("sd"),
                             F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ret).alias("r")))).alias("a")).where(F.col("n") >= min_obs)
    se2 = F.col("sd") * F.col("sd") / F.col("n")
    shrink = F.col("mu") * F.col("mu") / (F.col("mu") * F.col("mu") + se2)
    drift = F.greatest(F.lit(-drift_cap), F.least(F.lit(drift_cap), F.coalesce(shrink * F.col("mu"), F.lit(0.0))))
    pre = F.expr("aggregate(a, array(0D), (s, x) -> array_append(s, element_at(s, -1) + x.r - mu))")
    return g.select(*keys, "n", "mu", "sd", drift.alias("drift"), pre.alias("pre"))


def simulate(blocks: DataFrame, keys: Sequence[str], horizons: Sequence[int], n_sim: int, block: int = 10, seed: int = 17) -> DataFrame:
    """Rows (keys..., h, sim, total): moving-block path sums plus drift."""
    keys = list(keys)
    part = F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_sim - 1) // 250)))).alias("_part")
    d = blocks.select(*keys, "n", "drift", "pre", part).repartition(*keys, "_part")
    d = d.withColumn("sim", F.explode(F.expr(f"sequence(_part * 250, least(_part * 250 + 249, {n_sim - 1}))")))
    d = d.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    keyhash = ", ".join(keys)
    start = f"pmod(xxhash64({seed}, {keyhash}, h, sim, b), greatest(n - {block}, 1))"
    length = f"least({block}, h - b * {block}, n)"
    total = F.expr(f"aggregate(sequence(0, cast(ceil(h / {block}D) as int) - 1), 0D, (s, b) -> s + pre[cast({start} + {length} as int)] - pre[cast({start} as int)])")
    return d.select(*keys, "h", "sim", (total + F.col("drift") * F.col("h")).alias("total"))


def bootstrap_quantiles(sims: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of exp(total) (relative to the last level), 80 % width and P(up); n_sim values per group."""
    g = sims.groupBy(*keys, "h").agg(F.percentile(F.exp("total"), F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
                                     F.avg(F.exp("total")).alias("mean"), F.avg((F.col("total") > 0).cast("double")).alias("prob_up"))
    cols = [F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)]
    return g.select(*keys, "h", *cols, "mean", "prob_up")


def rolling_origins(df: DataFrame, date: str, origins: DataFrame) -> DataFrame:
    """Each row once per origin at or after it; ``origins`` is a short one-column table ``origin``."""
    arr = origins.agg(F.sort_array(F.collect_list("origin")).alias("os"))
    d = with_scalars(df, arr, "_o").withColumn("origin", F.explode("_o.os")).drop("_o")
    return d.where(F.col(date) <= F.col("origin"))


def band_probabilities(sims: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of simulated levels in each [lo, hi) band and the median inside it."""
    e = [-float("inf"), *edges, float("inf")]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(e[i]).alias("lo"), F.lit(e[i + 1]).alias("hi")) for i in range(len(e) - 1)])
    d = sims.withColumn("x", F.exp("total")).withColumn("b", F.explode(bands))
    inside = (F.col("x") >= F.col("b.lo")) & (F.col("x") < F.col("b.hi"))
    return d.groupBy(*by, "h", F.col("b.band").alias("band")).agg(F.avg(inside.cast("double")).alias("probability"),
                                                                 F.percentile(F.when(inside, F.col("x")), F.lit(0.5)).alias("conditional_median"))


def path_histogram(sims: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Counts of log path sums in cells of ``width``: a state that merges and is bounded by the range, not by the paths."""
    return sims.groupBy(*keys, "h", F.floor(F.col("total") / width).cast("long").alias("cell")).agg(F.count("*").alias("n"))


def histogram_quantiles(hist: DataFrame, keys: Sequence[str], probs: Sequence[float], width: float) -> DataFrame:
    """Rows (keys..., h, prob, q): log quantiles from the cells, within ``width`` of the exact lower quantile."""
    group = Window.partitionBy(*keys, "h")  # a row per cell
    d = hist.withColumn("_hi", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(group))
    arr = ", ".join(f"{float(p)!r}D" for p in probs)
    d = d.withColumn("prob", F.explode(F.expr(f"filter(array({arr}), p -> _hi - n <= floor(p * (_n - 1)) and floor(p * (_n - 1)) < _hi)")))
    lo, rank = F.col("_hi") - F.col("n"), F.floor(F.col("prob") * (F.col("_n") - 1))
    return d.select(*keys, "h", "prob", ((F.col("cell") + (rank - lo + 0.5) / F.col("n")) * width).alias("q"))


def level_percentiles(sims: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Rows (keys..., h, level, percentile): share of paths that end below each given level (relative to today's)."""
    at = [F.avg((F.exp("total") < v).cast("double")).alias(str(i)) for i, v in enumerate(levels)]
    g = sims.groupBy(*keys, "h").agg(*at)
    rows = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.col(str(i)).alias("percentile")) for i, v in enumerate(levels)])).alias("z")
    return g.select(*keys, "h", rows).select(*keys, "h", "z.level", "z.percentile")


def coverage(sims: DataFrame, actual: DataFrame, keys: Sequence[str], nominal: Sequence[float]) -> DataFrame:
    """Per (key, h): the realised value's percentile among its simulations and a covered flag per nominal level."""
    j = sims.join(actual, [*keys, "h"])
    probs = [p for a in nominal for p in ((1 - a) / 2, 1 - (1 - a) / 2)]
    g = j.groupBy(*keys, "h").agg(F.percentile("total", F.array(*[F.lit(p) for p in probs])).alias("q"), F.first("actual").alias("actual"),
                                  F.avg((F.col("total") < F.col("actual")).cast("double")).alias("percentile"))
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("nominal"), F.col("q")[2 * i].alias("lo"), F.col("q")[2 * i + 1].alias("hi")) for i, a in enumerate(nominal)])).alias("z")
    d = g.select(*keys, "h", "actual", "percentile", rows).select(*keys, "h", "actual", "percentile", "z.*")
    return d.withColumn("covered", F.col("actual").between(F.col("lo"), F.col("hi")))


def coverage_table(cov: DataFrame) -> DataFrame:
    g = cov.groupBy("h", "nominal").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.count("*").alias("n"))
    err = F.col("coverage") - F.col("nominal")
    return g.withColumn("error", err).withColumn("verdict", F.when(F.abs(err) <= 0.05, "calibrated").when(err > 0, "too wide").otherwise("too narrow"))
