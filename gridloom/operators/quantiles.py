"""Exact quantiles, ranks and running sums over an ordering too large for one task.

Rows are first reduced to distinct (group, value) with weights, combined before the shuffle, and then
range-partitioned by (group, value) together: Spark samples the boundaries, so a group with most of
the values is cut into many ranges and small groups share one.  One row per (group, range) carries
the prefix sums of the ranges before it.  A rank is the prefix of its range plus a running sum inside
the range; a quantile first finds the ranges that hold its ranks among the prefixes, and only those
ranges are ordered.  No group is gathered in one task and the answers equal a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.num import safe_corr
from gridloom.operators.joins import enrich, with_scalars
from gridloom.session import materialise


def _ranged(df: DataFrame, value: str, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, v) with weight w and summed columns, and the range ``b`` they were dealt to.

    Written once: the range of a value must not change between the passes that read it.
    """
    base = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("w"), *[F.sum(c).alias(c) for c in sums])
    )
    return materialise(base.repartitionByRange(*by, "v").withColumn("b", F.spark_partition_id()), "ranks")


def _prefixes(ranged: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per (by, b): totals ``t_``, the totals of the ranges before it ``o_`` and of the group ``g_`` (one row a range)."""
    per = ranged.groupBy(*by, "b").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *by, "b", *[F.col(f"t_{c}") for c in sums], *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in sums],
        *[F.sum(f"t_{c}").over(group).alias(f"g_{c}") for c in sums])


def _with_ranges(ranged: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of the given ranges with the ranges' columns; null groups meet too."""
    keys = [f"_r{i}" for i in range(len(by))]
    r = ranges.select(*[F.col(k).alias(n) for k, n in zip(by, keys)], F.col("b").alias("_b"), *[c for c in ranges.columns if c not in (*by, "b")])
    same = [F.col("b") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, keys)]]
    return ranged.join(r, same).drop("_b", *keys)


def running(df: DataFrame, value: str, by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Distinct values with weight ``w``, ``c_x`` = sum of x over values <= v, ``g_x`` = group total."""
    by = list(by)
    cols = ["w", *sums]
    ranged = _ranged(df, value, by, sums)
    w = Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.select(*by, "b", "v", *cols, *[F.sum(c).over(w).alias(f"i_{c}") for c in cols])
    j = _with_ranges(inner, _prefixes(ranged, by, cols), by)
    return j.select(*by, "v", *cols, *[(F.col(f"i_{c}") + F.col(f"o_{c}")).alias(f"c_{c}") for c in cols], *[f"g_{c}" for c in cols])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., prob, q): linear-interpolated quantiles, equal to sorting the whole group."""
    by = list(by)
    ranged = _ranged(df, value, by)
    arr = ", ".join(f"{float(x)!r}D" for x in probs)
    # 0-based ranks lo .. hi - 1: the probabilities that need one of them
    held = lambda lo, hi, n: F.expr(f"filter(array({arr}), p -> ({lo} <= floor(p * ({n} - 1)) and floor(p * ({n} - 1)) < {hi}) or ({lo} <= ceil(p * ({n} - 1)) and ceil(p * ({n} - 1)) < {hi}))")
    ranges = _prefixes(ranged, by, ["w"]).withColumn("_end", F.col("o_w") + F.col("t_w"))
    ranges = ranges.where(F.size(held("o_w", "_end", "g_w")) > 0).select(*by, "b", "o_w", "g_w")
    w = Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = _with_ranges(ranged, ranges, by).withColumn("hi", F.sum("w").over(w) + F.col("o_w")).withColumn("lo", F.col("hi") - F.col("w"))
    r = run.select(*by, "v", "lo", "hi", F.col("g_w").alias("n"), F.explode(held("lo", "hi", "g_w")).alias("prob"))
    h = F.col("prob") * (F.col("n") - 1)
    k0, k1 = F.floor(h), F.ceil(h)
    has0 = (F.col("lo") <= k0) & (k0 < F.col("hi"))
    has1 = (F.col("lo") <= k1) & (k1 < F.col("hi"))
    return (
        r.groupBy(*by, "prob")
        .agg(F.max(F.when(has0, F.col("v"))).alias("v0"), F.max(F.when(has1, F.col("v"))).alias("v1"),
             F.max("n").alias("n"))
        .select(*by, "prob",
                (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("prob") * (F.col("n") - 1)
                 - F.floor(F.col("prob") * (F.col("n") - 1)))).alias("q"), F.col("n").alias("n_obs"))
    )


def quantile_row(df: DataFrame, value: str, named: dict[str, float]) -> DataFrame:
    """One row with a column per named probability."""
    q = exact_quantiles(df, value, list(named.values()))
    return q.agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("q"))).alias(n) for n, p in named.items()])


def quantile_wide(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str]) -> DataFrame:
    """One row per group with a column per named probability."""
    q = exact_quantiles(df, value, list(named.values()), by)
    return q.groupBy(*by).agg(
        *[F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("q"))).alias(n) for n, p in named.items()])


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., v, avg_rank, n): rank with ties averaged."""
    run = running(df, value, by)
    return run.select(*by, "v", (F.col("c_w") - (F.col("w") - 1) / 2.0).alias("avg_rank"), F.col("g_w").alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with averaged ties over complete pairs."""
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    d = materialise(d, "pairs")
    rx = average_rank(d, x, by).select(*by, F.col("v").alias(x), F.col("avg_rank").alias("rx"))
    ry = average_rank(d, y, by).select(*by, F.col("v").alias(y), F.col("avg_rank").alias("ry"))
    return d.join(rx, [*by, x]).join(ry, [*by, y]).groupBy(*by).agg(
        safe_corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def bin_edges(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Array ``edges`` of the k-1 inner quantile edges per group, duplicates dropped."""
    q = exact_quantiles(df, value, [i / k for i in range(k + 1)], by)
    return q.groupBy(*by).agg(F.array_sort(F.collect_set("q")).alias("edges"))


def quantile_bins(df: DataFrame, value: str, k: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Right-closed quantile bins 1..k, lowest value included, duplicate edges dropped.

    The edges, at most k + 1 a group, are written first, so that their real size decides between a
    broadcast and a salted join.
    """
    by = list(by)
    e = bin_edges(df, value, k, by)
    if by:
        j = enrich(df, materialise(e, "edges"), by, "inner", spread=value)
    else:
        j = with_scalars(df, e, "_e").withColumn("edges", F.col("_e.edges")).drop("_e")
    idx = F.greatest(F.expr(f"size(filter(edges, c -> c < {value}))"), F.lit(1)).cast("long")
    return j.withColumn(out, F.when(F.col(value).isNotNull(), idx)).drop("edges")
