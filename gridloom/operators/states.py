"""Market states: labels from date-grain series, and what a sequence of labels says about itself.

The sequence functions take any number of groups and rows.  A group is cut into blocks of the calendar, each block is
ordered for itself, and one row a block carries the last label and the number of runs into the next block, so a long
group is never ordered in one task.  ``step`` is the width of a block in days; it does not change the result.

Rows without a state or a date take no part.  Rows of a group that share a date follow each other by state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.num import div
from gridloom.operators.joins import with_scalars
from gridloom.session import materialise

SEED = 7


def market_series(panel: DataFrame, entity="entity", date="date") -> DataFrame:
    """Six series of a panel with ``logp``, ``ret_row`` and ``volume``, one row per date on which all exist: mean return,
    dispersion of prices, mean volatility over 14 rows, log activity, share of rising entities, mean volume against
    its own last seven rows."""
    w = Window.partitionBy(entity).orderBy(date)
    f, s = w.rowsBetween(-13, 0), w.rowsBetween(-6, 0)
    rows = panel.select(date, "logp", "volume", "ret_row", F.when(F.count("ret_row").over(f) >= 7, F.stddev("ret_row").over(f)).alias("vol"),
                        div(F.col("volume"), F.avg("volume").over(s)).alias("turn"))
    up = F.when(F.col("ret_row").isNotNull(), (F.col("ret_row") > 0).cast("double"))
    return rows.groupBy(date).agg(F.avg("ret_row").alias("ret"), F.stddev("logp").alias("disp"), F.avg("vol").alias("vol"), F.log(F.sum("volume")).alias("activity"),
                                  F.avg(up).alias("breadth"), F.avg("turn").alias("turnover")).dropna()


def mixture_states(series: DataFrame, cols: Sequence[str], counts: Sequence[int] = (2, 3, 4), date="date") -> DataFrame:
    """``date``, ``cols`` and ``state`` from a Gaussian mixture on the standardised series; of the numbers of states in
    ``counts`` the one with the least Bayesian information criterion.  Columns without spread are left out of the fit."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    # a row per date, written once: spread, scaling, every fit and the labels read it, the panel below is computed once
    d = materialise(series.select(date, *cols).dropna(), "series")
    spread = d.agg(F.count("*"), *[F.stddev_pop(c) for c in cols]).first()
    used = [c for c, s in zip(cols, spread[1:]) if s]
    if not used:
        return d.withColumn("state", F.lit(0))
    x = VectorAssembler(inputCols=used, outputCol="_raw").transform(d)
    x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(x).transform(x).cache()
    try:
        p, best = len(used), None
        for k in counts:
            m = GaussianMixture(featuresCol="_x", predictionCol="state", probabilityCol="_p", k=k, seed=SEED, maxIter=100).fit(x)
            free = k * (p + p * (p + 1) / 2) + k - 1
            bic = -2 * m.summary.logLikelihood + free * math.log(max(spread[0], 1))
            if best is None or bic < best[0]:
                best = (bic, m)
    finally:
        x.unpersist()
    return best[1].transform(x).select(date, *cols, "state")


def order_runs(labels: DataFrame, by: Sequence[str] = (), date="date", state="state", step: int = 366) -> DataFrame:
    """``labels`` with ``prev_state`` (the label before it in its group) and ``run`` (number of its stretch, from 1)."""
    by = list(by)
    d = labels.where(F.col(state).isNotNull() & F.col(date).isNotNull())
    d = d.withColumn("_b", F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / step))
    w = Window.partitionBy(*by, "_b").orderBy(date, state)
    d = d.withColumn("_own", F.lag(state).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    moved = (~F.col("_first") & (F.col("_own") != F.col(state))).cast("long")
    d = d.withColumn("_in", F.sum(moved).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = d.groupBy(*by, "_b").agg(F.min_by(state, F.struct(date, state)).alias("_head"), F.max_by(state, F.struct(date, state)).alias("_tail"), F.max("_in").alias("_n"))
    wb = Window.partitionBy(*by).orderBy("_b")
    edge = edge.withColumn("_before", F.lag("_tail").over(wb))
    opens = (F.col("_before").isNull() | (F.col("_before") != F.col("_head"))).cast("long")
    edge = edge.withColumn("_to", F.sum(F.col("_n") + opens).over(wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_b"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    j = d.alias("l").join(edge.alias("r"), on)
    kept = [F.col(f"l.{c}") for c in labels.columns if c not in ("prev_state", "run")]
    return j.select(*kept, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own")).alias("prev_state"), (F.col("_to") + F.col("_in")).alias("run"))


def state_runs(ordered: DataFrame, by: Sequence[str] = (), date="date", state="state") -> DataFrame:
    """One row per stretch of equal labels: state, first and last date, number of rows."""
    return ordered.groupBy(*by, "run").agg(F.first(state).alias(state), F.min(date).alias("starts"), F.max(date).alias("ends"), F.count("*").alias("days"))


def state_transitions(ordered: DataFrame, by: Sequence[str] = (), state="state") -> DataFrame:
    """Counts of label pairs that follow each other, and their share of all that leave from the first."""
    t = ordered.where("prev_state is not null").groupBy(*by, F.col("prev_state").alias("from_state"), F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from_state")))


def state_profile(ordered: DataFrame, cols: Sequence[str], direction: str, roughness: str, date="date", state="state") -> DataFrame:
    """One row per state: days and their share, means of ``cols``, a name, persistence (share of its days, but for the
    sequence's last, that the same state follows), the expected stay 1 / (1 - persistence) (null if it never leaves),
    and number, mean and longest of its stretches.

    The name says whether ``direction`` is positive on average and whether ``roughness`` is above the median state."""
    prof = ordered.groupBy(state).agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in cols])
    runs = state_runs(ordered, (), date, state).groupBy(F.col(state).alias("_rs")).agg(F.count("*").alias("runs"), F.avg("days").alias("mean_run"), F.max("days").alias("longest_run"))
    t = state_transitions(ordered, (), state).groupBy(F.col("from_state").alias("_fs")).agg(
        F.sum(F.when(F.col("from_state") == F.col("to_state"), F.col("share")).otherwise(0.0)).alias("persistence"))
    d = prof.join(runs, F.col(state) == F.col("_rs")).join(t, F.col(state) == F.col("_fs"), "left").drop("_rs", "_fs")
    d = with_scalars(d, prof.agg(F.sum("days").alias("total"), F.percentile(roughness, F.lit(0.5)).alias("mid")), "_all")
    name = F.concat(F.when(F.col(direction) > 0, "expansion").otherwise("contraction"), F.when(F.col(roughness) > F.col("_all.mid"), ", high volatility").otherwise(", calm"))
    return d.select(state, name.alias("label"), "days", (F.col("days") / F.col("_all.total")).alias("share"), *cols, "persistence",
                    div(F.lit(1.0), 1 - F.col("persistence")).alias("expected_stay"), "runs", "mean_run", "longest_run")
