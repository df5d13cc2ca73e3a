"""Inference on series and result rows: HAC means, loss differentials, multiplicity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _two_sided(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for z in parts:
        yield z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan"))


def chi2_tail(df: DataFrame, stat: str, dof: str, out: str) -> DataFrame:
    """Upper tail of a chi-square statistic with whole degrees of freedom.

    Q(k, x) is exp(-x/2) times a finite sum for even k; for odd k the sum starts from the normal tail.
    """
    half, k = F.col(stat) / 2.0, F.col(dof)
    start = F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.col("_two_sided"))
    first = F.when(k % 2 == 0, F.exp(-half)).otherwise(F.exp(-half) * F.sqrt(half) * (2.0 / math.sqrt(math.pi)))
    terms = F.when(k % 2 == 0, k / 2).otherwise((k - 1) / 2).cast("int")
    gap = F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    d = normal_tail(df.withColumn("_z", F.sqrt(stat)), "_z", "_two_sided")
    d = d.withColumn("_q", F.struct(start.alias("s"), first.alias("t"), half.alias("h"), gap.alias("g"), terms.alias("n")))
    total = F.expr("aggregate(sequence(1, greatest(_q.n, 1)), named_struct('s', _q.s, 't', _q.t), (a, i) -> named_struct('s', a.s + a.t, 't', a.t * _q.h / (i + _q.g))).s")
    return d.withColumn(out, F.when(F.col("_q.n") > 0, F.least(total, F.lit(1.0))).otherwise(F.col("_two_sided"))).drop("_z", "_two_sided", "_q")


def normal_tail(df: DataFrame, z: str, out: str = "p") -> DataFrame:
    """Two-sided normal p-value; meant for small result tables."""
    return df.withColumn(out, F.nanvl(_two_sided(z), F.lit(None).cast("double")))


def lag_rule(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9))."""
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def per_date_mean(df: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """One value per date: cross-sectional copies of one day are not independent."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, date).agg(F.avg(value).alias(value))


def nw_mean(series: DataFrame, value: str, order: str, by: Sequence[str] = (), lags=None) -> DataFrame:
    """Newey-West mean, se and t per group of a date-grain series.

    The Bartlett sum equals sum(S_t^2) / (L + 1) with S_t the sum of the last L + 1 residuals of
    the zero-padded series, so running sums and one equi-join on the row index give it for any
    number of lags.  ``lags``: None for the sample-size rule, an int, or a column name.
    """
    by = list(by)
    s = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("_x"),
                                                      *([lags] if isinstance(lags, str) and lags not in by else []))
    if not by:
        s, by = s.withColumn("_g", F.lit(1)), ["_g"]
    wg = Window.partitionBy(*by)
    wo = wg.orderBy(order)
    s = s.withColumn("n", F.count("*").over(wg)).withColumn("mean", F.avg("_x").over(wg))
    e = F.col("_x") - F.col("mean")
    lag = lag_rule(F.col("n")) if lags is None else (F.col(lags).cast("int") if isinstance(lags, str) else F.lit(int(lags)))
    s = s.select(*by, "n", "mean", lag.alias("lag"), F.row_number().over(wo).cast("int").alias("_i"),
                 F.sum(e).over(wo.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))
    prev = s.select(*by, (F.col("_i") + F.col("lag") + 1).alias("_i"), F.col("_c").alias("_p"))
    j = s.join(prev, [*by, "_i"], "left")
    head = F.col("_c") - F.coalesce("_p", F.lit(0.0))
    # padded positions n+1..n+L hold the sums of the final 1..L residuals, which are -c of the
    # rows n-L..n-1 because residuals add up to zero
    late = (F.col("_i") >= F.col("n") - F.col("lag")) & (F.col("_i") < F.col("n"))
    wt = F.when(late, F.col("_c") * F.col("_c")).otherwise(0.0)
    g = j.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("lag").alias("lag"),
                           F.sum(head * head).alias("_head"), F.sum(wt).alias("_tail"))
    lrv = (F.col("_head") + F.col("_tail")) / (F.col("lag") + 1) / F.col("n")
    out = g.select(*[b for b in by if b != "_g"], "n", "mean", "lag",
                   F.sqrt(F.greatest(lrv, F.lit(0.0)) / F.col("n")).alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def nw_panel(df: DataFrame, value: str, date: str, by: Sequence[str] = (), lags=None) -> DataFrame:
    """Per-date collapse followed by ``nw_mean``."""
    keep = list(by) + ([lags] if isinstance(lags, str) and lags not in by else [])
    return nw_mean(per_date_mean(df, keep, date, value), value, date, by, lags)


def independent_windows(df: DataFrame, date: str, h: Column | int, by: Sequence[str]) -> DataFrame:
    """Non-overlapping h-day windows the sample spans."""
    hh = F.lit(h) if isinstance(h, int) else h
    return df.groupBy(*by).agg(F.floor(F.datediff(F.max(date), F.min(date)) / F.max(hh)).alias("windows"))


def diebold_mariano(preds: DataFrame, by: Sequence[str], date: str, y: str, a: str, b: str, lags: str | int) -> DataFrame:
    """HAC t of the per-date squared-error differential (a minus b)."""
    d = (F.col(y) - F.col(a)) ** 2 - (F.col(y) - F.col(b)) ** 2
    return nw_panel(preds.withColumn("loss_diff", d), "loss_diff", date, by, lags)


def stouffer(df: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(z) / F.sqrt(F.count(z))).alias("z_combined"), F.count(z).alias("k"),
                               F.sum((F.col(z) < 0).cast("long")).alias("n_better"))


def sidak(p: str, m: Column | int) -> Column:
    mm = F.lit(m) if isinstance(m, int) else m
    return 1 - F.pow(1 - F.col(p), mm)


def bh(df: DataFrame, p: str, keys: Sequence[str], alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg on a result table: the per-row flag p <= i/m*alpha and the step-up flag."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    d = df.withColumn("bh_rank", F.row_number().over(part.orderBy(p, *keys)).cast("long"))
    d = d.withColumn("m", F.count(p).over(part))
    d = d.withColumn("bh_row", F.col(p) <= F.col("bh_rank") / F.col("m") * alpha)
    last = F.max(F.when(F.col("bh_row"), F.col("bh_rank"))).over(part)
    return d.withColumn("bh_step_up", F.coalesce(F.col("bh_rank") <= last, F.lit(False)))


def retest_states(cells: DataFrame, coef: str, p: str, slope: str, t: str, windows: str, alpha: float = 0.05, min_windows: int = 3, bar: float = 2.0) -> DataFrame:
    """``cells`` with ``state``: what a second sample says about the cells that a first one selected.

    ``coef`` and ``p`` come from the selection, ``slope`` and ``t`` from the re-test, ``windows`` counts the horizons
    that follow each other without overlap in it.  A cell is "not selected" (p of at least ``alpha``, or none),
    "not estimable" (fewer than ``min_windows``, or no t), "reversed" (the signs differ), "survives" (|t| above ``bar``)
    or "fades".  A cell that cannot be estimated never counts as a survivor, whatever its t.
    """
    state = (F.when(F.coalesce(F.col(p) >= alpha, F.lit(True)), "not selected")
             .when(F.coalesce(F.col(windows) < min_windows, F.lit(True)) | F.col(t).isNull() | F.isnan(t), "not estimable")
             .when(F.signum(slope) != F.signum(coef), "reversed")
             .when(F.abs(t) > bar, "survives").otherwise("fades"))
    return cells.withColumn("state", state)


def retest_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells, selected, estimable, reversed and surviving ones."""
    count = lambda c: F.count(F.when(c, 1))
    s = F.col("state")
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), count(s != "not selected").alias("selected"), count(~s.isin("not selected", "not estimable")).alias("estimable"),
                                  count(s == "reversed").alias("reversed"), count(s == "survives").alias("survive"))
