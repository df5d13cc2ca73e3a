"""Forecast evaluation: folds, splits, baselines, metrics, intervals, calibration, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.num import div, safe_corr
from gridloom.operators.joins import with_scalars
from gridloom.operators.quantiles import exact_quantiles


def pit_histogram(df: DataFrame, pct: str, bins: int = 10) -> DataFrame:
    """Counts per equal-width bin of probability-integral values with each bin's chi-square part."""
    h = df.groupBy(F.least(F.floor(F.round(F.col(pct) * bins, 9)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    g = grid.join(h, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    g = with_scalars(g, h.agg(F.sum("n").alias("tot")))
    exp = F.col("s.tot") / float(bins)
    return g.withColumn("chi2_part", (F.col("n") - exp) ** 2 / exp).drop("s")


def pit_summary(df: DataFrame, pct: str) -> DataFrame:
    """Of probability-integral values: count, mean, and share in the middle half (0.5 if uniform)."""
    return df.where(F.col(pct).isNotNull()).agg(F.count("*").alias("n"), F.avg(pct).alias("mean_percentile"), F.avg(F.col(pct).between(0.25, 0.75).cast("double")).alias("middle_half"))


def test_ledger(families: DataFrame) -> DataFrame:
    """Roll-up of (family, n, status, corrected) by status."""
    return families.groupBy("status").agg(F.count("*").alias("families"), F.sum("n").alias("tests"),
                                          F.avg(F.col("corrected").cast("double")).alias("share_corrected"))


def walk_forward_folds(df: DataFrame, date: str, horizon: int, n: int = 6, start: float = 0.45,
                       scheme: str = "expanding", window: float = 0.45) -> DataFrame:
    """Fold table (fold, train_lo, train_hi, test_lo, test_hi); ``horizon`` days are purged before the test.

    Built from the distinct dates only (calendar-sized).
    """
    d = df.select(F.col(date).alias("d")).distinct().withColumn("g", F.lit(1))
    w = Window.partitionBy("g").orderBy("d")
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    step = (1.0 - start) / n
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold")
    e = d.select("d", "i", "n", k)
    lo = F.floor(F.col("n") * (start + F.col("fold") * step))
    hi = F.least(F.floor(F.col("n") * (start + (F.col("fold") + 1) * step)), F.col("n")) - 1
    first = F.lit(0) if scheme == "expanding" else F.greatest(F.floor(F.col("n") * (start + F.col("fold") * step - window)), F.lit(0))
    g = e.groupBy("fold").agg(
        F.min(F.when(F.col("i") >= first, F.col("d"))).alias("train_lo"),
        F.max(F.when(F.col("i") == lo, F.col("d"))).alias("test_lo"),
        F.max(F.when(F.col("i") == hi, F.col("d"))).alias("test_hi"))
    return g.select("fold", "train_lo", F.date_sub("test_lo", horizon + 1).alias("train_hi"), "test_lo", "test_hi")


def with_folds(df: DataFrame, folds: DataFrame, date: str) -> DataFrame:
    """Rows labelled (fold, part); the fold table has a fixed number of rows and is read once."""
    arr = folds.agg(F.collect_list(F.struct("fold", "train_lo", "train_hi", "test_lo", "test_hi")).alias("fs"))
    d = with_scalars(df, arr, "_f").withColumn("f", F.explode("_f.fs")).drop("_f")
    part = (F.when(F.col(date).between(F.col("f.train_lo"), F.col("f.train_hi")), "train")
            .when(F.col(date).between(F.col("f.test_lo"), F.col("f.test_hi")), "test"))
    return d.withColumn("fold", F.col("f.fold")).withColumn("part", part).drop("f").where("part is not null")


def date_splits(df: DataFrame, date: str, cuts: tuple[float, float] = (0.70, 0.85), purge: int = 7,
                out: str = "split") -> DataFrame:
    """train / validation / holdout by date rank with a purge before each boundary (purged rows dropped)."""
    d = df.select(F.col(date).alias("d")).distinct().withColumn("g", F.lit(1))
    w = Window.partitionBy("g").orderBy("d")
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    edges = d.agg(F.min(F.when(F.col("i") >= F.floor(F.col("n") * cuts[0]), F.col("d"))).alias("a"),
                  F.min(F.when(F.col("i") >= F.floor(F.col("n") * cuts[1]), F.col("d"))).alias("b"))
    x = with_scalars(df, edges, "_e")
    lab = (F.when(F.col(date) <= F.date_sub("_e.a", purge), "train")
           .when((F.col(date) > F.col("_e.a")) & (F.col(date) <= F.date_sub("_e.b", purge)), "validation")
           .when(F.col(date) > F.col("_e.b"), "holdout"))
    return x.withColumn(out, lab).drop("_e").where(f"{out} is not null")


def cut_dates(df: DataFrame, date: str, **shares: float) -> DataFrame:
    """One row: for each name the date at that share of the distinct dates (calendar-sized)."""
    d = df.select(F.col(date).alias("d")).where("d is not null").distinct().withColumn("g", F.lit(1))
    w = Window.partitionBy("g")
    d = d.withColumn("i", F.row_number().over(w.orderBy("d")) - 1).withColumn("n", F.count("*").over(w))
    return d.agg(*[F.min(F.when(F.col("i") >= F.floor(F.col("n") * s), F.col("d"))).alias(k) for k, s in shares.items()])


def metric_columns(y: str, yhat: str, base: Column | None = None) -> list[Column]:
    """RMSE, MAE, out-of-sample R2 against ``base`` (zero by default), direction accuracy, correlation."""
    e = F.col(y) - F.col(yhat)
    b = F.col(y) - (base if base is not None else F.lit(0.0))
    return [
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.sum(F.when(e.isNotNull(), b * b))).alias("r2_oos"),
        F.avg((F.signum(F.col(y)) == F.signum(F.col(yhat))).cast("double")).alias("dir_acc"),
        safe_corr(y, yhat).alias("corr")]


def forecast_metrics(preds: DataFrame, by: Sequence[str], y: str, yhat: str, base: Column | None = None) -> DataFrame:
    return preds.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by).agg(*metric_columns(y, yhat, base))


def level_metrics(preds: DataFrame, by: Sequence[str], actual: str, model: str, within: float = 0.05) -> DataFrame:
    """MAPE %, RMSLE % and share within a relative band for positive levels."""
    rel = F.col(model) / F.col(actual) - 1
    lg = F.log(F.col(model) / F.col(actual))
    return preds.groupBy(*by).agg(
        F.count("*").alias("n"), (F.avg(F.abs(rel)) * 100).alias("mape"), (F.sqrt(F.avg(lg * lg)) * 100).alias("rmsle"),
        F.avg((F.abs(rel) <= within).cast("double")).alias("within"))


def conformal_halfwidths(calib: DataFrame, y: str, yhat: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., prob, q): quantile of the absolute residual on a calibration slice."""
    d = calib.withColumn("_r", F.abs(F.col(y) - F.col(yhat)))
    return exact_quantiles(d, "_r", levels, by)


def interval_coverage(test: DataFrame, widths: DataFrame, y: str, yhat: str) -> DataFrame:
    """Empirical coverage per nominal level; the width table has one row per level."""
    arr = widths.agg(F.collect_list(F.struct("prob", "q")).alias("ws"))
    d = with_scalars(test.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()), arr, "_w").withColumn("w", F.explode("_w.ws"))
    return d.groupBy(F.col("w.prob").alias("nominal")).agg(
        F.count("*").alias("n"), F.avg((F.abs(F.col(y) - F.col(yhat)) <= F.col("w.q")).cast("double")).alias("coverage"),
        F.max("w.q").alias("half_width"))


def fallback_registry(dim: DataFrame, entity: str, levels: Sequence[Sequence[str]], min_size: int = 5) -> DataFrame:
    """Assign each entity the finest level whose group is large enough; the last level takes the rest."""
    d = dim
    for i, cols in enumerate(levels):
        d = d.withColumn(f"n_{i}", F.count("*").over(Window.partitionBy(*cols)))
    last = len(levels) - 1
    level = F.lit("__".join(levels[last]))
    gid = F.concat_ws("__", *levels[last])
    size = F.col(f"n_{last}")
    reason = F.concat(F.lit("finest usable segment below "), F.lit(str(min_size)), F.lit("; pooled to "), level)
    for i in range(last - 1, -1, -1):
        ok = F.col(f"n_{i}") >= min_size
        level = F.when(ok, "__".join(levels[i])).otherwise(level)
        gid = F.when(ok, F.concat_ws("__", *levels[i])).otherwise(gid)
        size = F.when(ok, F.col(f"n_{i}")).otherwise(size)
        why = "exact segment meets the minimum" if i == 0 else f"exact segment too small; pooled to {'__'.join(levels[i])}"
        reason = F.when(ok, why).otherwise(reason)
    d = d.withColumn("group_level", level).withColumn("group_id", gid).withColumn("model_size", size)
    d = d.withColumn("low_sample", F.col("model_size") < min_size).withColumn("reason", reason)
    return d.withColumn("assigned", F.count("*").over(Window.partitionBy("group_id")))


def select_best(cands: DataFrame, by: Sequence[str], metric: str, name: str) -> DataFrame:
    """Candidate with the smallest metric per group; ties by name."""
    return cands.groupBy(*by).agg(F.min_by(name, F.struct(F.round(F.col(metric) * 1e9), name)).alias("selected"),
                                  F.min(metric).alias(metric))


def cohort_split(dim: DataFrame, by: str, order: Sequence[str], holdout: float = 0.30, validation: float = 0.25) -> DataFrame:
    """Newest share held out per type, a share of the rest for validation, by creation order."""
    w = Window.partitionBy(by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(by))
    i = F.row_number().over(w)
    n_hold = F.ceil(n * holdout)
    n_val = F.ceil((n - n_hold) * validation)
    lab = F.when(i > n - n_hold, "holdout").when(i > n - n_hold - n_val, "validation").otherwise("train")
    return dim.withColumn("cohort", lab)


def target_encoding(train: DataFrame, key: str, y: str, kappa: float = 20.0) -> DataFrame:
    """Smoothed group mean (sum + prior * kappa) / (n + kappa) from training rows."""
    g = train.groupBy(key).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    g = with_scalars(g, train.agg(F.avg(y).alias("prior")), "p")
    return g.select(key, "n", ((F.col("s") + F.col("p.prior") * kappa) / (F.col("n") + kappa)).alias("encoded"))


def out_of_fold_encoding(train: DataFrame, key: str, fold: str, y: str, kappa: float = 20.0) -> DataFrame:
    """(key, fold, encoded): the smoothed mean of ``y`` over the key's rows of all other folds.

    A fold's share is subtracted from the totals of its key and of the table, so one aggregate
    serves all folds and no row sees its own target.  A key that lives in one fold only gets the
    others' mean.
    """
    cell = train.groupBy(key, fold).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.count(y).alias("n"))
    own = cell.groupBy(F.col(key).alias("_k")).agg(F.sum("s").alias("ks"), F.sum("n").alias("kn"))
    per = cell.groupBy(F.col(fold).alias("_f")).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    d = cell.join(own, F.col(key).eqNullSafe(F.col("_k"))).join(per, F.col(fold).eqNullSafe(F.col("_f")))
    d = with_scalars(d, cell.agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "t")
    prior = div(F.col("t.s") - F.col("fs"), F.col("t.n") - F.col("fn"))
    code = (F.col("ks") - F.col("s") + prior * kappa) / (F.col("kn") - F.col("n") + kappa)
    return d.select(key, fold, code.alias("encoded"))


def fold_stability(df: DataFrame, by: Sequence[str], fold: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, fold).alias("first"), F.max_by(value, fold).alias("last"),
                               F.avg(value).alias("mean"), F.count("*").alias("n_folds"))


def binned_mutual_information(df: DataFrame, x_bin: str, y_bin: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information in nats from joint bin counts."""
    by = list(by)
    j = df.where(F.col(x_bin).isNotNull() & F.col(y_bin).isNotNull()).groupBy(*by, x_bin, y_bin).agg(F.count("*").alias("c"))
    # at most bins x bins rows per group
    px = j.groupBy(*by, x_bin).agg(F.sum("c").alias("cx"))
    py = j.groupBy(*by, y_bin).agg(F.sum("c").alias("cy"))
    d = j.join(px, [*by, x_bin]).join(py, [*by, y_bin])
    if by:
        d = d.join(j.groupBy(*by).agg(F.sum("c").alias("n")), by)
    else:
        d = with_scalars(d, j.agg(F.sum("c").alias("n"))).withColumn("n", F.col("s.n"))
    p = F.col("c") / F.col("n")
    return d.groupBy(*by).agg(F.sum(p * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"), F.max("n").alias("n"))


def feature_family(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], default: str = "other") -> DataFrame:
    """Label features by name pattern; first pattern wins."""
    expr = None
    for pat, lab in rules:
        c = F.col(name).rlike(pat)
        expr = F.when(c, lab) if expr is None else expr.when(c, lab)
    return df.withColumn("family", expr.otherwise(default))


def recompute_agreement(published: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Published against recomputed values within a tolerance; a missing side is a violation."""
    a = published.select(*keys, F.col(value).alias("published"))
    b = recomputed.select(*keys, F.col(value).alias("recomputed"))
    ok = F.abs(F.col("published") - F.col("recomputed")) <= tol
    return a.join(b, list(keys), "full").withColumn("agrees", F.coalesce(ok, F.lit(False)))


def share(numer: Column, denom: Column) -> Column:
    return div(numer, denom)
