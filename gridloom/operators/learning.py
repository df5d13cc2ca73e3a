"""Spark ML models on panel features: walk-forward fits, selection, importance, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.num import div, safe_corr
from gridloom.session import materialise
from gridloom.operators.joins import with_scalars
from gridloom.operators.strategy import split_date

SEED = 13
TREES, ROUNDS = 100, 20


def regressors(label: str = "y", features: str = "features") -> dict:
    a = {"labelCol": label, "featuresCol": features}
    return {
        "ols": LinearRegression(**a), "ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0, **a),
        "elastic_net": LinearRegression(regParam=0.01, elasticNetParam=0.5, **a),
        "forest": RandomForestRegressor(numTrees=TREES, maxDepth=5, seed=SEED, **a),
        "boosted": GBTRegressor(maxIter=ROUNDS, maxDepth=3, seed=SEED, **a)}


def classifiers(label: str = "y", features: str = "features") -> dict:
    a = {"labelCol": label, "featuresCol": features}
    return {"forest": RandomForestClassifier(numTrees=TREES, maxDepth=5, seed=SEED, **a), "boosted": GBTClassifier(maxIter=ROUNDS, maxDepth=3, seed=SEED, **a)}


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Complete rows with a feature vector."""
    d = df.dropna(subset=[*features, label]).where(F.abs(F.col(label)) != float("inf"))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(d)


def fit_linear_split(df: DataFrame, features: Sequence[str], label: str, date: str, share: float = 0.7, purge: int = 1) -> DataFrame:
    """Fit before the split date (purged), predict after it."""
    d = with_scalars(assembled(df, features, label), split_date(df, share, date), "_s")
    tr = d.where(F.col(date) <= F.date_sub("_s.split", purge))
    m = LinearRegression(labelCol=label, featuresCol="features", regParam=1e-6).fit(tr)
    return m.transform(d.where(F.col(date) > F.col("_s.split"))).drop("_s", "features")


def fit_predict(df: DataFrame, folds: DataFrame, features: Sequence[str], label: str, models: dict, date: str = "date", keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions (fold, model, keys..., y, yhat): one distributed fit per fold and model.

    The driver loops over a handful of folds; each fit and transform runs on the cluster.
    """
    d = materialise(assembled(df, features, label).select(*keep, date, F.col(label).alias("y"), "features"), "folds")
    out = None
    for f in folds.orderBy("fold").collect():
        tr = d.where(F.col(date).between(f["train_lo"], f["train_hi"]))
        te = d.where(F.col(date).between(f["test_lo"], f["test_hi"]))
        for name, est in models.items():
            m = est.copy({est.labelCol: "y"}).fit(tr)
            p = m.transform(te).select(F.lit(f["fold"]).alias("fold"), F.lit(name).alias("model"), *keep, date, "y", F.col("prediction").alias("yhat"))
            out = p if out is None else out.unionByName(p)
    return out


def class_scores(df: DataFrame, folds: DataFrame, features: Sequence[str], label: str, models: dict, date: str = "date") -> DataFrame:
    """(fold, model, y, p) for binary targets."""
    from pyspark.ml.functions import vector_to_array

    d = materialise(assembled(df, features, label).select(date, F.col(label).alias("y"), "features"), "folds")
    out = None
    for f in folds.orderBy("fold").collect():
        tr = d.where(F.col(date).between(f["train_lo"], f["train_hi"]))
        te = d.where(F.col(date).between(f["test_lo"], f["test_hi"]))
        for name, est in models.items():
            m = est.copy({est.labelCol: "y"}).fit(tr)
            p = m.transform(te).select(F.lit(f["fold"]).alias("fold"), F.lit(name).alias("model"), "y", vector_to_array("probability")[1].alias("p"))
            out = p if out is None else out.unionByName(p)
    return out


def class_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC from ranks, Brier score and its skill against the base rate; NULL where one class is missing."""
    from gridloom.operators.quantiles import running

    by = list(by)
    d = scores.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    run = running(d, "p", by, ["y"])  # distinct scores in ranges: no fold is sorted in one task
    a = run.groupBy(*by).agg(F.sum((F.col("c_w") - (F.col("w") - 1) / 2.0) * F.col("y")).alias("r1"), F.max("g_y").alias("n1"), F.max("g_w").alias("n"))
    auc = div(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * (F.col("n") - F.col("n1")))
    b = d.groupBy(*by).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("y").alias("base"))
    return a.join(b, by).select(*by, "n", auc.alias("auc"), "brier", (1 - div("brier", F.col("base") * (1 - F.col("base")))).alias("skill"))


def fit_save(df: DataFrame, features: Sequence[str], label: str, path: str) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), LinearRegression(labelCol=label, featuresCol="features", regParam=1e-6)]
    m = Pipeline(stages=stages).fit(df.dropna(subset=[*features, label]))
    m.write().overwrite().save(path)
    return m


def score_latest(df: DataFrame, path: str, features: Sequence[str], half_widths: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """Latest complete row per entity scored by a saved pipeline, with conformal bounds."""
    from gridloom.operators.aggs import last_row

    last = last_row(df.dropna(subset=list(features)).select(entity, date, *features), [entity], [date])
    p = PipelineModel.load(path).transform(last)
    p = with_scalars(p, half_widths.agg(F.max("q").alias("q")), "w")
    return p.select(entity, F.col(date).alias("as_of"), "prediction", (F.col("prediction") - F.col("w.q")).alias("lo"), (F.col("prediction") + F.col("w.q")).alias("hi"))


def shuffled(df: DataFrame, col: str, key: Sequence[str], seed: int = SEED, parts: int = 64, group: Sequence[str] = ()) -> DataFrame:
    """Column permuted by hash within ``parts`` random parts of each group: no ordering of the whole table, and the same result on every cluster."""
    group = list(group)
    d = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *group, *key), F.lit(parts)))
    w = Window.partitionBy(*group, "_part")
    a = d.withColumn("_slot", F.row_number().over(w.orderBy(*key)))
    b = d.select(*group, "_part", F.col(col).alias("_v"), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed + 1), F.lit(col), *group, *key), *key)).alias("_slot"))
    return a.drop(col).join(b, [*group, "_part", "_slot"]).withColumnRenamed("_v", col).drop("_part", "_slot")


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str, key: Sequence[str], repeats: int = 10) -> DataFrame:
    """Rise of the squared error when one feature is shuffled: mean and spread over ``repeats`` shuffles.

    The repeats of a feature are one pass: rows carry their repeat, and each repeat is shuffled in itself.
    """
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    error = (F.col(label) - F.col("prediction")) ** 2
    test = materialise(test.select(*key, *features, label), "importance")
    base = model.transform(asm.transform(test)).agg(F.avg(error).alias("mse"))
    copies = test.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    parts = None
    for f in features:
        d = shuffled(copies, f, key, group=["_rep"])
        p = model.transform(asm.transform(d)).groupBy("_rep").agg(F.avg(error).alias("mse")).select(F.lit(f).alias("feature"), "mse")
        parts = p if parts is None else parts.unionByName(p)
    rise = F.col("mse") - F.col("b.mse")
    return with_scalars(parts, base, "b").groupBy("feature").agg(F.avg(rise).alias("importance"), F.stddev(rise).alias("spread"), F.count("*").alias("repeats"))


# ------------------------------------------------------------------ linear scopes from moments
def scope_predictions(train: DataFrame, test: DataFrame, y: str, x: str, entity: str, region: str, lam: float = 50.0) -> DataFrame:
    """Long predictions of one-regressor models fitted globally, per region, per entity and shrunk to the global one."""
    fit = lambda by: train.groupBy(*by).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.count("*").alias("n"))
    t = with_scalars(test, fit([]), "g")
    t = t.join(F.broadcast(fit([region]).select(region, F.col("a").alias("ra"), F.col("b").alias("rb"))), region, "left")
    t = t.join(fit([entity]).select(entity, F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("n").alias("en")), entity, "left")
    p = lambda a, b: F.col(a) + F.col(b) * F.col(x)
    w = F.coalesce(F.col("en") / (F.col("en") + lam), F.lit(0.0))
    own = F.coalesce(p("ea", "eb"), p("g.a", "g.b"))
    t = t.select(*test.columns, p("g.a", "g.b").alias("global"), F.coalesce(p("ra", "rb"), p("g.a", "g.b")).alias("regional"), own.alias("entity_own"),
                 (w * own + (1 - w) * p("g.a", "g.b")).alias("shrunk"))
    return t.unpivot(test.columns, ["global", "regional", "entity_own", "shrunk"], "scope", "yhat")


def encoded_predictions(train: DataFrame, test: DataFrame, y: str, x: str, key: str, fold: str, kappa: float = 20.0) -> DataFrame:
    """Predictions of a pooled model on ``x`` and the key's target code: out-of-fold codes in training, full ones in the test."""
    from gridloom.operators.evaluation import out_of_fold_encoding, target_encoding
    from gridloom.operators.joins import enrich

    codes = materialise(out_of_fold_encoding(train, key, fold, y, kappa), "codes")
    full = target_encoding(train, key, y, kappa)
    full = materialise(full.select(key, "encoded"), "codes")
    prior = train.agg(F.avg(y).alias("prior"))
    d = enrich(train, codes, [key, fold], "inner", spread=x).where(F.col(y).isNotNull() & F.col(x).isNotNull())
    m = d.agg(F.avg(y).alias("my"), F.avg(x).alias("mx"), F.avg("encoded").alias("mz"), F.var_pop(x).alias("xx"), F.var_pop("encoded").alias("zz"),
              F.covar_pop(x, "encoded").alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop("encoded", y).alias("zy"))
    c = F.col
    det = c("xx") * c("zz") - c("xz") * c("xz")
    m = m.withColumn("b", F.when(det > 0, (c("xy") * c("zz") - c("zy") * c("xz")) / det)).withColumn("g", F.when(det > 0, (c("zy") * c("xx") - c("xy") * c("xz")) / det))
    t = with_scalars(with_scalars(enrich(test, full, [key], "left", spread=x), m, "m"), prior, "p")
    code = F.coalesce(c("encoded"), c("p.prior"))
    return t.select(*test.columns, (c("m.my") + c("m.b") * (c(x) - c("m.mx")) + c("m.g") * (code - c("m.mz"))).alias("yhat"))


def band_conditional(train: DataFrame, test: DataFrame, y: str, x: str, band: float) -> DataFrame:
    """One-regressor forecasts pooled and per side of the band, scored on the test rows of each side."""
    side = lambda d: d.withColumn("regime", F.when(F.abs(x) > band, "outside").otherwise("inside"))
    tr, te = side(train), side(test)
    pooled = tr.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    own = tr.groupBy("regime").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    t = with_scalars(te, pooled, "p").join(F.broadcast(own), "regime")
    sse = lambda e: F.sum(e * e)
    return t.groupBy("regime").agg(
        F.count("*").alias("n"), (1 - sse(F.col(y) - F.col("p.a") - F.col("p.b") * F.col(x)) / sse(F.col(y))).alias("r2_pooled"),
        (1 - sse(F.col(y) - F.col("a") - F.col("b") * F.col(x)) / sse(F.col(y))).alias("r2_own"))


def exposure_oos(df: DataFrame, y: str, exposures: Sequence[str], entity: str = "entity", date: str = "date", share: float = 0.7) -> DataFrame:
    """Entity-demeaned slope on early dates applied to later ones; RMSE gain over zero as a fraction."""
    cells = F.array(*[F.struct(F.lit(e).alias("exposure"), F.col(e).alias("x")) for e in exposures])
    d = df.select(entity, date, F.col(y).alias("y"), F.explode(cells).alias("c")).select(entity, date, "y", "c.*").where("x is not null and y is not null")
    d = with_scalars(d, split_date(df, share, date), "s").withColumn("train", F.col(date) <= F.col("s.split")).drop("s")
    w = Window.partitionBy("exposure", entity)
    tr = lambda c: F.avg(F.when(F.col("train"), F.col(c))).over(w)
    d = d.select("exposure", "train", "y", tr("y").alias("my"), (F.col("x") - tr("x")).alias("xd"))
    b = d.where("train").groupBy("exposure").agg((F.sum(F.col("xd") * (F.col("y") - F.col("my"))) / F.sum(F.col("xd") * F.col("xd"))).alias("b"))
    t = d.where("not train and my is not null").join(F.broadcast(b), "exposure")
    e = F.col("y") - F.col("my") - F.col("b") * F.col("xd")
    return t.groupBy("exposure").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rmse_zero")).withColumn(
        "gain_frac", 1 - F.col("rmse") / F.col("rmse_zero"))


# ------------------------------------------------------------------ selection and explanation
def boruta(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], rounds: int = 20, alpha: float = 0.05) -> DataFrame:
    """Hits of each feature over the best shuffled shadow in repeated forests.

    Under the null a feature beats all shadows once in (features + 1) rounds; ``p`` is the binomial
    tail of its hits, and a feature is confirmed if the tail times the number of features stays
    below ``alpha``.
    """
    import math

    hits = dict.fromkeys(features, 0)
    base = df.select(*key, *features, label).dropna().persist()
    for r in range(rounds):
        d = base
        for f in features:
            d = shuffled(d.withColumn(f"s_{f}", F.col(f)), f"s_{f}", key, SEED + r)
        allf = [*features, *[f"s_{f}" for f in features]]
        m = RandomForestRegressor(numTrees=30, maxDepth=5, seed=SEED + r, labelCol=label, featuresCol="features").fit(assembled(d, allf, label))
        imp = dict(zip(allf, m.featureImportances.toArray()))
        best = max(imp[f"s_{f}"] for f in features)
        for f in features:
            hits[f] += int(imp[f] > best)
    base.unpersist()
    q = 1.0 / (len(features) + 1)
    tail = lambda h: sum(math.comb(rounds, k) * q**k * (1 - q) ** (rounds - k) for k in range(h, rounds + 1))
    rows = [(f, h, tail(h), "confirmed" if tail(h) * len(features) < alpha else "rejected") for f, h in hits.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, hits int, p double, verdict string")


def selection_methods(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(method, feature, rank): recursive elimination, lasso entry, forest importance, absolute correlation."""
    d = assembled(df, features, label).persist()
    sd = d.agg(*[F.stddev(f).alias(f) for f in features]).first()
    rows = []
    left = list(features)
    while left:
        v = VectorAssembler(inputCols=left, outputCol="fv").transform(d)
        m = LinearRegression(labelCol=label, featuresCol="fv", regParam=1e-6).fit(v)
        strength = {f: abs(c) * (sd[f] or 0.0) for f, c in zip(left, m.coefficients.toArray())}
        worst = min(left, key=lambda f: (strength[f], f))
        rows.append(("elimination", worst, len(left)))
        left.remove(worst)
    entered: list[str] = []
    for reg in (0.1, 0.03, 0.01, 0.003, 0.001, 1e-5):
        m = LinearRegression(labelCol=label, featuresCol="features", regParam=reg, elasticNetParam=1.0).fit(d)
        for f, c in zip(features, m.coefficients.toArray()):
            if abs(c) > 1e-12 and f not in entered:
                entered.append(f)
    entered += [f for f in features if f not in entered]
    rows += [("lasso", f, i + 1) for i, f in enumerate(entered)]
    imp = RandomForestRegressor(numTrees=TREES, maxDepth=5, seed=SEED, labelCol=label, featuresCol="features").fit(d).featureImportances.toArray()
    cor = d.agg(*[F.abs(safe_corr(f, label)).alias(f) for f in features]).first()
    for name, score in (("forest", dict(zip(features, imp))), ("correlation", cor.asDict())):
        rows += [(name, f, i + 1) for i, f in enumerate(sorted(features, key=lambda f: (-(score[f] or 0.0), f)))]
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "method string, feature string, rank int")


def consensus(methods: DataFrame, top: int, votes: int = 3) -> DataFrame:
    """Features among the ``top`` of at least ``votes`` methods."""
    return methods.where(F.col("rank") <= top).groupBy("feature").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)


def interaction_search(first: DataFrame, second: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Gain in R2 of every pairwise product over the linear base, on one half and again on the other."""
    from gridloom.operators.moments import horse_race

    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    specs = {"base": list(features)} | {f"{a} x {b}": [*features, f"{a}__{b}"] for a, b in pairs}

    def run(d, out):
        d = d.select(*features, label, *[(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
        h = horse_race(d, label, specs)
        h = with_scalars(h, h.where("spec = 'base'").select("r2_within"), "b")
        return h.where("spec <> 'base'").select("spec", (F.col("r2_within") - F.col("b.r2_within")).alias(out))

    return run(first, "gain").join(run(second, "gain_again"), "spec")


def partial_dependence(model, df: DataFrame, features: Sequence[str], feature: str, grid: DataFrame) -> DataFrame:
    """Mean prediction with one feature set to each value of a short grid table (``value``)."""
    arr = grid.agg(F.sort_array(F.collect_set("value")).alias("vs"))
    d = with_scalars(df.dropna(subset=list(features)), arr, "_g").withColumn("grid", F.explode("_g.vs")).drop("_g")
    d = d.withColumn(feature, F.col("grid"))
    p = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(d))
    return p.groupBy("grid").agg(F.avg("prediction").alias("mean_prediction"), F.count("*").alias("n"))


def counterfactual_flips(model, rows: DataFrame, features: Sequence[str], feature: str, grid: DataFrame, entity: str = "entity") -> DataFrame:
    """Nearest grid value of a feature that flips the sign of the prediction, per row."""
    arr = grid.agg(F.sort_array(F.collect_set("value")).alias("vs"))
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    base = model.transform(asm.transform(rows)).withColumn("p0", F.col("prediction")).drop("features", "prediction").withColumn("x0", F.col(feature))
    d = with_scalars(base, arr, "_g").withColumn(feature, F.explode("_g.vs")).drop("_g")
    p = model.transform(asm.transform(d)).where(F.signum("prediction") != F.signum("p0"))
    flip = p.groupBy(entity).agg(F.min_by(feature, F.struct(F.abs(F.col(feature) - F.col("x0")), F.col(feature))).alias("flip_value"))
    return base.select(entity, "p0", "x0").join(flip, entity, "left")


def tune(df: DataFrame, features: Sequence[str], label: str, date: str, regs: Sequence[float], mixes: Sequence[float]) -> DataFrame:
    """Penalty grid scored on a later slice of the training dates only."""
    d = with_scalars(assembled(df, features, label), split_date(df, 0.5, date), "_s").persist()
    tr, va = d.where(F.col(date) <= F.date_sub("_s.split", 1)), d.where(F.col(date) > F.col("_s.split"))
    out = None
    for r in regs:
        for a in mixes:
            m = LinearRegression(labelCol=label, featuresCol="features", regParam=r, elasticNetParam=a).fit(tr)
            e = (F.col(label) - F.col("prediction")) ** 2
            row = m.transform(va).agg(F.sqrt(F.avg(e)).alias("rmse")).select(F.lit(r).alias("reg"), F.lit(a).alias("mix"), "rmse")
            out = row if out is None else out.unionByName(row)
    return out


def mix_axes(mix: DataFrame, by: Sequence[str], categories: Sequence[str], k: int = 3) -> DataFrame:
    """Leading components of standardised category shares."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    w = mix.groupBy(*by).pivot("category", list(categories)).agg(F.first("share")).fillna(0.0)
    d = VectorAssembler(inputCols=list(categories), outputCol="raw").transform(w)
    d = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(d).transform(d)
    p = PCA(k=k, inputCol="z", outputCol="pc").fit(d).transform(d)
    return p.select(*by, *[vector_to_array("pc")[i].alias(f"axis{i + 1}") for i in range(k)])


def activity_index(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First principal component of standardised columns; the k x k correlation matrix is solved on the driver."""
    import numpy as np

    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev(c).alias(f"s_{c}") for c in cols],
                *[safe_corr(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    k = len(cols)
    c = np.array([[(st[f"c_{i}_{j}"] or 0.0) if i != j else 1.0 for j in range(k)] for i in range(k)], float)
    v = np.linalg.eigh(c)[1][:, -1]
    v = v * (1.0 if v.sum() >= 0 else -1.0)
    e = F.lit(0.0)
    for w, x in zip(v, cols):
        if st[f"s_{x}"]:  # a constant column says nothing
            e = e + float(w) * (F.col(x) - float(st[f"m_{x}"])) / float(st[f"s_{x}"])
    return df.select(*keep, e.alias("idx_activity"))
