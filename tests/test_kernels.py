"""Moment, rank and resampling kernels against NumPy; properties; plan checks."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import econometrics as E, evaluation as V, joins as J, learning as L, moments as M, pairs as P, quantiles as Q, scenarios as N, windows as W
from gridloom.tables import Tables

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for e in range(7):
        for d in range(40):
            if RNG.random() < 0.7:
                x, z = RNG.normal(), RNG.normal()
                rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=d), 0.5 * x - 0.2 * z + 0.3 * e + 0.05 * d + RNG.normal(), x, z))
    return spark.createDataFrame(rows, "entity int, date date, y double, x double, z double").cache()


def design(panel, effects):
    pdf = panel.toPandas()
    cols = [np.column_stack([pdf["x"], pdf["z"]])]
    for i, f in enumerate(effects):
        d = np.array([[v == u for u in sorted(pdf[f].unique())[(1 if i else 0):]] for v in pdf[f]], float)
        cols.append(d)
    return pdf, np.column_stack(cols)


@pytest.mark.parametrize("fe", [["entity"], ["entity", "date"]])
def test_fixed_effects_match_dummies(spark, panel, fe):
    pdf, x = design(panel, fe)
    beta = np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0][:2]
    got = {r["term"]: r["coef"] for r in M.panel_ols(panel, "y", ["x", "z"], fe=fe).collect()}
    assert np.allclose([got["x"], got["z"]], beta, atol=1e-8)


def test_absorb_leaves_no_means(spark, panel):
    a = M.absorb(M.complete(panel, ["y"], ["entity", "date"]), ["y"], ["entity", "date"])
    worst = max(abs(r[1]) for k in ("entity", "date") for r in a.groupBy(k).agg(F.avg("y")).collect())
    assert worst < 1e-9


def test_two_way_clusters(spark, panel):
    pdf = panel.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["x"]])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ pdf["y"].to_numpy()
    s = x * (pdf["y"].to_numpy() - x @ b)[:, None]
    n, k = x.shape

    def meat(keys):
        g = np.array([s[keys == u].sum(0) for u in np.unique(keys)])
        m = len(g)
        return m / (m - 1) * (n - 1) / (n - k) * inv @ g.T @ g @ inv

    e, d = pdf["entity"].astype(str).to_numpy(), pdf["date"].astype(str).to_numpy()
    v = meat(e) + meat(d) - meat(np.char.add(e.astype("U20"), d.astype("U20")))
    w, q = np.linalg.eigh((v + v.T) / 2)
    se = np.sqrt(np.diag(q @ np.diag(np.clip(w, 0, None)) @ q.T))
    got = {r["term"]: r["se"] for r in M.panel_ols(panel, "y", ["x"], cluster=["entity", "date"]).collect()}
    assert np.allclose([got["const"], got["x"]], se, atol=1e-9)


def test_classical_errors(spark, panel):
    pdf = panel.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["z"]])
    inv = np.linalg.inv(x.T @ x)
    u = pdf["y"].to_numpy() - x @ (inv @ x.T @ pdf["y"].to_numpy())
    se = np.sqrt(np.diag(inv) * (u @ u) / (len(pdf) - 3))
    got = M.panel_ols(panel, "y", ["x", "z"]).collect()
    assert np.allclose([r["se"] for r in got], se)


@pytest.mark.parametrize("skewed", [False, True])
def test_exact_quantiles(spark, skewed):
    v = RNG.normal(size=3000).round(2)
    if skewed:
        v[:1200] = 0.5  # one value holds a large share of the rows
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, x double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in Q.exact_quantiles(df, "x", probs, ["g"]).collect()}
    for g in (0, 1):
        for p in probs:
            assert abs(got[g, p] - np.quantile(v[g::2], p)) < 1e-9


def test_pair_tiles_match_brute_force(spark, panel):
    P_BLOCK = P.BLOCK
    P.BLOCK = 3  # several tiles
    try:
        got = {(r["a"], r["b"]): r["corr"] for r in P.pair_correlations(panel, "entity", "date", "y").collect()}
    finally:
        P.BLOCK = P_BLOCK
    c = panel.toPandas().pivot(index="date", columns="entity", values="y").corr()
    assert len(got) == 21
    for (a, b), v in got.items():
        assert abs(v - c.loc[a, b]) < 1e-9


def test_conformal_coverage_is_nominal(spark):
    x = RNG.normal(size=4000)
    df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)], "i int, y double, yhat double")
    w = V.conformal_halfwidths(df.where("i < 2000"), "y", "yhat", [0.8])
    assert abs(V.interval_coverage(df.where("i >= 2000"), w, "y", "yhat").first()["coverage"] - 0.8) < 0.04


def test_simulation_is_repeatable(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(RNG.normal())) for i in range(100)], "entity int, date date, r double")
    b = N.residual_blocks(df, ["entity"], "r", "date", 90, 0.01)
    one = N.simulate(b, ["entity"], [5, 25], 300).groupBy("h").agg(F.sum("total").alias("s"), F.count("*").alias("n")).orderBy("h").collect()
    two = N.simulate(b.repartition(3), ["entity"], [5, 25], 300).groupBy("h").agg(F.sum("total").alias("s"), F.count("*").alias("n")).orderBy("h").collect()
    assert [r["n"] for r in one] == [300, 300]
    assert np.allclose([r["s"] for r in one], [r["s"] for r in two])


def test_quantile_regression_recovers_median(spark):
    x = RNG.normal(size=2000)
    y = 1.0 + 2.0 * x + RNG.laplace(size=2000)
    df = spark.createDataFrame(list(zip(map(float, y), map(float, x))), "y double, x double")
    r = E.quantile_regression(df, "y", "x", [0.5]).first()
    assert abs(r["slope"] - 2.0) < 0.1 and abs(r["intercept"] - 1.0) < 0.1


def test_regressor_without_variation_has_no_coefficient(spark):
    rows = [(d, float(d * 3 + e), float(e) if d else 0.0, 0.0 * e) for d in range(3) for e in range(4)]
    df = spark.createDataFrame(rows, "date int, y double, x double, none double")
    one = M.panel_ols(df, "y", ["none"], fe=["date"], cluster=["date"]).first()
    assert math.isnan(one.coef) and math.isnan(one.se) and one.t is None and one.n == 12
    got = {r.term: r for r in M.panel_ols(df, "y", ["x", "none"], fe=["date"]).collect()}
    assert got["x"].coef == pytest.approx(1.0) and got["x"].r2_within == pytest.approx(10 / 15) and math.isnan(got["none"].coef)


def test_intercept_keeps_the_digits_of_the_fit(spark):
    """Values far from zero with little spread: slope, errors and R2 as after centring by hand."""
    rng = np.random.default_rng(11)
    u, v = rng.normal(size=(2, 60))
    x, y = 30_000 + 1e-3 * u, 9_000 + 1e-3 * (0.1 * u + v)
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "g int, y double, x double")
    for by, rows in (([], [np.ones(60, bool)]), (["g"], [np.arange(60) % 2 == k for k in (0, 1)])):
        got = sorted(M.panel_ols(df, "y", ["x"], by=by).where("term = 'x'").collect(), key=lambda r: r.g if by else 0)
        for r, at in zip(got, rows, strict=True):
            a, b = x[at] - x[at].mean(), y[at] - y[at].mean()
            slope = a @ b / (a @ a)
            rss = ((b - slope * a) ** 2).sum()
            assert r.coef == pytest.approx(slope, rel=1e-6) and r.r2_within == pytest.approx(1 - rss / (b @ b), rel=1e-6)
            assert r.se == pytest.approx(math.sqrt(rss / (at.sum() - 2) / (a @ a)), rel=1e-6)
    const = M.panel_ols(df, "y", ["x"]).where("term = 'const'").first()
    assert const.coef + M.panel_ols(df, "y", ["x"]).where("term = 'x'").first().coef * x.mean() == pytest.approx(y.mean(), rel=1e-12)


def test_shuffle_keeps_values(spark, panel):
    s = L.shuffled(panel.select("entity", "date", "x"), "x", ["entity", "date"])
    a, b = sorted(r["x"] for r in s.collect()), sorted(r["x"] for r in panel.collect())
    assert a == b


def test_salted_join_equals_plain(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    limit = J.BROADCAST_BYTES
    J.BROADCAST_BYTES = -1
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            a = J.enrich(big, dim, ["k"], how, spread="row")
            assert sorted(map(str, a.collect())) == sorted(map(str, big.join(dim, "k", how).select(a.columns).collect()))
    finally:
        J.BROADCAST_BYTES = limit


def test_many_short_rows_are_not_broadcast(spark, tmp_path):
    """A file of a few MB may hold more rows than the driver should build a table of."""
    spark.range(600_000).select(F.col("id").alias("k"), F.lit("HOUSEHOLD").alias("name")).write.parquet(str(tmp_path / "dim"))
    dim, big = spark.read.parquet(str(tmp_path / "dim")), spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("row"))
    assert J.plan_bytes(dim) <= J.BROADCAST_BYTES
    for spread in ("row", None):
        j = J.enrich(big, dim, ["k"], "inner", spread=spread)
        assert "BroadcastExchange" not in plan(j) and j.count() == 1000
    assert "BroadcastExchange" in plan(J.enrich(big, dim.where("k < 100"), ["k"], "inner", spread="row"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_paths_stay_in_the_jvm(spark):
    t = Tables(spark, SF)
    for df in (t.panel, t.dev, t.book, t.counts, W.mad_scrub(t.panel, "price"), W.chain_index(t.pr, "logp"), E.closures(t.dev)):
        assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", plan(df))


def test_scan_reads_only_needed_columns(spark):
    p = plan(Tables(spark, SF).panel)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", p)
    lineitem = next(s for s in schemas if "l_extendedprice" in s)
    assert "l_discount" not in lineitem and "l_tax" not in lineitem


def test_panel_windows_are_partitioned(spark):
    for line in plan(Tables(spark, SF).dev).splitlines():
        if "Exchange" in line:
            assert "SinglePartition" not in line
