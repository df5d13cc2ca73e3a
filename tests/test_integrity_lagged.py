"""Integrity checks find planted faults; lag responses and unit roots against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import integrity as G, lagged as LG


def days(spark, series):
    rows = [(e, dt.date(2001, 1, 1) + dt.timedelta(days=i), *(None if v is None else float(v) for v in vs)) for e, xs in series.items() for i, vs in enumerate(zip(*xs))]
    return spark.createDataFrame(rows, "entity int, date date, " + ", ".join(f"{c} double" for c in "xy"[: len(next(iter(series.values())))]))


def test_same_rows(spark):
    kind = "g string, a int, b string"
    one = [("p", 1, "x"), ("p", 1, "x"), ("p", None, "y"), (None, 2, "z"), ("q", 3, "3"), ("r", 4, None), ("s", 1, "2")]
    two = [("p", None, "y"), ("p", 1, "x"), (None, 2, "z"), ("p", 1, "x"), ("q", 3, None), ("t", 4, None), ("s", 2, "1")]
    got = {r.g: (r.rows_left, r.rows_right, r.equal) for r in G.same_rows(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), ["a", "b"], ["g"]).collect()}
    assert got == {"p": (3, 3, True), None: (1, 1, True), "q": (1, 1, False), "r": (1, 0, False), "t": (0, 1, False), "s": (1, 1, False)}
    few = G.same_rows(spark.createDataFrame(one, kind), spark.createDataFrame(one[1:], kind), ["g", "a", "b"]).first()
    assert (few.rows_left, few.rows_right, few.equal) == (7, 6, False)
    assert G.same_keys(spark.createDataFrame(one, kind), spark.createDataFrame(one[1:], kind), ["a", "b"]).first().equal
    text = G.same_rows(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), ["a", "b"], ["g"])._jdf.queryExecution().toString()
    assert "Join" not in text


def test_one_row_checks(spark):
    p = spark.createDataFrame([(e, m, 1.0, 2.0 if m == "a" or e == 1 else None) for e in (1, 2) for m in ("a", "b")], "e int, m string, y double, f double")
    assert G.matched_n(p, "m", ["e"], "y", "f").first().violations == 1  # a model without any row
    v = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 3.0), (1.0, None, 3.0), (1.0, 1.0, float("inf"))], "a double, b double, c double")
    assert G.finite_values(v, ["a", "b", "c"]).first().violations == 2
    assert G.ordered_bounds(v, ["a", "b", "c"]).first().violations == 2
    assert G.exact_ratio(v, "c", "a", 3.0).first().violations == 2
    none = v.where("a > 9")
    assert G.finite_values(none, ["a"]).first().passed and G.exact_ratio(none, "a", "b", 2.0).first().violations == 0
    s = spark.createDataFrame([(k, dt.date(2001, 1, d)) for k, d in ((1, 1), (1, 20), (2, 2), (3, 3))], "k int, d date")
    got = G.stale_majority(s, "k", "d", F.lit(dt.date(2001, 1, 21)), 7).first()
    assert (got.sources, got.stale, got.passed) == (3, 2, False)
    t = G.torn_snapshots(s.withColumn("snap", F.lit(1)), "snap", "d", spark.createDataFrame([(1, dt.date(2001, 1, 19))], "snap int, b date"), "b").first()
    assert t.torn and t.last_part == dt.date(2001, 1, 20)
    assert not G.end_against_source(s, "d", s.select(F.date_add("d", 3).alias("d")), "d").first().passed


def test_distributed_lag_against_numpy(spark):
    rng = np.random.default_rng(8)
    lags, leads, degree = 12, 3, 3
    grid = LG.basis(lags, degree)
    true = grid @ np.array([0.5, -0.3, 0.1, 0.05])
    series = {}
    for e in range(8):
        x = rng.normal(size=160)
        y = np.array([sum(true[k] * x[t - k] for k in range(lags + 1)) if t >= lags else 0.0 for t in range(160)]) + e + 0.3 * rng.normal(size=160)
        series[e] = (x, y)
    got = LG.distributed_lag(days(spark, series), "y", "x", lags, degree, leads, horizons=(3, 6, 12)).toPandas().set_index(["kind", "k"])
    rows = []
    for e, (x, y) in series.items():
        for t in range(lags, 160 - leads):
            z = [sum(grid[k, p] * x[t - k] for k in range(lags + 1)) for p in range(degree + 1)]
            f = [x[t + k] for k in range(1, leads + 1)]
            rows.append([e, y[t], *z, np.mean(f), sum((k - (leads + 1) / 2) * f[k - 1] for k in range(1, leads + 1))])
    a = np.array(rows)
    for c in range(1, a.shape[1]):
        for e in range(8):
            a[a[:, 0] == e, c] -= a[a[:, 0] == e, c].mean()
    ent, y, z = a[:, 0], a[:, 1], a[:, 2:]
    inv = np.linalg.inv(z.T @ z)
    theta = inv @ z.T @ y
    s = np.array([z[ent == e].T @ (y - z @ theta)[ent == e] for e in range(8)])
    cov = (inv @ (s.T @ s) @ inv * 8 / 7)[: degree + 1, : degree + 1]
    for h in (3, 6, 12):
        g = grid[: h + 1].sum(axis=0)
        assert got.loc[("cumulative", h), "estimate"] == pytest.approx(g @ theta[: degree + 1])
        assert got.loc[("cumulative", h), "se"] == pytest.approx(np.sqrt(g @ cov @ g))
    for k in range(lags + 1):
        assert got.loc[("beta", k), "low"] <= true[k] <= got.loc[("beta", k), "high"]
    share = np.cumsum(true) / true.sum()
    assert got.loc[("share", 6), "estimate"] == pytest.approx(share[6], abs=0.05) and got.loc[("half", lags), "estimate"] == np.argmax(share >= 0.5)
    assert got.loc[("leads", 2), "estimate"] < 20


def test_no_half_time_without_a_response(spark):
    rng = np.random.default_rng(1)
    got = LG.distributed_lag(days(spark, {e: (rng.normal(size=120), rng.normal(size=120)) for e in range(6)}), "y", "x", 10, 2, 2, horizons=(5, 10)).toPandas().set_index("kind")
    assert np.isnan(got.loc["half", "estimate"])


def test_unit_roots(spark):
    rng = np.random.default_rng(2)
    walk, still, lagged = np.cumsum(rng.normal(size=400)), np.zeros(400), np.zeros(400)
    for t in range(1, 400):
        still[t] = 0.5 * still[t - 1] + rng.normal()
    d = np.zeros(400)
    for t in range(3, 400):  # differences that depend on those two before
        d[t] = 0.6 * d[t - 2] + rng.normal()
    lagged = np.cumsum(d)
    series = {1: (walk,), 2: (still,), 3: (lagged,), 4: (np.ones(400),), 5: (rng.normal(size=12),)}
    got = {r.entity: r for r in LG.unit_roots(days(spark, series), "x").collect()}
    assert set(got) == {1, 2, 3} and got[2].adf_t < -5 and got[1].adf_t > -3 and got[3].lag >= 2

    def direct(v, p, most=5):
        y = np.diff(v)
        rows = range(most, len(y))
        x = np.array([[1, v[t], *(y[t - k] for k in range(1, p + 1))] for t in rows])
        b = np.array([y[t] for t in rows])
        beta, *_ = np.linalg.lstsq(x, b, rcond=None)
        e = b - x @ beta
        return len(b) * np.log(e @ e / len(b)) + 2 * (p + 2), beta[1] / np.sqrt(e @ e / (len(b) - p - 2) * np.linalg.inv(x.T @ x)[1, 1])

    for k, v in ((1, walk), (2, still), (3, lagged)):
        best = min(range(6), key=lambda p: direct(v, p)[0])
        assert got[k].lag == best and got[k].adf_t == pytest.approx(direct(v, best)[1])
    c = LG.combine_unit_roots(LG.unit_roots(days(spark, series), "x")).first()
    assert c.entities == 3 and c.combined_z == pytest.approx(sum(r.z for r in got.values()) / np.sqrt(3))
