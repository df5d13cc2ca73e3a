"""Small hand-made inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions.num import finite, mean_skipnull
from gridloom.operators import aggs as A, inference as I, joins as J, production as R, quality as D, quantiles as Q, tables as K, windows as W
from gridloom.sources import text as T

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n - 1)


def series(spark, pairs, entity=1):
    return spark.createDataFrame([(entity, day(d), float(v)) for d, v in pairs], "entity int, date date, x double")


def col(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_gap_series(spark):
    df = series(spark, [(1, 1), (2, 2), (4, 4), (5, 5), (6, 6), (10, 10)])
    assert col(W.row_lag(df, "x", "l"), "l") == [None, 1, 2, 4, 5, 6]
    r = col(W.gap_checked_return(df, "x"), "ret")
    assert [v is not None for v in r] == [False, True, False, True, True, False]
    grid = J.date_spine(df, "entity", "date").join(df, ["entity", "date"], "left")
    f = col(W.bounded_fill(grid, "x", "f", 2), "f")
    assert f == [1, 2, 2, 4, 5, 6, 6, 6, None, 10]
    lin = col(W.bounded_fill(grid, "x", "f", 2, "linear"), "f")
    assert lin == [1, 2, 3, 4, 5, 6, 7, 8, None, 10]


def test_mad_spike(spark):
    vals = [(d, 100) for d in range(1, 21)]
    vals[9] = (10, 200)
    vals[4] = (5, 112.1)
    vals[14] = (15, 111.9)
    out = {r["date"]: r["is_outlier"] for r in W.mad_scrub(series(spark, vals), "x").collect()}
    assert out[day(10)] and out[day(5)] and not out[day(15)] and sum(out.values()) == 2


def test_chain_entry(spark):
    rows = [(e, day(d), 1.0 + 0.01 * d) for e in (1, 2) for d in range(1, 6)]
    rows += [(3, day(d), 1.7 + 0.01 * d) for d in range(3, 6)]
    df = spark.createDataFrame(rows, "entity int, date date, logp double")
    idx = W.chain_index(df, "logp", 2).orderBy("date").collect()
    steps = [b["chain_log"] - a["chain_log"] for a, b in zip(idx, idx[1:])]
    assert all(abs(s - 0.01) < 1e-12 for s in steps)
    assert idx[2]["basket_log"] - idx[1]["basket_log"] > 0.2


def test_thin_date(spark):
    rows = [(e, day(1), float(e)) for e in range(9)] + [(e, day(2), float(e)) for e in range(10)]
    df = spark.createDataFrame(rows, "entity int, date date, x double")
    d = W.cross_deviation(df, "x").groupBy("date").agg(F.count("dev").alias("n")).orderBy("date").collect()
    assert [r["n"] for r in d] == [0, 10]


def test_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 2, 2, 3)], "x double")
    ranks = {r["v"]: r["avg_rank"] for r in Q.average_rank(df, "x").collect()}
    assert ranks == {1.0: 1.5, 2.0: 4.0, 3.0: 6.0}
    b = {r["x"]: r["b"] for r in Q.quantile_bins(df, "x", 4, "b").collect()}
    assert b == {1.0: 1, 2.0: 2, 3.0: 3}  # edges 1, 1.25, 2, 2, 3 with the repeat dropped
    w = W.cross_rank_pct(df.withColumn("g", F.lit(1)), "x", ["g"], "p").where("x = 2").first()["p"]
    assert abs(w - 4 / 6) < 1e-12


def test_nulls(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, 2.0)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(S.sentinel_to_null("x")).collect()][:2] == [None, None]
    assert [r[0] for r in df.orderBy("i").select(finite("x")).collect()] == [-1.0, None, None, None, 2.0]
    assert df.select(mean_skipnull(F.lit(2.0), F.lit(None).cast("double"), F.lit(4.0)).alias("m")).first()["m"] == 3.0
    h = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, None, "b")], "k int, o int, v double, s string")
    assert A.last_non_null(h, ["k"], ["o"], ["v", "s"]).first()[1:] == (5.0, "b")
    assert A.last_row(h, ["k"], ["o"]).first()["v"] is None


def test_nw_small(spark):
    import numpy as np

    x = [1.0, -0.5, 0.3, 2.0, 1.5, -1.0, 0.2, 0.7, -0.4, 1.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    for lag in (0, 1, 3, 9, 15):
        e = np.array(x) - np.mean(x)
        s = e @ e / 10 + sum(2 * (1 - j / (lag + 1)) * (e[j:] @ e[:-j]) / 10 for j in range(1, min(lag, 9) + 1))
        got = I.nw_mean(df, "v", "i", (), lag).first()
        assert abs(got["se"] - np.sqrt(max(s, 0) / 10)) < 1e-9


def test_bh_small(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.011, 0.02, 0.045, 0.2])], "i int, p double")
    r = I.bh(df, "p", ["i"]).orderBy("i").collect()
    assert [x["bh_row"] for x in r] == [True, True, True, False, False]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.03, 0.031, 0.032, 0.04, 0.041])], "i int, p double")
    r = I.bh(df, "p", ["i"]).orderBy("i").collect()
    assert [x["bh_row"] for x in r] == [False, False, False, True, True] and all(x["bh_step_up"] for x in r)


def test_episode_boundary(spark):
    df = series(spark, [(1, 1), (8, 1), (16, 1)])
    assert col(W.sessions(df, 7), "episode") == [1, 1, 2]


def test_overlap_alive(spark):
    s = spark.createDataFrame([(day(1), day(3)), (day(2), day(2)), (day(3), day(5))], "lo date, hi date")
    d = spark.createDataFrame([(day(i),) for i in range(1, 7)], "date date")
    assert col(J.alive_on_date(s, "lo", "hi", d, "date"), "expected") == [1, 2, 2, 1, 1, 0]


def test_asof_marks(spark):
    d = spark.createDataFrame([(day(i),) for i in (1, 5, 9)], "date date")
    m = spark.createDataFrame([(day(3),), (day(7),)], "date date")
    assert col(J.signed_distance(d, m, "date", "z"), "z") == [-2, 2, 2]


def test_upsert_twice(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(3, "x"), (4, "y")], "k int, v string")
    once = K.upsert(old, new, ["k"])
    twice = K.upsert(once, new, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 4


def test_kv_text(spark):
    lines = ["Alpha Part, times:40, amount:1-99, total:900", "Sword, amount:2-4, times:3", "Ring, times:5", "Cape, times:9, total:4"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    rows = d.select("i", *T.kv_row(F.col("line")), F.col("line").contains("amount").alias("has_amount"), F.lit(100).alias("samples"))
    r = {x["name"]: x for x in R.expected_quantity(rows).collect()}
    assert r["Alpha Part"]["expected_qty"] == 9.0 and r["Alpha Part"]["method"] == "total over samples"
    assert abs(r["Sword"]["expected_qty"] - 0.09) < 1e-12 and r["Ring"]["method"] == "unit assumed"
    assert r["Cape"]["inconsistent"] and abs(r["Cape"]["expected_qty"] - 0.09) < 1e-12


def test_embedded_series(spark):
    html = '<script>const dataAll = {labels:["2024-01-01","bad","2024-01-03","2024-01-04"], values:[1,2,3]};</script>'
    out = T.embedded_series(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html", "dataAll")
    assert [(r["date"], r["value"]) for r in out.orderBy("date").collect()] == [(day(1), 1.0), (day(3), 3.0)]


def test_policy_cases(spark):
    cases = [("stale", -20, 12.0, -1.0), ("thin", 0, 12.0, -1.0), ("inside", 0, 2.0, -1.0), ("below", 0, 8.0, -1.0), ("conflict", 0, 12.0, 1.0),
             ("sell", 0, 12.0, -1.0), ("buy", 0, -12.0, 1.0)]
    p = spark.createDataFrame([(e, day(40 + a), d, f, -3.0, -1.0) for e, a, d, f in cases], "entity string, as_of date, deviation double, predicted double, lo80 double, hi80 double")
    b = spark.createDataFrame([(e, 10.0 if e == "thin" else 900.0) for e, *_ in cases], "entity string, depth double")
    h = spark.createDataFrame([(7, 1.7, 3.0, 20, 0.8, 10.0)], "horizon int, net double, t double, windows long, share_profitable double, cutoff double")
    got = {r["entity"]: r["action"] for r in D.decide(p, b, D.eligible_horizon(h), 5.0, 4.0).collect()}
    assert got == {"stale": "Abstain", "thin": "Avoid", "inside": "Hold", "below": "Hold", "conflict": "Investigate", "sell": "Sell", "buy": "Buy"}
    none = D.eligible_horizon(h.withColumn("t", F.lit(1.0)))
    assert {r["action"] for r in D.decide(p, b, none, 5.0, 4.0).collect()} == {"Abstain"}


def test_many_to_one_guard(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="repeats a key"):
        J.join_many_to_one(a, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"]).collect()


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        D.require_columns(df, {"k": "bigint"})
