"""Feature block and ranks: pandas as the other side, plans, hot groups."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions.num import safe_corr
from gridloom.operators import features as X, quantiles as Q, windows as W
from gridloom.operators.series_plan import SeriesPlan


def series(spark, n=140):
    rng = np.random.default_rng(3)
    rows = [(e, pd.Timestamp("2001-01-01") + pd.Timedelta(days=int(d)), None if rng.random() < 0.15 else float(rng.normal())) for e in (1, 2) for d in np.sort(rng.choice(300, n, replace=False))]
    pdf = pd.DataFrame(rows, columns=["entity", "date", "x"]).sort_values(["entity", "date"])
    df = spark.createDataFrame([(e, d.date(), None if pd.isna(x) else float(x)) for e, d, x in pdf.itertuples(index=False)], "entity int, date date, x double")
    return pdf, df


def test_series_plan_against_pandas(spark):
    pdf, df = series(spark)
    p = SeriesPlan()
    for n in (7, 30):
        for how in ("mean", "sd", "sum", "skew"):
            p.add(f"{how}{n}", p.rolling("x", n, how))
    p.add("lag3", p.past("x", 3))
    p.add("since", p.since(F.col("x") > 1, "big").cast("double"))
    for h in (2, 9):
        p.faded("x", h, f"ew{h}")
    got = p.exponentials(p.select(df, ["entity", "date"])).orderBy("entity", "date").toPandas()
    g = pdf.groupby("entity").x
    want = {f"{how}{n}": g.transform(lambda s, n=n, f=f: getattr(s.rolling(n, min_periods=max(2, n // 2)), f)().shift(1)) for n in (7, 30) for how, f in (("mean", "mean"), ("sd", "std"), ("sum", "sum"), ("skew", "skew"))}
    want["lag3"] = g.shift(4)
    for h in (2, 9):
        want[f"ew{h}"] = g.transform(lambda s, h=h: s.ewm(halflife=h, min_periods=3).mean().shift(1))
        want[f"ew{h}_sd"] = g.transform(lambda s, h=h: s.ewm(halflife=h, min_periods=3).std().shift(1))
    mark = pdf.date.where(pdf.x > 1).groupby(pdf.entity).ffill()
    want["since"] = (pdf.date - mark).dt.days.groupby(pdf.entity).shift(1)
    for name, w in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), w.to_numpy(float), rtol=1e-8, atol=1e-9, err_msg=name)


def test_series_plan_has_one_sort(spark):
    _, df = series(spark, 40)
    p = SeriesPlan()
    for n in (7, 14, 30, 90):
        p.add(f"m{n}", p.rolling("x", n, "mean"))
        p.add(f"k{n}", p.rolling("x", n, "skew"))
        p.add(f"l{n}", p.past("x", n))
    plan = p.select(df, ["entity", "date"])._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Sort [") == 1 and final.count("Window [") == 2 and final.count("Exchange hashpartitioning") == 1


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float(i), None if i else 2.0) for i in range(5)], "a double, b double, c double")
    r = df.agg(safe_corr("a", "b").alias("ab"), safe_corr("b", "b").alias("bb"), safe_corr("b", "c").alias("bc")).first()
    assert r.ab is None and r.bc is None and math.isclose(r.bb, 1.0)
    assert X.leakage(df, ["a", "c"], "b").where("corr is not null").count() == 0
    assert Q.spearman(df, "a", "b").first().rho is None


def test_ranks_of_one_crowded_date(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("d").alias("date"), (F.col("id") * 7919 % n).cast("double").alias("v")).unionByName(spark.createDataFrame([("other", 1.0), ("other", 3.0), (None, 5.0)], "date string, v double"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges this small would be put together
    ranged = Q._ranged(df, "v", ["date"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per = [r["count"] for r in ranged.groupBy("b").count().collect()]
    assert len(per) > 1 and max(per) < 0.6 * n  # the date is cut into ranges
    text = Q.exact_quantiles(df, "v", [0.5], ["date"])._jdf.queryExecution().toString()
    assert "percentile" not in text and "cuts" not in text
    got = {r.date: r.q for r in Q.exact_quantiles(df, "v", [0.25], ["date"]).collect()}
    assert got == {"d": (n - 1) / 4, "other": 1.5, None: 5.0}
    x = W.cross_section(df, "v", ["date"])
    mid = {(r.date, r.v): (r.from_median, r.rank_pct) for r in x.where("v in (1.0, 3.0) or date is null").collect()}
    assert mid["other", 1.0] == (-1.0, 0.5) and mid["other", 3.0] == (1.0, 1.0) and mid[None, 5.0] == (0.0, 1.0)
    assert mid["d", 1.0] == (1.0 - (n - 1) / 2, 2 / n)
