"""Draws from one scan equal draws made one by one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import econometrics as E, resampling as R

GRID = {"lo": 0.1, "hi": 0.9, "points": 9}


def panel(spark, seed=3, kink=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(7):
        for t in range(30 + 5 * e):
            x = float(rng.normal())
            rows.append((f"e{e}", t, x, float(e + 0.5 * x + kink * x * (abs(x) > 1) + rng.normal())))
    rows += [("e0", 99, None, 1.0), ("e1", 99, 1.0, None), (None, 3, 1.0, 1.0), ("e2", 98, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "entity string, date int, x double, y double")


def within(v, groups):
    out = v.astype(float).copy()
    for g in set(groups):
        out[groups == g] -= out[groups == g].mean()
    return out


def test_threshold_bootstrap(spark):
    draws, df = 70, panel(spark, kink=0.3)
    got = E.threshold_bootstrap(df, "y", "x", draws=draws, **GRID).first()
    ok = df.where("entity is not null and x is not null and not isnan(x) and y is not null")
    pdf = ok.withColumn("w", R.sign_words(draws, 7, "entity", "date")).toPandas()
    who, x, y = pdf.entity.to_numpy(), pdf.x.to_numpy(), within(pdf.y.to_numpy(), pdf.entity.to_numpy())
    xd = within(x, who)
    fit = xd * (xd @ y) / (xd @ xd)
    flips = R.signs(np.array(pdf.w.tolist()), draws)
    assert set(np.unique(flips)) == {-1.0, 1.0} and abs(flips.mean()) < 0.05
    gammas = [r.gamma for r in E.threshold_ar(ok, "y", "x", **GRID).select("gamma").collect()]

    def f(v):
        v = within(v, who)
        ssr = min(np.linalg.lstsq(a := np.column_stack([within(x * (np.abs(x) <= g), who), within(x * (np.abs(x) > g), who)]), v, rcond=None)[1][0] for g in gammas)
        return (v @ v - (xd @ v) ** 2 / (xd @ xd) - ssr) / (ssr / (len(v) - 2))

    drawn = [f(fit + (y - fit) * flips[:, k]) for k in range(draws)]
    assert got.draws == draws and got.f_obs == pytest.approx(f(y), rel=1e-8)
    assert got.p_boot == pytest.approx(np.mean(np.array(drawn) >= f(y)))


def test_threshold_bootstrap_edges(spark):
    empty = E.threshold_bootstrap(panel(spark).limit(0), "y", "x", draws=5, **GRID).first()
    assert empty.f_obs is None and empty.p_boot is None
    strong = E.threshold_bootstrap(panel(spark, kink=2.0), "y", "x", draws=200, **GRID).first()
    assert strong.p_boot == 0 and strong.draws == 200


def test_tasks_do_not_matter(spark):
    """Sums over one task or nine give the same test."""
    df = panel(spark).where("entity is not null and x is not null and not isnan(x)")
    one = E.threshold_bootstrap(df.coalesce(1), "y", "x", draws=20, **GRID).first()
    many = E.threshold_bootstrap(df.repartition(9), "y", "x", draws=20, **GRID).first()
    assert one.f_obs == pytest.approx(many.f_obs) and one.p_boot == many.p_boot


def grouped(spark, n=90, dates=3, seed=8, effect=0.0):
    rng = np.random.default_rng(seed)
    rows = [(e, d, None if e % 10 == 9 else f"r{e % 4}", float(rng.normal() + effect * (e % 4))) for d in range(dates) for e in range(n)]
    rows += [(900, 0, "alone", 5.0), (901, 1, "r1", None), (902, 7, "r1", 1.0), (903, 7, "r1", 1.0)]
    return spark.createDataFrame(rows, "entity int, date int, region string, v double")


def test_moran_observed_is_the_plain_statistic(spark):
    df = grouped(spark, effect=0.4)
    plain = {r.date: r.moran for r in E.morans_i(df, "v", "region").collect()}
    for part in (4096, 25):
        by = {r.date: r.moran for r in R.morans_by_draw(df, "v", "region", "entity", "date", 3, 1, part).where("draw = 0").collect()}
        assert by == {d: pytest.approx(m) if m is not None else None for d, m in plain.items()}
    assert plain[7] is None


def test_permutations_keep_values(spark):
    """Every draw hands out the same values, whole parts or cut ones; labels keep their counts."""
    df = grouped(spark)
    want = {r.date: (r.s, r.q) for r in df.where("v is not null").groupBy("date").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect()}
    counts = {(r.date, r.region): r.n for r in df.where("v is not null").groupBy("date", "region").agg(F.count("*").alias("n")).collect()}
    for part in (4096, 25):
        sums = R.permuted_sums(df.where("v is not null"), "v", "region", "date", 12, 5, ["entity", "date"], part).toPandas()
        for (d, k), s in sums.groupby(["date", "draw"]):
            assert (s.s.sum(), s.q.sum()) == (pytest.approx(want[d][0]), pytest.approx(want[d][1]))
            assert {(d, None if r.region is None else r.region): r.n for r in s.itertuples()} == {key: n for key, n in counts.items() if key[0] == d}
        assert sums[(sums.date == 0) & (sums.region == "r1")].s.nunique() > 10


def test_permutations_are_uniform(spark):
    """Four values on two labels: each of the six splits about as often."""
    df = spark.createDataFrame([(i, 0, "ab"[i // 2], float(2**i)) for i in range(4)], "entity int, date int, region string, v double")
    sums = R.permuted_sums(df, "v", "region", "date", 3000, 5, ["entity", "date"]).where("region = 'a' and draw > 0")
    got = {r.s: r.n for r in sums.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {a + b for a, b in itertools.combinations([1.0, 2.0, 4.0, 8.0], 2)}
    assert all(abs(n - 500) < 110 for n in got.values())


def test_moran_permutation(spark):
    null = E.morans_permutation(grouped(spark, 60, 4).where("date < 4 and region is not null and entity < 900"), "v", "region", draws=400).first()
    assert null.draws == 400 and null.null_mean == pytest.approx(-1 / 53, abs=0.01) and null.p > 0.02
    assert E.morans_permutation(grouped(spark, 60, 4, effect=1.0), "v", "region", draws=200).first().p == 0
    assert E.morans_permutation(grouped(spark).limit(0), "v", "region", draws=5).first().p is None
