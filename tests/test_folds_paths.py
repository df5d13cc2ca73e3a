"""Out-of-fold codes do not see their own target; histogram quantiles keep their bound; cuts follow the dates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation as V, learning as L, scenarios as N


def test_out_of_fold_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 300)), int(rng.integers(0, 5)), float(rng.normal())) for _ in range(1500)] + [(None, 1, 2.0), (None, 2, 4.0), (999, 3, 7.0)]
    df = spark.createDataFrame(rows, "k int, fold int, y double")
    got = {(r.k, r.fold): r.encoded for r in V.out_of_fold_encoding(df, "k", "fold", "y", 5.0).collect()}
    for k, fold in list(got)[::40] + [(None, 1), (999, 3)]:
        rest = [y for a, f, y in rows if f != fold]
        own = [y for a, f, y in rows if f != fold and a == k]
        assert got[k, fold] == pytest.approx((sum(own) + np.mean(rest) * 5) / (len(own) + 5))
    # the target is noise: full codes correlate with it, out-of-fold codes do not
    codes = {k: (sum(y for a, _, y in rows if a == k) + np.mean([y for *_, y in rows]) * 5) / (sum(a == k for a, *_ in rows) + 5) for k in {a for a, *_ in rows}}
    y = np.array([y for *_, y in rows])
    assert np.corrcoef([codes[a] for a, *_ in rows], y)[0, 1] > 0.3
    assert abs(np.corrcoef([got[a, f] for a, f, _ in rows], y)[0, 1]) < 0.1


def test_encoded_scope_with_unseen_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 5)), float(x := rng.normal()), float(0.5 * x + k + 0.1 * rng.normal())) for k in range(6) for _ in range(60)]
    train = spark.createDataFrame(rows, "k int, fold int, x double, y double")
    test = spark.createDataFrame([(2, 1.0, 2.5), (77, 0.0, 2.5)], "k int, x double, y double")
    got = {r.k: r.yhat for r in L.encoded_predictions(train, test, "y", "x", "k", "fold", 1.0).collect()}
    assert got[2] == pytest.approx(2.5, abs=0.25) and got[77] == pytest.approx(2.5, abs=0.3)


def test_histogram_quantiles(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.2, 4000), np.zeros(500), [-3.0, 3.0]])
    sims = spark.createDataFrame([("a", 1, float(v)) for v in x] + [("b", 1, 0.5)], "g string, h int, total double")
    probs, width = [0.0, 0.05, 0.5, 0.9, 1.0], 1e-3
    got = {(r.g, r.prob): r.q for r in N.histogram_quantiles(N.path_histogram(sims, ["g"], width), ["g"], probs, width).collect()}
    for p in probs:
        assert abs(got["a", p] - np.quantile(x, p, method="lower")) <= width and abs(got["b", p] - 0.5) <= width
    level = {r.level: r.percentile for r in N.level_percentiles(sims.where("g = 'a'"), [], [0.8, 1.0]).collect()}
    assert level[0.8] == pytest.approx((np.exp(x) < 0.8).mean()) and level[1.0] == pytest.approx((np.exp(x) < 1.0).mean())


def test_cut_dates(spark):
    d = spark.createDataFrame([(dt.date(1970, 1, 1) + dt.timedelta(days=7 * k),) for k in range(10)] * 3 + [(None,)], "d date")
    r = V.cut_dates(d, "d", a=0.0, b=0.65).first()
    assert (r.a, r.b) == (dt.date(1970, 1, 1), dt.date(1970, 1, 1) + dt.timedelta(days=42))
    assert V.cut_dates(d.where("d is null"), "d", a=0.5).first().a is None
    assert d.agg(F.count("d")).first()[0] == 30
