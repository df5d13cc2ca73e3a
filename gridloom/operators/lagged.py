"""Distributed lags and unit roots on panels: responses over many lags from one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import windows as W
from gridloom.operators.joins import with_scalars
from gridloom.operators.moments import _lin, attach, centred_gram, prepare, products, solve
from gridloom.session import materialise

#: Roots of the 95 % chi-square quantiles by degrees of freedom, for bands over a whole curve.
BAND = {1: 1.95996, 2: 2.44775, 3: 2.79548, 4: 3.08022, 5: 3.32724, 6: 3.54846}


def basis(lags: int, degree: int) -> np.ndarray:
    """Legendre polynomials over the lags 0..lags, one row per lag."""
    u = 2.0 * np.arange(lags + 1) / lags - 1.0 if lags else np.zeros(1)
    rows = [np.ones_like(u), u]
    for p in range(1, degree):
        rows.append(((2 * p + 1) * u * rows[p] - p * rows[p - 1]) / (p + 1))
    return np.stack(rows[: degree + 1], axis=1)


def lag_terms(df: DataFrame, x: str, lags: int, degree: int, leads: int, entity="entity", date="date", keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """The basis applied to the lags of ``x``, and mean and slope over its leads; rows without the whole reach are dropped.

    All lags are offsets of one ordering of the series; a row costs (degree + 1) x lags multiplications.
    """
    w = W.series(entity, date)
    b = basis(lags, degree)
    names, ahead = [f"lag_p{p}" for p in range(degree + 1)], ["lead_mean", "lead_slope"][: min(leads, 2)]
    every = [F.lag(x, k).over(w).alias(f"_x{k}") for k in range(lags + 1)] + [F.lead(x, k).over(w).alias(f"_f{k}") for k in range(1, leads + 1)]
    d = df.select(*keep, *every).where(F.col(f"_x{lags}").isNotNull() & (F.col(f"_f{leads}").isNotNull() if leads else F.lit(True)))

    def mix(cols, weights):
        out = F.lit(0.0)
        for c, v in zip(cols, weights, strict=True):
            out = out + F.col(c) * float(v)
        return out

    terms = [mix([f"_x{k}" for k in range(lags + 1)], b[:, p]).alias(n) for p, n in enumerate(names)]
    fs = [f"_f{k}" for k in range(1, leads + 1)]
    slopes = [np.full(leads, 1.0 / leads), np.arange(1, leads + 1) - (leads + 1) / 2.0] if leads else []
    terms += [mix(fs, v).alias(n) for n, v in zip(ahead, slopes, strict=False)]
    return d.select(*keep, *terms), names, ahead


def distributed_lag(df: DataFrame, y: str, x: str, lags: int = 90, degree: int = 3, leads: int = 7, horizons: Sequence[int] = (7, 14, 30, 60, 90),
                    fe: Sequence[str] = ("entity",), cluster: str = "entity", entity="entity", date="date") -> DataFrame:
    """Response of ``y`` to ``x`` over the lags 0..lags on a smooth basis, with placebo leads.

    Rows (kind, k, estimate, se, low, high, n): ``beta`` at every lag with a band that holds over the
    whole curve, ``cumulative`` and ``share`` (of the response at the last lag) at the horizons with
    delta-method errors, ``half`` the first lag with half of the response (NULL unless the total is
    positive and its band excludes zero), ``leads`` the Wald statistic of the leads.  Errors are
    clustered.  Lags count rows of the entity; fill the calendar first where days are missing.
    """
    keep = list(dict.fromkeys([entity, *fe, cluster, y]))
    d, names, ahead = lag_terms(df, x, lags, degree, leads, entity, date, keep)
    xs = [*names, *ahead]
    d, xs = prepare(d, y, xs, list(fe), [cluster], [], None)
    d = materialise(d, "lags")  # moments and scores read these rows
    s = solve(products(d, y, xs), len(xs))
    u = attach(d, s, ["beta"], [], True).withColumn("_u", F.col(y) - _lin(xs))
    per = u.groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_u")).alias(f"s{i}") for i, c in enumerate(xs)])
    k = len(xs)
    meat = per.agg(F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).alias("meat"), F.count("*").alias("g"))
    one = with_scalars(s.select("n", "beta", "inv"), meat, "m").select("n", "beta", "inv", "m.meat", "m.g")
    start, q = xs.index(names[0]), len(names)
    grid, horizons = basis(lags, degree), [h for h in horizons if h <= lags]

    def curve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for pdf in parts for r in pdf.itertuples(index=False)):
            a = np.asarray(r.inv).reshape(k, k)
            v = a @ np.asarray(r.meat).reshape(k, k) @ a * (r.g / max(r.g - 1, 1))
            theta, cov = np.asarray(r.beta)[start : start + q], v[start : start + q, start : start + q]
            rows, total = [], grid.sum(axis=0)
            error = lambda g: math.sqrt(max(float(g @ cov @ g), 0.0))
            add = lambda kind, i, e, se, z: rows.append((kind, i, e, se, None if se is None else e - z * se, None if se is None else e + z * se, int(r.n)))
            for i, g in enumerate(grid):
                add("beta", i, float(g @ theta), error(g), BAND[q])
            c = float(total @ theta)
            for h in horizons:
                g = grid[: h + 1].sum(axis=0)
                add("cumulative", h, float(g @ theta), error(g), BAND[1])
                if c:
                    share = float(g @ theta) / c
                    add("share", h, share, error((g - share * total) / c), BAND[1])
            known = c > 0 and c - BAND[q] * error(total) > 0
            path = np.cumsum(grid @ theta)
            add("half", lags, float(np.argmax(path >= c / 2)) if known else None, None, 0)
            if ahead:
                at = [xs.index(n) for n in ahead]
                b = np.asarray(r.beta)[at]
                add("leads", len(ahead), float(b @ np.linalg.pinv(v[np.ix_(at, at)]) @ b), None, 0)
            yield pd.DataFrame(rows, columns=["kind", "k", "estimate", "se", "low", "high", "n"]).astype({"k": "int64", "n": "int64"})

    return one.mapInPandas(curve, "kind string, k long, estimate double, se double, low double, high double, n long")


#: Response surface of the unit-root statistic with a constant; the normal quantile of its
#: p-value is a polynomial in the statistic, one below the bend and one above.
BEND, BELOW, ABOVE = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
CLIP = 7.0344869  # normal quantile of 1 - 1e-12


def unit_roots(df: DataFrame, value: str, max_lag: int = 5, min_n: int = 30, entity="entity", date="date") -> DataFrame:
    """Augmented Dickey-Fuller statistic of each entity with its own number of lagged differences.

    One Gram matrix per entity over the level and ``max_lag`` differences holds all nested
    regressions as sub-matrices; the lag with the smallest Akaike criterion on the common sample
    counts (ties: the smaller).  Columns entity, n, lag, adf_t and ``z``, the normal quantile of the
    p-value.  Entities with fewer than ``min_n`` complete rows or a constant series are left out.
    """
    w = W.series(entity, date)
    d = df.where(F.col(value).isNotNull()).select(entity, date, F.col(value).cast("double").alias("_v"))
    d = d.select(entity, date, (F.col("_v") - F.lag("_v").over(w)).alias("_y"), F.lag("_v").over(w).alias("_level"))
    d = d.select(entity, "_y", "_level", *[F.lag("_y", k).over(w).alias(f"_d{k}") for k in range(1, max_lag + 1)]).dropna()
    xs = ["_level", *[f"_d{k}" for k in range(1, max_lag + 1)]]
    k = len(xs)
    g = centred_gram(d, "_y", xs, [entity]).where(F.col("n") >= max(min_n, k + 3))

    @F.pandas_udf("lag long, adf_t double")
    def choose(n: pd.Series, yy: pd.Series, xy: pd.Series, xx: pd.Series) -> pd.DataFrame:
        out = []
        for m, s, b, a in zip(n, yy, xy, xx):
            a, b = np.asarray(a, float).reshape(k + 1, k + 1), np.asarray(b, float)
            a, b, s = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / m, b[1:] - a[0, 1:] * b[0] / m, s - b[0] * b[0] / m  # the constant taken out
            best = None
            for p in range(max_lag + 1):
                inv = np.linalg.pinv(a[: p + 1, : p + 1])
                beta = inv @ b[: p + 1]
                rss = s - beta @ b[: p + 1]
                if rss <= 1e-12 * max(s, 1e-300) or inv[0, 0] <= 0:
                    continue
                score = m * math.log(rss / m) + 2 * (p + 2)
                if best is None or score < best[0] - 1e-9:
                    best = (score, p, beta[0] / math.sqrt(rss / (m - p - 2) * inv[0, 0]))
            out.append(best[1:] if best else (None, None))
        return pd.DataFrame(out, columns=["lag", "adf_t"])

    d = g.select(entity, "n", choose("n", "yy", "xy", "xx").alias("c")).select(entity, "n", "c.lag", "c.adf_t").where("adf_t is not null")
    poly = lambda c: sum((F.pow("adf_t", F.lit(i)) * v for i, v in enumerate(c) if i), F.lit(c[0]))
    z = F.when(F.col("adf_t") <= BEND, poly(BELOW)).otherwise(poly(ABOVE))
    return d.withColumn("z", F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP)))


def combine_unit_roots(tests: DataFrame, level: float = -1.6448536) -> DataFrame:
    """Inverse-normal combination: number of entities, share below the quantile ``level``, sum of z over the root of their number."""
    return tests.agg(F.count("*").alias("entities"), F.avg((F.col("z") < level).cast("double")).alias("share_reject"), (F.sum("z") / F.sqrt(F.count("*"))).alias("combined_z"),
                     F.avg("lag").alias("mean_lag"))
