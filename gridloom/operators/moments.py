"""Least squares from distributed moments.

A regression is one aggregate of cross products per group, a k x k solve on the aggregated rows,
one projection for the scores and one aggregate per cluster dimension.  Rows never leave the
executors; only groups x k^2 numbers do, and they are solved where they are (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridloom.operators.joins import with_group, with_scalars
from gridloom.session import cut_lineage, materialise


def complete(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows where every column is present and finite."""
    ok = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    for c in keep:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok).select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])


def demean(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    d = with_group(df, keys, **{f"_m_{c}": F.avg(c) for c in cols})
    return d.select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def absorb(df: DataFrame, cols: Sequence[str], fe: Sequence[str], by: Sequence[str] = (), tol: float = 1e-10,
           max_iter: int = 200, every: int = 1) -> DataFrame:
    """Remove fixed effects.  One effect is a window; more alternate until the group means vanish.

    Every sweep is checkpointed: demeaning reads its source twice, so the plan would double, and a
    lost executor costs one sweep.
    """
    by = list(by)
    if not fe:
        return df
    if len(fe) == 1:
        return demean(df, cols, [*by, fe[0]])
    cur = cut_lineage(df)
    for i in range(1, max_iter + 1):
        for f in fe:
            cur = demean(cur, cols, [*by, f])
        if i % every == 0 or i == max_iter:
            cur = cut_lineage(cur)
            g = cur.groupBy(*by, fe[0]).agg(*[F.abs(F.avg(c)).alias(c) for c in cols])
            worst = g.agg(F.max(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]))).first()[0]
            if worst is None or worst < tol:
                return cur
    raise RuntimeError(f"fixed effects not absorbed after {max_iter} sweeps: a group mean of {worst:.3g} is left")


def gram(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, sy, yy, xy[k], xx[k*k]) in one pass with map-side combination."""
    k = len(xs)
    xx = {(i, j): F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(k) for j in range(i, k)}
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("yy"),
        F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs]).alias("xy"),
        F.array(*[xx[min(i, j), max(i, j)] for i in range(k) for j in range(k)]).alias("xx"))


def centred_gram(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``gram`` of a regression with an intercept, about the group means: (by..., n, sy, yy, xy[k+1], xx[(k+1)^2], mid[k+1]).

    The intercept stands first, orthogonal to the rest; ``mid`` holds the means of y and xs.  Raw cross products lose
    the digits that the squared means take up, moments about the means keep them.
    """
    k, n = len(xs), F.count("*").cast("double")
    about = lambda a, b: n * F.covar_pop(a, b)
    xx = {(i, j): about(xs[i], xs[j]) for i in range(k) for j in range(i, k)}
    zero = F.lit(0.0)
    cell = lambda i, j: n if i == j == 0 else zero if 0 in (i, j) else xx[min(i, j) - 1, max(i, j) - 1]
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(zero).alias("sy"), (n * F.var_pop(y)).alias("yy"),
        F.array(F.min(zero), *[about(x, y) for x in xs]).alias("xy"),
        F.array(*[cell(i, j) for i in range(k + 1) for j in range(k + 1)]).alias("xx"),
        F.array(*[F.avg(c) for c in (y, *xs)]).alias("mid"))


def products(d: DataFrame, y: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The Gram matrix of prepared rows: about the means beside an intercept, else as they stand."""
    return centred_gram(d, y, names[1:], by) if names[0] == "const" and len(names) > 1 else gram(d, y, names, by)


@F.pandas_udf(ArrayType(DoubleType()))
def _solve_centred(xx: pd.Series, xy: pd.Series, mid: pd.Series) -> pd.Series:
    """``_solve`` on ``centred_gram``, the intercept moved back from the means to zero."""
    out = []
    for a, b, m in zip(xx, xy, mid):
        if a is None or b is None or m is None or not np.isfinite(np.asarray(a, float)).all():
            out.append(None)
            continue
        k, m = len(b), np.asarray(m, float)
        a, inv, back = np.asarray(a, float).reshape(k, k), np.zeros((k, k)), np.eye(k)
        inv[0, 0], inv[1:, 1:] = 1 / a[0, 0], np.linalg.pinv(a[1:, 1:])
        beta = inv @ np.asarray(b, float)
        beta[0] = m[0] - m[1:] @ beta[1:]
        back[0, 1:] = -m[1:]
        out.append(np.concatenate([beta, (back @ inv @ back.T).ravel()]).tolist())
    return pd.Series(out)


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """beta (k) followed by the flattened inverse (k*k)."""
    out = []
    for a, b in zip(xx, xy):
        if a is None or b is None or not np.isfinite(np.asarray(a, float)).all():
            out.append(None)
            continue
        k = len(b)
        inv = np.linalg.pinv(np.asarray(a, float).reshape(k, k))
        out.append(np.concatenate([inv @ np.asarray(b, float), inv.ravel()]).tolist())
    return pd.Series(out)


@F.pandas_udf(ArrayType(DoubleType()))
def _sandwich(inv: pd.Series, meats: pd.Series) -> pd.Series:
    """Standard errors of inv @ (sum of meats) @ inv after projection on the PSD cone; several meats give the floor."""
    out = []
    for a, ms in zip(inv, meats):
        if a is None or ms is None or any(m is None or not np.isfinite(np.asarray(m, float)).all() for m in ms):
            out.append(None)
            continue
        k = int(round(len(a) ** 0.5))
        a = np.asarray(a, float).reshape(k, k)
        best = None
        for m in ms:
            v = a @ np.asarray(m, float).reshape(k, k) @ a
            w, q = np.linalg.eigh((v + v.T) / 2)
            if (w < 0).any():
                v = q @ np.diag(np.clip(w, 0, None)) @ q.T
            d = np.sqrt(np.clip(np.diag(v), 0, None))
            best = d if best is None else np.maximum(best, d)
        out.append(best.tolist())
    return pd.Series(out)


def solve(g: DataFrame, k: int) -> DataFrame:
    """``beta`` and ``inv`` of each row of ``gram`` or ``centred_gram``."""
    s = g.withColumn("_s", _solve_centred("xx", "xy", "mid") if "mid" in g.columns else _solve("xx", "xy"))
    return s.withColumn("beta", F.slice("_s", 1, k)).withColumn("inv", F.slice("_s", k + 1, k * k)).drop("_s")


def attach(d: DataFrame, small: DataFrame, cols: Sequence[str], by: Sequence[str], bounded: bool) -> DataFrame:
    """Bring per-group results back to the rows; ``bounded`` says the groups are a fixed grid."""
    if not by:
        x = with_scalars(d, small.select(*cols), "_c")
        return x.select(*d.columns, *[F.col(f"_c.{c}").alias(c) for c in cols])
    s = small.select(*by, *cols)
    return d.join(F.broadcast(s) if bounded else s, list(by))


def _lin(xs: Sequence[str], beta: str = "beta"):
    e = F.lit(0.0)
    for i, x in enumerate(xs):
        e = e + F.col(x) * F.col(beta)[i]
    return e


def prepare(df: DataFrame, y: str, xs: Sequence[str], fe, cluster, by, const: bool | None) -> tuple[DataFrame, list[str]]:
    keep = list(dict.fromkeys([*by, *fe, *cluster]))
    d = absorb(complete(df, [y, *xs], keep), [y, *xs], fe, by)
    names = list(xs)
    if const if const is not None else not fe:
        d = d.withColumn("const", F.lit(1.0))
        names = ["const", *names]
    return d, names


def panel_ols(df: DataFrame, y: str, xs: Sequence[str], fe: Sequence[str] = (), cluster: Sequence[str] = (),
              by: Sequence[str] = (), const: bool | None = None, variance_floor: bool = False,
              small_sample: bool = True, bounded: bool = True, min_n: int = 0) -> DataFrame:
    """OLS with absorbed effects and classical, one-way or two-way clustered errors.

    Rows (by..., term, coef, se, t, n, r2_within, dof); ``coef`` and ``se`` of a regressor that does
    not vary are NaN, its ``t`` is NULL.  Two cluster dimensions follow the
    inclusion-exclusion formula with a PSD projection; ``variance_floor`` takes the largest of
    the two-way and the one-way errors.
    """
    by, fe, cluster = list(by), list(fe), list(cluster)
    d, names = prepare(df, y, xs, fe, cluster, by, const)
    if cluster:
        # the moments and every cluster dimension read these rows again
        d = materialise(d, "ols")
    k = len(names)
    g = products(d, y, names, by)
    if min_n:
        g = g.where(F.col("n") >= min_n)
    s = solve(g, k)
    if fe:
        lv = d.groupBy(*by).agg(sum((F.countDistinct(f) for f in fe[1:]), F.countDistinct(fe[0])).alias("n_fe"))
        s = _small_join(s, lv, by)
    else:
        s = s.withColumn("n_fe", F.lit(0))
    s = s.withColumn("k_eff", F.col("n_fe") + k)
    explained = F.lit(0.0)
    for i in range(k):
        explained = explained + F.col("beta")[i] * F.col("xy")[i]
    s = s.withColumn("ssr", F.greatest(F.col("yy") - explained, F.lit(0.0)))
    s = s.withColumn("tss", F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))
    s = s.withColumn("dof_r", F.greatest(F.col("n") - F.col("k_eff"), F.lit(1)).cast("double"))
    if not cluster:
        s = s.withColumn("se", F.expr(f"transform(sequence(0, {k - 1}), i -> sqrt(greatest(inv[i * {k} + i] * ssr / dof_r, 0D)))"))
        s = s.withColumn("dof", F.col("dof_r"))
    else:
        u = attach(d, s, ["beta"], by, bounded)
        sc = u.withColumn("_u", F.col(y) - _lin(names)).select(
            *dict.fromkeys([*by, *cluster]), *[(F.col(x) * F.col("_u")).alias(f"_s{i}") for i, x in enumerate(names)])
        dims = [[c] for c in cluster] + ([cluster] if len(cluster) > 1 else [])
        for m, dim in enumerate(dims):
            per = sc.groupBy(*by, *[c for c in dim if c not in by]).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)])
            meat = per.groupBy(*by).agg(
                F.array(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(k) for j in range(k)]).alias(f"m{m}"),
                F.count("*").cast("double").alias(f"g{m}"))
            s = _small_join(s, meat, by)
            adj = (F.col(f"g{m}") / F.greatest(F.col(f"g{m}") - 1, F.lit(1.0))) * ((F.col("n") - 1) / F.col("dof_r"))
            s = s.withColumn(f"a{m}", adj if small_sample else F.lit(1.0))
            s = s.withColumn(f"m{m}", F.expr(f"transform(m{m}, v -> v * a{m})"))
        if len(cluster) == 1:
            meats, dof = [F.col("m0")], F.col("g0") - 1
        else:
            both = F.expr(f"transform(sequence(0, {k * k - 1}), i -> m0[i] + m1[i] - m2[i])")
            meats = [both] + ([F.col("m0"), F.col("m1")] if variance_floor else [])
            dof = F.least("g0", "g1") - 1
        s = s.withColumn("se", _sandwich("inv", F.array(*meats))).withColumn("dof", dof)
    z = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("term"), F.col("beta").alias("coef"), F.col("se").alias("se"),
                      F.array(*[F.col("xx")[i * k + i] for i in range(k)]).alias("own"))
    out = s.select(*by, "n", "dof", "ssr", F.when(F.col("tss") > 0, 1 - F.col("ssr") / F.col("tss")).alias("r2_within"), F.explode(z).alias("z"))
    # a regressor without any variation has no coefficient; the pseudo-inverse would call it zero
    none, coef, se = F.col("z.own") == 0, F.col("z.coef"), F.col("z.se")
    known = lambda c: F.when(none, F.lit(float("nan"))).otherwise(c)
    return out.select(*by, F.col("z.term").alias("term"), known(coef).alias("coef"), known(se).alias("se"),
                      F.when(~none & (se > 0), coef / se).alias("t"), "n", "r2_within", "ssr", F.col("dof").cast("double").alias("dof"))


def _small_join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two result tables of one row per group; a single row is attached as a scalar."""
    if by:
        return a.join(b, list(by))
    return with_scalars(a, b, "_one").select(*a.columns, *[F.col(f"_one.{c}").alias(c) for c in b.columns])


def coefficients(df: DataFrame, y: str, xs: Sequence[str], fe=(), by=(), const: bool | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(prepared rows, one row of ``beta`` per group, names): for fitted values and residuals."""
    d, names = prepare(df, y, xs, list(fe), [], list(by), const)
    return d, solve(products(d, y, names, by), len(names)), names


def horse_race(df: DataFrame, y: str, specs: dict[str, Sequence[str]], fe: Sequence[str] = ()) -> DataFrame:
    """Within R2 of several regressor sets from one Gram matrix."""
    xs = sorted({x for v in specs.values() for x in v})
    d, names = prepare(df, y, xs, list(fe), [], [], None)
    g = products(d, y, names)
    pos = {n: i for i, n in enumerate(names)}
    base = ["const"] if "const" in names else []
    rows = [(label, [pos[n] for n in base + list(v)]) for label, v in specs.items()]
    e = g.withColumn("spec", F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.array(*[F.lit(i) for i in ix]).alias("ix")) for a, ix in rows])))
    k = len(names)
    sub_xx = F.expr(f"flatten(transform(spec.ix, i -> transform(spec.ix, j -> xx[i * {k} + j])))")
    sub_xy = F.expr("transform(spec.ix, i -> xy[i])")
    e = e.withColumn("sxx", sub_xx).withColumn("sxy", sub_xy).withColumn("_b", _solve("sxx", "sxy"))
    fit = F.expr("aggregate(sequence(0, size(sxy) - 1), 0D, (a, i) -> a + _b[i] * sxy[i])")
    return e.select(F.col("spec.label").alias("spec"), "n", (fit / (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2_within"))
