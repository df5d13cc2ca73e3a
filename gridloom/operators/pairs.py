"""Statistics of entity pairs by tiles.

Entities are cut into blocks; a tile holds the series of two blocks (bounded by block size times
the calendar) as dense date x entity matrices, and the pair statistics come from matrix products.
No pair row is ever emitted per date.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 64


def by_tiles(df: DataFrame, entity: str, date: str, value: str, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(dates, names_a, X_a, names_b, X_b, same)`` to every pair of blocks."""
    n = df.select(entity).distinct().count()
    blocks = max(1, -(-n // BLOCK))
    d = df.select(entity, date, F.col(value).cast("double").alias("_v")).where("_v is not null")
    # positions on the global date grid (calendar-sized), so that lags agree between tiles
    g = d.select(date).distinct().withColumn("_g", F.lit(1))
    pos = g.select(date, F.row_number().over(Window.partitionBy("_g").orderBy(date)).alias("_i"),
                   F.count("*").over(Window.partitionBy("_g")).alias("_n"))
    d = d.join(pos, date)
    d = d.withColumn("_b", F.pmod(F.xxhash64(entity), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    d = d.withColumn("_o", other).withColumn("ti", F.least("_b", "_o")).withColumn("tj", F.greatest("_b", "_o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        m = pdf.drop_duplicates([entity, "_i"]).pivot(index="_i", columns=entity, values="_v")
        m = m.reindex(range(1, int(pdf["_n"].iloc[0]) + 1))
        blk = pdf.drop_duplicates(entity).set_index(entity)["_b"]
        a = [c for c in m.columns if blk[c] == i]
        b = [c for c in m.columns if blk[c] == j]
        if not a or not b:
            return fn(m.index.to_numpy(), [], np.empty((0, 0)), [], np.empty((0, 0)), True)
        return fn(m.index.to_numpy(), a, m[a].to_numpy(float), b, m[b].to_numpy(float), i == j)

    return d.groupBy("ti", "tj").applyInPandas(run, schema)


def pair_correlations(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Pairwise-complete correlation and overlap of every pair a < b."""

    def fn(dates, a, xa, b, xb, same):
        if not a:
            return pd.DataFrame({"a": np.array([], int), "b": np.array([], int), "n": np.array([], int), "corr": np.array([], float)})
        ma, mb = np.isfinite(xa).astype(float), np.isfinite(xb).astype(float)
        # centring on the column means changes nothing but the rounding
        za, zb = np.nan_to_num(xa - np.nanmean(xa, 0)), np.nan_to_num(xb - np.nanmean(xb, 0))
        n = ma.T @ mb
        sa, sb, sab = za.T @ mb, ma.T @ zb, za.T @ zb
        saa, sbb = (za * za).T @ mb, ma.T @ (zb * zb)
        with np.errstate(all="ignore"):
            c = (sab - sa * sb / n) / np.sqrt((saa - sa * sa / n) * (sbb - sb * sb / n))
        ii, jj = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
        left, right = np.array(a)[ii.ravel()], np.array(b)[jj.ravel()]
        lo, hi = np.minimum(left, right), np.maximum(left, right)
        keep = (left < right) if same else (left != right)
        return pd.DataFrame({"a": lo[keep], "b": hi[keep], "n": n.ravel()[keep].astype(int), "corr": c.ravel()[keep]})

    return by_tiles(df, entity, date, value, fn, "a long, b long, n long, corr double")


def pair_gaps(df: DataFrame, entity: str, date: str, value: str, ahead: int = 1, train_share: float = 0.6,
              min_train: int = 30, min_test: int = 20) -> DataFrame:
    """Per pair: slope of the forward gap change on the lagged gap (train dates) and its R2 on later dates.

    Lags and leads are positions on the common date grid of the tile.
    """

    def fn(dates, a, xa, b, xb, same):
        rows = []
        cut = int(len(dates) * train_share)
        for i, ea in enumerate(a):
            # one row of pairs at a time: dates x block
            gap = xa[:, [i]] - xb
            lag = np.vstack([np.full((1, gap.shape[1]), np.nan), gap[:-1]])
            fwd = np.vstack([gap[ahead:], np.full((ahead, gap.shape[1]), np.nan)]) - gap
            ok = np.isfinite(gap) & np.isfinite(lag) & np.isfinite(fwd)
            for j, eb in enumerate(b):
                if (same and not ea < eb) or ea == eb:
                    continue
                sgn = 1.0 if ea < eb else -1.0
                m = ok[:, j]
                tr, te = m.copy(), m.copy()
                tr[cut:], te[:cut] = False, False
                if tr.sum() < min_train or te.sum() < min_test:
                    continue
                x, y = sgn * lag[tr, j], sgn * fwd[tr, j]
                sl = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()))
                ic = y.mean() - sl * x.mean()
                xt, yt = sgn * lag[te, j], sgn * fwd[te, j]
                r2 = 1 - ((ic + sl * xt - yt) ** 2).sum() / (yt**2).sum()
                rows.append((min(ea, eb), max(ea, eb), float(sl), float(r2), float(np.nanmean(np.abs(gap[:, j]))), int(te.sum())))
        return pd.DataFrame(rows, columns=["a", "b", "slope", "r2_oos", "mean_abs_gap", "n_test"])

    return by_tiles(df, entity, date, value, fn, "a long, b long, slope double, r2_oos double, mean_abs_gap double, n_test long")


def off_diagonal_mean(corr: DataFrame) -> DataFrame:
    return corr.where(F.col("corr").isNotNull() & ~F.isnan("corr")).agg(F.avg("corr").alias("mean_corr"), F.count("*").alias("pairs"))


