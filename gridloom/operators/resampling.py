"""Resampling tests whose draws are columns of a matrix, not copies of the rows.

A batch of rows is met by all draws at once: flipped or permuted values form a (rows x draws) matrix
and what a draw's statistic needs are sums over its rows.  A task sends those sums on, as arrays, so
200 draws read the data as often as one.  Signs and permutations come from hashes of keys, so a
retried task draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.num import div
from gridloom.operators.joins import with_group
from gridloom.session import materialise

#: keys whose sums a task holds before it sends them on
KEYS = 4096
#: rows of a group that are permuted among each other; larger groups are cut at random
PART = 4096


def sign_words(draws: int, seed: int, *keys: str) -> Column:
    """One bit a draw, 64 in a word, from the row's keys."""
    return F.array(*[F.xxhash64(F.lit(seed), F.lit(k), *keys) for k in range(-(-draws // 64))])


def signs(words: np.ndarray, draws: int) -> np.ndarray:
    """(rows, draws) of +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8), axis=1, bitorder="little")
    return 1.0 - 2.0 * bits[:, :draws]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def signed_sums(rows: DataFrame, draws: int, key: str) -> DataFrame:
    """Sums of y = fit + sign * res for the observed signs (draw 0) and ``draws`` sets of flipped ones.

    ``rows``: key, bucket, x, means, fit, res, words.  Regressor i is x where bucket <= i, else 0, less
    ``means[i]``.  Result, to be summed over tasks: for a key its rows ``n`` and the sums ``v`` of y per
    draw; with a null key and null ``n`` the products of every regressor with y per draw, regressor by
    regressor, and y squared last.
    """
    kind = rows.schema[key].dataType
    rows = rows.select(key, "bucket", "x", "means", "fit", "res", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, held, keys_type = None, {}, None

        def send():
            ks = list(held)
            return pa.RecordBatch.from_arrays([pa.array(ks, keys_type), pa.array([held[k][0] for k in ks], pa.int64()), pa.array([held[k][1] for k in ks], pa.list_(pa.float64()))], names=[key, "n", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys_type, n = batch.column(0).type, batch.num_rows
            bucket, x, fit, res = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
            means = _matrix(batch.column(3), n)
            a = (bucket[:, None] <= np.arange(means.shape[1])) * x[:, None] - means
            y = np.column_stack([fit + res, fit[:, None] + res[:, None] * signs(_matrix(batch.column(6), n), draws)])
            here = np.vstack([a.T @ y, (y * y).sum(0)])
            products = here if products is None else products + here
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums, counts = np.add.reduceat(y[order], starts), np.diff([*starts, n])
            for k, c, s in zip(coded.dictionary.take(pa.array(codes[order][starts])).to_pylist(), counts, sums):
                m, t = held.get(k, (0, 0.0))
                held[k] = m + int(c), t + s
            if len(held) > KEYS:
                yield send()
                held.clear()
        if held:
            yield send()
        if products is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, keys_type), pa.nulls(1, pa.int64()), pa.array([products.ravel()], pa.list_(pa.float64()))], names=[key, "n", "v"])

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, n long, v array<double>")


def draw_moments(rows: DataFrame, draws: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(regressor, draw, value) of the products over all rows, and (draw, between): sum of y squared explained by the key's means."""
    sums = materialise(signed_sums(rows, draws, key), "signed")
    at = sums.where("n is null").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("value"))
    products = at.select(F.floor(F.col("at") / (draws + 1)).cast("int").alias("regressor"), F.pmod("at", F.lit(draws + 1)).alias("draw"), "value")
    per = sums.where("n is not null").select(key, "n", F.posexplode("v").alias("draw", "v")).groupBy(key, "draw").agg(F.sum("n").alias("n"), F.sum("v").alias("s"))
    return products, per.groupBy("draw").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))


def permuted_sums(df: DataFrame, value: str, label: str, group: str, draws: int, seed: int, order: list[str], part: int = PART) -> DataFrame:
    """(group, label, draw, n, s, q): count, sum and sum of squares of the values a label gets, draw 0 as observed.

    Values are permuted among the labels within a group.  A group of more than ``part`` rows is cut into
    random parts of about that size and permuted within them, which is a permutation of the group too;
    so no task holds a group.  ``order`` settles the places of rows before they are drawn.
    """
    d = df.select(F.col(group).alias("g"), F.col(label).alias("l"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), *order).alias("o"))
    d = with_group(d, ["g"], rows=F.count("*")).withColumn("part", F.pmod("o", F.ceil(F.col("rows") / part)))
    d = d.withColumn("seed", F.xxhash64(F.lit(seed), "g", "part"))
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for c in ("g", "l")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "v"], kind="stable")
        codes, labels = pd.factorize(pdf["l"], sort=True, use_na_sentinel=False)
        at = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[at], prepend=-1))
        v = pdf["v"].to_numpy()
        rng = np.random.default_rng(int(pdf["seed"].iloc[0]) & (2**64 - 1))
        drawn = np.vstack([v[at], *(rng.permutation(v) for _ in range(draws))])
        s, q = np.add.reduceat(drawn, starts, axis=1), np.add.reduceat(drawn * drawn, starts, axis=1)
        names = pd.Series(labels).astype(object)
        names = names.where(names.notna(), None)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(starts), "l": names, "n": np.diff([*starts, len(v)]), "s": list(s.T), "q": list(q.T)})

    sums = d.groupBy("g", "part").applyInPandas(run, ", ".join([*kinds, "n long", "s array<double>", "q array<double>"]))
    per = sums.select("g", "l", "n", F.posexplode(F.arrays_zip("s", "q")).alias("draw", "z")).groupBy("g", "l", "draw")
    return per.agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q")).select(F.col("g").alias(group), F.col("l").alias(label), "draw", "n", "s", "q")


def morans_by_draw(df: DataFrame, value: str, group: str, entity: str, date: str, draws: int, seed: int, part: int = PART) -> DataFrame:
    """(date, draw, moran) with same-group row-normalised weights; null where no group of two has spread.

    The products of a row with its peers' mean add up to (s^2 - q) / (n - 1) over a group, so sums per
    group are all a draw needs.
    """
    d = with_group(df.where(F.col(value).isNotNull()).select(entity, date, group, value), [date], _m=F.avg(value))
    d = d.select(entity, date, group, (F.col(value) - F.col("_m")).alias("_z"))
    per = permuted_sums(d, "_z", group, date, draws, seed, [entity, date], part).where("n > 1")
    near = F.sum((F.col("s") * F.col("s") - F.col("q")) / (F.col("n") - 1))
    return per.groupBy(date, "draw").agg(div(near, F.sum("q")).alias("moran"))
