"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Candidates are dealt into shards of a bounded number of vectors by the hash of their row number; queries
into blocks.  A task holds one shard and one block.  It builds the shard's ball tree (split at the
median along the direction between two far points), bounds each leaf for each query by
``q.c + |q| r``, and visits leaves in the order of their bounds until the next bound is below the
query's k-th score.  The k-th score is shared: one shard is searched first, and what it found is the
starting bound of every other shard, so most leaves fall away unopened.  Ties are never pruned.

Every shard meets every block of queries, as the task asks (a stated query set against all rows, in
blocks); each pair of shard and block gives at most k rows a query, and a window keeps the best k.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part.
Vectors of another length than the query's are no candidates of it.  Rows that share an
id are candidates and queries each, and candidates of one another; a null id takes no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace

SHARD = 16384
BLOCK = 2048
LEAF = 256
SCHEMA = "query_row long, query_id long, vec_id long, score long"


class BallTree:
    """Leaves of a ball tree: rows in leaf order, and of each leaf its range, centre and radius."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.spans = np.arange(len(x)), []
        todo = [(0, len(x))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                self.spans.append((lo, hi))
                continue
            rows = x[self.order[lo:hi]]
            far = rows[np.argmax(((rows - rows[0]) ** 2).sum(1))]
            other = rows[np.argmax(((rows - far) ** 2).sum(1))]
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows @ (far - other), mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.spans.sort()
        self.x = x[self.order]
        self.centre = np.array([self.x[a:b].mean(0) for a, b in self.spans])
        self.radius = np.array([math.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(self.spans, self.centre, strict=True)])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each leaf's vectors, rounding included."""
        up = q @ self.centre.T + np.linalg.norm(q, axis=1)[:, None] * self.radius
        return up + 1e-9 * np.abs(up) + 1e-6


def search(tree: BallTree, row_of: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the shard, score) of the best ``k`` of each query in this shard, none below its ``floor``.

    Ties go to the smaller place; a query does not meet the row it ``own``s.
    """
    up = tree.bounds(q)
    turn = np.argsort(-up, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    kth = floor.astype(float)
    live = np.arange(len(q))
    for step in range(len(tree.spans)):
        leaf = turn[live, step]
        go = up[live, leaf] >= kth[live]
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        for n in np.unique(leaf):
            rows = live[leaf == n]
            a, b = tree.spans[n]
            s = q[rows] @ tree.x[a:b].T
            s[own[rows][:, None] == row_of[tree.order[a:b]][None, :]] = -np.inf
            score = np.concatenate([best[rows], s], axis=1)
            owner = np.concatenate([who[rows], np.broadcast_to(tree.order[a:b], s.shape)], axis=1)
            keep = np.lexsort((owner, -score), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(score, keep, 1), np.take_along_axis(owner, keep, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])
    row, col = np.nonzero(np.isfinite(best) & (best >= floor[:, None]))
    return row, who[row, col], best[row, col]


def _integers(v: pd.Series) -> np.ndarray:
    """Vectors as rows; doubles hold the inner products exactly below 2^53."""
    return np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1)


def _task(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        left = left.sort_values(["vec_id", "row"])  # places in the order of ties
        tree = BallTree(_integers(left["v"]))
        floor = right["floor"].fillna(-np.inf).to_numpy(float)
        own = right["query_row"].to_numpy(np.int64)
        row, who, score = search(tree, left["row"].to_numpy(np.int64), own, _integers(right["q"]), k, floor)
        return pd.DataFrame({"query_row": own[row], "query_id": right["query_id"].to_numpy(np.int64)[row], "vec_id": left["vec_id"].to_numpy(np.int64)[who], "score": score.astype(np.int64)})

    return run


def _span(first: int, last: int):
    return F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))


def vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id and the integer vector floor(scale * x) of every row; null ids and invalid vectors are left out."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * F.lit(scale)))
    ok = (F.size(vec_col) > 0) & F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def top_k(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query with every other row, ties to the smaller id.

    ``queries`` is a condition on ``vec_id`` that picks the query rows.
    """
    ws = Workspace(df.sparkSession, "topk")
    rows = ws.keep(vectors(df, id_col, vec_col, scale).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where(queries)
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(m / BLOCK))
    cand = rows.select("vec_id", "row", "v", "dim", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    ask = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("q_dim"), F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(blocks)).alias("q_block"))

    def meet(left: DataFrame, right: DataFrame, first: int, last: int) -> DataFrame:
        left = left.where(F.col("shard").between(first, last)).withColumn("block", F.explode(_span(0, blocks - 1)))
        right = right.withColumn("q_shard", F.explode(_span(first, last)))
        return left.groupBy("dim", "shard", "block").cogroup(right.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(_task(k), SCHEMA)

    found = ws.keep(meet(cand, ask.withColumn("floor", F.lit(None).cast("double")), 0, 0))
    if shards > 1:
        kth = found.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).drop("n")
        found = found.unionByName(meet(cand, ask.join(kth, "query_row", "left"), 1, shards - 1))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
