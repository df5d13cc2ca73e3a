"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other text, labelled clean or not labelled at
all, is unlabelled.  A logistic classifier over hashed words and word beginnings minimises the
class-prior-corrected risk  ``pi R+(+) + max(0, Ru(-) - pi R+(-))``: what the positives add to the
negative risk of the unlabelled texts is taken out again, and a step that would drive the remainder
below zero is reversed.  The prior is the share of toxic rows among the learnable labels.

Learning sees at most ``POSITIVES`` and ``UNLABELLED`` texts, picked by the hash of their id at a
rate computed from the counts, and only rows of the learning folds; scoring is one pass over whole
texts.  Features come from the text alone.

Edge cases: null and empty texts have no features and get the score of the bias.  Without any
learnable toxic row every score is 0.  Repeated labels of one id count as toxic if one of them is;
null labels are ignored.  Repeated rows get equal scores.  Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NO_LETTER, fold_remainder, text_slices, to_workers, word_hashes

POSITIVES, UNLABELLED = 4000, 12000
BITS = 18
PREFIXES = (4, 6)
STEPS, RATE, PENALTY = 400, 0.05, 1e-4
#: Standard errors by which a feature's share must be larger among positives than among unlabelled texts to be used.
TELLING = 5.0


def features(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, and where each text's begin."""
    h, first, *starts = word_hashes(b, offs, NO_LETTER, PREFIXES)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(first)) << np.uint64(BITS)
    top = np.uint64(64 - BITS)
    key = np.unique(np.concatenate([doc | (x >> top) for x in (h, *starts)]))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(offs), dtype=np.uint64) << np.uint64(BITS))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margins(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[flat], dtype=np.float64)))
        return self.bias + total[first[1:]] - total[first[:-1]]


def telling(pos: list[np.ndarray], unl: list[np.ndarray], z: float = TELLING, least: int = 5) -> np.ndarray:
    """Whether a feature's share of documents is larger among the positives by ``z`` standard errors."""
    a, b = (np.bincount(np.concatenate([np.zeros(0, np.int64), *x]), minlength=1 << BITS) for x in (pos, unl))
    share = (a + b) / (len(pos) + len(unl))
    error = np.sqrt(share * (1 - share) * (1 / len(pos) + 1 / len(unl))) + 1e-12
    return (a + b >= least) & (a / len(pos) - b / len(unl) >= z * error)


def train(rows: list[tuple[bool, np.ndarray]], prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Minimise the non-negative risk by Adam over the whole samples; ``rows`` are (positive, feature numbers)."""
    dims = 1 << BITS
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    pos, unl = [f for y, f in rows if y], [f for y, f in rows if not y]
    if not pos or not unl:
        return Model(np.zeros(dims), -np.inf if not pos else bias)
    keep = telling(pos, unl)
    used = np.flatnonzero(keep)
    both = [np.searchsorted(used, f[keep[f]]) for f in pos + unl]
    n, p = np.array([len(f) for f in both]), len(pos)
    flat = np.concatenate([*both, np.zeros(1, np.int64)])[: n.sum()]
    w, share = np.zeros(len(used)), np.concatenate([np.full(p, prior / p), np.full(len(unl), 1 / len(unl))])
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    doc = np.repeat(np.arange(len(both)), n)
    for t in range(1, steps + 1):
        z = bias + np.bincount(doc, weights=w[flat], minlength=len(both))
        s = 1 / (1 + np.exp(-z))
        clean = np.logaddexp(0, z) * share  # loss of the label 'not toxic'
        if clean[p:].sum() - clean[:p].sum() >= 0:
            g = np.where(np.arange(len(both)) < p, -share, s * share)  # positives: (s - 1) as toxic, less s as clean
        else:
            g = np.where(np.arange(len(both)) < p, s * share, -s * share)
        gw, gb = np.bincount(flat, weights=g[doc], minlength=len(used)) + penalty * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(dims)
    weights[used] = w
    return Model(weights, float(bias))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b, offs in text_slices(batch, "text"):
            flat, first = features(b, offs)
            part = batch.slice(lo, hi - lo)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["confirmed", "sampled", "features"])


def fit(docs: DataFrame, labels: DataFrame, learn, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on samples of the rows for which the condition ``learn`` on ``doc_id`` holds."""
    rate = lambda n, most: F.lit(int(min(1.0, most / max(1, n)) * 2**30))
    part = lambda salt: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(2**30))
    known = labels.where(F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return Model(np.zeros(1 << BITS), -np.inf)
    some = known.where((F.col("toxic") == 1) & (part("p") < rate(toxic, positives))).select("doc_id", F.lit(True).alias("confirmed"))
    rows = docs.select("doc_id", "text").where(learn)
    rows = rows.withColumn("sampled", part("u") < rate(rows.select("doc_id").count(), unlabelled)).join(F.broadcast(some), "doc_id", "left")  # at most about ``positives`` ids
    rows = rows.where("confirmed or sampled").select(F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "sampled", "text")
    got = to_workers(rows, _featured, "confirmed boolean, sampled boolean, features array<int>").toArrow()
    each = got.column("features").combine_chunks()
    ends, flat = each.offsets.to_numpy(), each.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    pairs = [(True, s) for s, y in zip(sets, got.column("confirmed").to_pylist(), strict=True) if y] + [(False, s) for s, y in zip(sets, got.column("sampled").to_pylist(), strict=True) if y]
    return train(pairs, toxic / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxic_score`` in 0 to 1 from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = [c for c in docs.columns if c != "toxic_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            for lo, hi, b, offs in text_slices(batch, "text"):
                s = 1 / (1 + np.exp(-np.clip(m.margins(*features(b, offs)), -700, 700)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(np.where(np.isneginf(m.bias), 0.0, s))], names=[*names, "toxic_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return to_workers(docs.select(*names), run, f"{kinds}, toxic_score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fold with remainder 0 is never learnt from."""
    model = fit(docs, labels, fold_remainder(F.col("doc_id")) != 0)
    out = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold_remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), "text")
    model = fit(docs, labels, fold_remainder(F.col("doc_id")) != 0)
    return score(plain, model).where(F.col("toxic_score") < threshold).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
