"""Language-model scores by context-tree weighting over bytes.

A text (A-Z lower-cased, null as empty) is its UTF-8 bytes and one end symbol, each predicted from
the ``DEPTH`` bytes before it.  A byte is eight binary decisions; every node of the binary tree has
its own tree of byte contexts, whose nodes hold a Krichevsky-Trofimov estimate of the bits seen
after that context.  Context-tree weighting mixes the estimates of all depths: a node's weighted
probability is half its own block probability and half the product of its children's, so the
posterior weight of each depth follows from the training counts.  The score is the log10
probability of the text under the mixture; the code length per byte follows from it.

Training counts are runs of ``DEPTH + 1`` bytes, reduced in each task and summed by Spark; shorter
contexts are marginals of them.  Contexts that share their last two bytes form a group, in which
the recursion runs up to that depth; what is above is one row per last byte and decision, at most
65,280 rows.  Texts to be scored add their unseen runs with count 0, so that every run that occurs
gets its probability once.  That table is sent to the executors in slices of at most
``SLICE`` runs; a larger table means further passes, each with its slice, whose sums are added.

The word base counts every training word exactly.  Frequent words, at most ``HOT``, are looked up in
the pass; the tokens of all other words meet their counts by a join.

Edge cases: null and empty texts are scored as the end symbol alone.  A null id is never held out.
Repeated rows are scored alike.  Without training rows all counts are 0.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import LOW, HashTable, Workspace, fold_remainder, text_slices, to_workers, word_hashes

DEPTH = 5
SLICE = 4_000_000
HOT = 1 << 19
#: Runs that a task collects before it reduces them.
HELD = 2_000_000
GRAM, WORD, DOCS = 0, 1, 2
_HALF = np.log(0.5)


def runs(b: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """Codes of ``depth + 1`` bytes for every byte and end symbol, text after text (length of each text and one); texts begin after zeros."""
    n = np.diff(offs)
    x = np.zeros(len(b) + len(n) * (depth + 1) + depth, dtype=np.uint64)
    at = np.arange(len(b)) + np.repeat(np.arange(len(n)) * (depth + 1) + depth, n)
    x[at] = LOW[b]
    total = len(b) + len(n) * (depth + 1)
    code = np.zeros(total, dtype=np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= x[k : k + total]
    inside = np.ones(total, dtype=bool)  # a code that begins at place i ends at place i + depth
    starts = np.cumsum(n + depth + 1)
    for k in range(1, depth + 1):
        inside[starts - k] = False
    return code[inside]


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {}
        size, docs = 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (kind, learnt), parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n if learnt else np.zeros_like(n))], names=["kind", "key", "n"])
            held.clear()

        for batch in batches:
            learn = np.array(batch.column(0).to_pylist(), dtype=bool)
            for lo, hi, b, offs in text_slices(batch, "text"):
                some = learn[lo:hi]
                codes = runs(b, offs, depth)
                of = np.repeat(some, np.diff(offs) + 1)
                words, first = word_hashes(b, offs)
                held.setdefault((GRAM, True), []).append(codes[of])
                held.setdefault((GRAM, False), []).append(np.unique(codes[~of]))
                held.setdefault((WORD, True), []).append(words[np.repeat(some, np.diff(first))])
                size, docs = size + len(codes), docs + int(some.sum())
                if size >= HELD:
                    yield from rows()
                    size = 0
        yield from rows()
        yield pa.RecordBatch.from_arrays([pa.array([DOCS], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5 by Stirling's series after eight steps of the recurrence."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    z = 1 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    small = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - np.log(shift)
    return np.where(x > 1e6, (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x), small)


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability of a one after a zeros and b ones."""
    return (b + 0.5) / (a + b + 1.0)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, posterior weight of the node's own estimate); ``below``: sum of the children's."""
    own = _HALF + block(a, b)
    total = np.logaddexp(own, _HALF + below)
    return total, np.exp(own - total)


def levels(codes: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list, list[tuple]]:
    """Of one group: per decision of each run its node and bit, and per depth from ``depth`` to ``top`` (keys, a, b, ln weighted, own weight)."""
    sym, ctx = codes & np.uint64(255), codes >> np.uint64(8)
    nodes = np.stack([np.uint64(1 << j) | (sym >> np.uint64(8 - j)) for j in range(8)])
    bits = np.stack([(sym >> np.uint64(7 - j)) & np.uint64(1) for j in range(8)]).astype(bool)
    keys, where = np.unique((ctx << np.uint64(8)) | nodes, return_inverse=True)
    where = where.reshape(-1)
    weight = np.tile(n.astype(np.float64), 8)
    a = np.bincount(where, weights=np.where(bits.ravel(), 0, weight), minlength=len(keys))
    b = np.bincount(where, weights=np.where(bits.ravel(), weight, 0), minlength=len(keys))
    out = [(keys, a, b, block(a, b), np.ones(len(keys)))]
    for d in range(depth - 1, top - 1, -1):
        mask = np.uint64((1 << (8 * d + 8)) - 1)
        up, to = np.unique(keys & mask, return_inverse=True)
        below = np.bincount(to, weights=out[-1][3], minlength=len(up))
        a, b = np.bincount(to, weights=a, minlength=len(up)), np.bincount(to, weights=b, minlength=len(up))
        keys = up
        out.append((keys, a, b, *weigh(a, b, below)))
    return [nodes, bits, (ctx << np.uint64(8))], out


def _upward(depth: int, top: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, out = levels(rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(), depth, top)
        keys, a, b, total, _ = out[-1]
        return pd.DataFrame({"place": (keys & np.uint64(0xFFFF)).astype(np.int64), "a": a, "b": b, "total": total})

    return run


def probabilities(codes: np.ndarray, n: np.ndarray, depth: int, top: int, base: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """log10 probability of each run's last byte; ``base + factor * p`` mixes in the depths above ``top``, by last byte and node."""
    (nodes, bits, ctx), out = levels(codes, n, depth, top)
    p = None
    for d, (keys, a, b, _, own) in zip(range(depth, top - 1, -1), out, strict=True):
        at = np.searchsorted(keys, (ctx & np.uint64((1 << (8 * d + 8)) - 1)) | nodes)
        kt = estimate(a, b)[at]
        p = kt if p is None else own[at] * kt + (1 - own[at]) * p
    place = ((ctx & np.uint64(0xFF00)) | nodes).astype(np.int64)
    p = base[place] + factor[place] * p
    return np.log10(np.where(bits, p, 1 - p)).sum(axis=0)


def _downward(depth: int, top: int, sent):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["key"].to_numpy(np.int64)
        return pd.DataFrame({"key": codes, "lp": probabilities(codes.view(np.uint64), rows["n"].to_numpy(), depth, top, *sent.value).astype(np.float32)})

    return run


def above(place: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, factor) of depths 1 and 0, by last byte and node, from the sums over the groups below."""
    a1, b1, l1 = (np.bincount(place, weights=x, minlength=1 << 16) for x in (a, b, total))
    total1, own1 = weigh(a1, b1, l1)
    sums = [x.reshape(256, 256).sum(axis=0) for x in (a1, b1, total1)]
    _, own0 = weigh(*sums)
    own0, kt0 = np.tile(own0, 256), np.tile(estimate(*sums[:2]), 256)
    return own0 * kt0 + (1 - own0) * own1 * estimate(a1, b1), (1 - own0) * (1 - own1)


_tables: dict[str, HashTable] = {}


def _table(name: str, sent) -> HashTable:
    if name not in _tables:
        _tables.clear() if len(_tables) > 3 else None
        _tables[name] = HashTable(*sent.value)
    return _tables[name]


def _by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, over nothing but these: equal texts get equal sums wherever they stand."""
    some = np.flatnonzero(np.diff(first))
    total = np.zeros(len(first) - 1)
    if len(some):
        total[some] = np.add.reduceat(values.astype(np.float64, copy=False), first[some])
    return total


def _score(depth: int, model, hot, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = _table(names[0], model), _table(names[1], hot)
        for batch in batches:
            for lo, hi, b, offs in text_slices(batch, "text"):
                ends = offs + np.arange(len(offs))
                lp = np.empty(int(ends[-1]))
                codes = runs(b, offs, depth)
                for k in range(0, len(codes), 1 << 18):
                    lp[k : k + (1 << 18)] = grams.find(codes[k : k + (1 << 18)], np.float32(0))
                h, first = word_hashes(b, offs)
                value = words.find(h, np.nan)
                rare = np.isnan(value)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                known = np.bincount(doc[~rare], minlength=hi - lo)
                base = _by_doc(np.where(rare, 0.0, value), first)
                rd, rh = doc[rare], h[rare]
                order = np.lexsort((rh, rd))
                rd, rh = rd[order], rh[order]
                new = np.flatnonzero(np.concatenate(([True], (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])))[: len(rd)])
                count = np.diff(np.append(new, len(rd)))
                bounds = pa.array(np.searchsorted(rd[new], np.arange(hi - lo + 1)), pa.int32())
                part = batch.slice(lo, hi - lo)
                cols = [pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(np.diff(offs) + 1), pa.array(_by_doc(lp, ends))]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(rh[new].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *cols, *lists], names=["rid", "doc_id", "held_out", "text_hash", "words", "known", "base", "n_bytes", "score", "rare", "times"])

    return run


def score(docs: DataFrame, learn=None, depth: int = DEPTH, slice_: int = SLICE, hot_words: int = HOT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``learn`` is the condition on ``doc_id`` of the rows that are learnt from; the default leaves one fold of five out.
    """
    spark, top = docs.sparkSession, min(2, depth)
    ws = Workspace(spark, "ctw")
    held = F.coalesce(fold_remainder(F.col("doc_id")) == 1, F.lit(False)) if learn is None else ~learn
    counts = to_workers(docs.select((~held).alias("learn"), "text"), _count(depth), "kind int, key long, n long")
    counts = ws.keep(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = counts.where(F.col("kind") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = n_words + n_docs, distinct + (n_docs > 0)
    of = n + 0.5 * (v + 1)

    # the smallest count at which no more than ``hot_words`` words are left, from one row per count
    least, left = 1 << 62, hot_words
    for r in words.groupBy(F.least("n", F.lit(1 << 14)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["n"]
    got = words.where(F.col("n") >= least).toArrow()
    hot = spark.sparkContext.broadcast((got.column("key").to_numpy().view(np.uint64), np.log10((got.column("n").to_numpy() + 0.5) / of)))

    grams = counts.where(F.col("kind") == GRAM).select("key", "n", F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("tail"))
    up = grams.groupBy("tail").applyInPandas(_upward(depth, top), "place long, a double, b double, total double")
    up = up.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("a", "b", "total"))).toArrow()  # at most 65,280 rows
    sent = spark.sparkContext.broadcast(above(*(up.column(k).to_numpy() for k in range(4))))
    model = ws.keep(grams.groupBy("tail").applyInPandas(_downward(depth, top, sent), "key long, lp float"))
    slices = max(1, -(-model.count() // slice_))

    def part(k: int):
        t = model.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k).toArrow()
        return spark.sparkContext.broadcast((t.column("key").to_numpy().view(np.uint64), t.column("lp").to_numpy()))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "rid long, doc_id long, held_out boolean, text_hash long, words long, known long, base double, n_bytes long, score double, rare array<long>, times array<int>"
    scored = lambda k: to_workers(rows, _score(depth, part(k), hot, (uuid.uuid4().hex, uuid.uuid4().hex)), schema)
    out = ws.keep(scored(0))
    rare = out.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    cold = words.where(F.col("n") < least)
    rare = rare.join(cold, "key", "left").groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(of)))).alias("more_base"))
    out = out.drop("rare", "times").join(rare, "rid", "left")
    if slices > 1:
        more = [ws.keep(scored(k).select("doc_id", "text_hash", "score").groupBy("doc_id", "text_hash").agg(F.min("score").alias("score"))) for k in range(1, slices)]
        for m in more[1:]:
            more[0] = more[0].union(m)
        rest = more[0].groupBy("doc_id", "text_hash").agg(F.sum("score").alias("_more")).toDF("_d", "_t", "_more")
        out = out.join(rest, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left").withColumn("score", F.col("score") + F.col("_more"))
    end = F.lit(float(np.log10((n_docs + 0.5) / of)))
    return out.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
