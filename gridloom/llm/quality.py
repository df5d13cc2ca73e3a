"""Quality classifier: a byte-level convolutional network in numpy over whole texts.

A byte is an embedding; learned filters read eight bytes at every place of the text.  Places are
pooled by maximum into overlapping chunks of 256 bytes, a new one every 128, to the end of the text.
A chunk with few different strings reaches few of the filters, which a small dense layer over the
chunk's filter values can tell.  Filter values and dense units are pooled by maximum over all
chunks and combined by a logistic unit.  For scoring, embedding and filters are multiplied out into
one table of filter values per byte and place, so a text costs eight look-ups a byte whatever its
language.

Learning: Adam on the log loss, back through the places that gave each maximum.  It sees at most
about ``PER_CLASS`` texts of each label, of at most ``LONGEST`` bytes each, picked by the hash of
their id at a rate computed from the counts, and only rows of the learning folds; the classes weigh
in the loss as they stand among all learnable labels, with ``LEAST_SHARE`` as the least.  Scoring is
one pass over whole texts.

Edge cases: null and empty texts are scored as a chunk of padding.  Without labels of both classes
every score is the share of label 1 among the learnable labels (0 without any).  Of several labels
of one id the smallest counts; null labels are ignored.  Repeated rows get equal scores; an empty
table gives no rows; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fold_remainder, text_slices, to_workers

PER_CLASS, LONGEST = 1500, 16_384
LEAST_SHARE = 0.1
HALF = 128  # bytes between the starts of two chunks of twice as many
WIDTH, FILTERS, UNITS = 8, 24, 12
PAD = 256
EPOCHS, DOCS, RATE, PENALTY = 8, 32, 0.004, 1e-4
#: Share of the good texts that an epoch reads as a short passage, so that few different strings alone do not count as bad.
PASSAGES = 0.25
#: Half chunks worked on at a time; their filter values stay in the processor's cache.
TILE = 48


def halves(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each behind the padding of one filter and filled up to whole half chunks, and each text's first half chunk."""
    n = np.diff(offs)
    rows = -(-(n + WIDTH - 1) // HALF)
    first = np.concatenate([[0], np.cumsum(rows)])
    x = np.full(first[-1] * HALF + WIDTH - 1, PAD, np.int16)
    x[np.arange(len(b)) + np.repeat(first[:-1] * HALF - offs[:-1] + WIDTH - 1, n)] = b  # padding in front: no filter reads two texts
    return x, first


@dataclass
class Network:
    """Parameters: embedding, filters, their bias, dense layer and its bias, weights of the pooled values and the last bias."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        c = np.arange(PAD + 1)
        kinds = [(c > 96) & (c < 123), (c > 64) & (c < 91), (c > 47) & (c < 58), c == 32, c == 10, (c > 127) & (c < PAD), c == PAD]
        kinds.append(~np.any(kinds, axis=0))
        e = np.concatenate([np.stack(kinds, axis=1), rng.normal(0, 0.5, (PAD + 1, 8))], axis=1)
        d = e.shape[1]
        return Network({"e": e, "w": rng.normal(0, 1 / np.sqrt(WIDTH * 4), (WIDTH, d, FILTERS)), "c": np.zeros(FILTERS),
                        "a": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, UNITS)), "d": np.zeros(UNITS),
                        "v": rng.normal(0, 0.1, FILTERS + UNITS), "b": np.zeros(1)})

    def tables(self) -> np.ndarray:
        """Filter values of each symbol at each of the eight places."""
        return np.einsum("sd,kdf->ksf", self.parts["e"], self.parts["w"]).astype(np.float32)

    def pooled(self, x: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each half chunk, and the place that gave it if asked for."""
        n = len(x) // HALF
        top, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        acc, one = np.empty((2, TILE * HALF, FILTERS), np.float32)
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            size = (hi - lo) * HALF
            a, o = acc[:size], one[:size]
            np.take(tables[0], x[lo * HALF : lo * HALF + size], axis=0, out=a, mode="clip")
            for k in range(1, WIDTH):
                np.take(tables[k], x[lo * HALF + k : lo * HALF + k + size], axis=0, out=o, mode="clip")
                a += o
            v = a.reshape(hi - lo, HALF, FILTERS)
            v.max(axis=1, out=top[lo:hi])
            if where:
                at[lo:hi] = v.argmax(axis=1) + np.arange(lo, hi)[:, None] * HALF
        return top, at

    def _chunks(self, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The half chunks of each chunk, its rectified filter values, and each text's first chunk."""
        count = np.maximum(np.diff(first) - 1, 1)
        start = np.concatenate([[0], np.cumsum(count)])
        one = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], count)
        two = np.where(np.repeat(np.diff(first) > 1, count), one + 1, one)
        return one, two, np.maximum(np.maximum(top[one], top[two]) + self.parts["c"], 0), start

    def forward(self, x: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Log odds of label 1 of every text."""
        top, _ = self.pooled(x, tables)
        _, _, z, start = self._chunks(top, first)
        p = self.parts
        u = np.tanh(z @ p["a"] + p["d"])
        return np.concatenate([np.maximum.reduceat(z, start[:-1]), np.maximum.reduceat(u, start[:-1])], axis=1) @ p["v"] + p["b"][0]

    def step(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss over a batch of texts."""
        p = self.parts
        top, at = self.pooled(x, self.tables(), where=True)
        one, two, z, start = self._chunks(top, first)
        u = np.tanh(z @ p["a"] + p["d"])
        best = []
        for m in (z, u):  # the chunk that gave each text's maximum
            rows = [start[k] + m[start[k] : start[k + 1]].argmax(axis=0) for k in range(len(y))]
            best.append(np.array(rows))
        zi, ui = best
        zmax, umax = np.take_along_axis(z, zi, 0) if len(z) == len(zi) else z[zi, np.arange(FILTERS)], u[ui, np.arange(UNITS)]
        joined = np.concatenate([zmax, umax], axis=1)
        s = 1 / (1 + np.exp(-np.clip(joined @ p["v"] + p["b"][0], -60, 60)))
        g = (s - y) * weight
        out = {"v": g @ joined, "b": np.array([g.sum()])}
        gz = np.zeros(z.shape)
        np.add.at(gz, (zi, np.arange(FILTERS)), g[:, None] * p["v"][:FILTERS])
        gu = np.zeros(u.shape)
        np.add.at(gu, (ui, np.arange(UNITS)), g[:, None] * p["v"][FILTERS:])
        gu *= 1 - u * u
        out |= {"a": z.T @ gu, "d": gu.sum(axis=0)}
        gz += gu @ p["a"].T
        gz *= z > 0
        out["c"] = gz.sum(axis=0)
        row, f = np.nonzero(gz)
        half = np.where(top[one[row], f] >= top[two[row], f], one[row], two[row])
        place, value = at[half, f], gz[row, f]
        gt = np.zeros((WIDTH, PAD + 1, FILTERS))
        for k in range(WIDTH):
            gt[k] = np.bincount(x[place + k].astype(np.int64) * FILTERS + f, weights=value, minlength=(PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
        out |= {"w": np.einsum("sd,ksf->kdf", p["e"], gt), "e": np.einsum("ksf,kdf->sd", gt, p["w"])}
        return out


@dataclass
class Classifier:
    """A trained network, or one score for all."""

    network: Network | None
    share: float

    def scores(self, b: np.ndarray, offs: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
        if self.network is None:
            return np.full(len(offs) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(self.network.forward(*halves(b, offs), tables), -700, 700)))


def _passage(text: bytes, rng: np.random.Generator) -> bytes:
    """A few words in a row."""
    words = text.split()
    at = int(rng.integers(0, max(1, len(words))))
    return b" ".join(words[at : at + int(rng.integers(2, 24))])


def train(texts: list[bytes], y: np.ndarray, share: float, epochs: int = EPOCHS, docs: int = DOCS, rate: float = RATE, penalty: float = PENALTY) -> Classifier:
    """Fit the network to texts with labels ``y``; ``share`` of the weight goes to label 1."""
    if not len(y) or y.min() == y.max():
        return Classifier(None, share)
    net = Network.start()
    share = min(max(share, LEAST_SHARE), 1 - LEAST_SHARE)
    net.parts["b"][:] = np.log(share / (1 - share))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    m, v = ({k: np.zeros_like(p) for k, p in net.parts.items()} for _ in range(2))
    rng = np.random.default_rng(7)
    epochs, t = max(epochs, -(-240 * docs // len(y))), 0  # small samples are read more often
    steps = epochs * -(-len(y) // docs)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), docs):
            pick = order[lo : lo + docs]
            read = [_passage(texts[k], rng) if y[k] == 1 and rng.random() < PASSAGES else texts[k] for k in pick]
            x, first = halves(np.frombuffer(b"".join(read), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in read])]))
            g = net.step(x, first, y[pick], weight[pick] / len(pick))
            t += 1
            speed = rate * (1 - 0.9 * t / steps)
            for k, p in net.parts.items():
                gk = g[k] + penalty * p
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p -= speed * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Classifier(net, share)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, longest: int = LONGEST) -> Classifier:
    """Train on a sample of the labelled rows for which the condition ``learn`` on ``doc_id`` holds."""
    known = labels.where(F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    if not n:
        return Classifier(None, 0.0)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("q")), F.lit(2**30))
    rate = lambda size: F.lit(int(min(1.0, per_class / max(1, size)) * 2**30))
    y = (F.col("quality") == 1).cast("int")
    some = known.where(part < F.when(y == 1, rate(good)).otherwise(rate(n - good))).select("doc_id", y.alias("y"))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(some), "doc_id")  # about 2 * per_class ids at most
    got = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    texts = [t.encode() for t in got.column("text").to_pylist()]
    return train(texts, np.array(got.column("y").to_pylist(), dtype=np.int64), (good or 0) / n)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``quality_score`` in 0 to 1 from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.network.parts if model.network else None, model.share))
    names = [c for c in docs.columns if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, share = sent.value
        m = Classifier(Network(parts) if parts else None, share)
        tables = m.network.tables() if parts else None
        for batch in batches:
            for lo, hi, b, offs in text_slices(batch, "text"):
                s = m.scores(b, offs, tables)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(s)], names=[*names, "quality_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return to_workers(docs.select(*names), run, f"{kinds}, quality_score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fold with remainder 2 of 4 is never learnt from."""
    fold = fold_remainder(F.col("doc_id"), 4)
    out = score(docs.select("doc_id", "text"), fit(docs, labels, fold != 2))
    held = F.coalesce(fold == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
