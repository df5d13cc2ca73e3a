"""MinHash near-dedup with odd sketches.

Texts are A-Z lower-cased and cut into words at ASCII white space; a text's set holds its distinct
runs of five words (the whole sequence, if shorter).  Equal sets form a class, and only one row per
class goes on.  ``SAMPLES`` MinHash values give ``BANDS`` band keys; the same values, folded into a
parity bitmap, give an odd sketch whose XOR population count estimates the similarity of two sets.
Classes that share a band key are candidates, the sketch discards the clearly dissimilar ones, and
the full sets decide the rest.

A bucket never emits its pairs.  First every member meets the bucket's hub only, the member that
shares most buckets.  After connected components, buckets whose members are all in one component
are finished; elsewhere each member outside the bucket's largest component meets the members of
other components, so no link between components is lost.  Those pairs are first bounded exactly: two
sets cannot share more than the shingles of each that occur in another undecided class, and they
differ in at least as many shingles as the parity bitmaps of the whole sets differ in bits.

Edge cases: null text, empty text and white space have an empty set, are linked with nothing and
keep their own id.  Repeated rows are one class.  A null ``doc_id`` never becomes a component's id
unless the whole component has none.  Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_BYTES, Workspace, mix, text_slices, to_workers, word_hashes

WORDS = 5
SAMPLES, BANDS = 128, 32
ROWS = SAMPLES // BANDS
BITS = 512
#: Bits of the parity bitmap of a whole set.
PARITY = 1024
#: Sketch estimates may fall this far below the threshold before a candidate is discarded (about five standard errors).
SLACK = 0.22

_rng = np.random.Generator(np.random.PCG64(71))
_A = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_WORD = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
_THIRD = np.uint64(0x2545F4914F6CDD1D)
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingles(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, repeats included, and where each text's begin."""
    words, first = word_hashes(b, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(words))
    end = first[1:][doc]
    short = (n < WORDS)[doc]
    at = np.flatnonzero(np.where(short, i == first[:-1][doc], i + WORDS <= end))
    v = np.zeros(len(at), dtype=np.uint64)
    for k in range(WORDS):
        inside = at + k < end[at]
        v += np.where(inside, words[np.minimum(at + k, len(words) - 1)] * _WORD[k], np.uint64(0)) if len(words) else 0
    v += np.where(short[at], _SHORT * n[doc[at]].astype(np.uint64), np.uint64(0))
    return mix(v), np.searchsorted(at, first)


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """The set of ``v``, sorted, and its two fingerprints."""
    s = np.sort(v)
    s = s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
    return s, s.sum(dtype=np.uint64), mix(s ^ _SECOND).sum(dtype=np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b, offs in text_slices(batch, "text"):
            v, first = shingles(b, offs)
            some = np.flatnonzero(np.diff(first))
            size = np.zeros(hi - lo, dtype=np.int64)
            prints = np.zeros((hi - lo, 2), dtype=np.uint64)
            parity = np.zeros((hi - lo, PARITY), dtype=np.uint8)
            for d in some:
                s, *prints[d] = _distinct(v[first[d] : first[d + 1]])
                size[d] = len(s)
                parity[d] = np.bincount((mix(s ^ _THIRD) >> np.uint64(54)).astype(np.int64), minlength=PARITY) & 1
            low = np.zeros((len(some), SAMPLES), dtype=np.uint32)
            if len(some):
                x = (v >> np.uint64(32)).astype(np.uint32)
                for k in range(SAMPLES):
                    low[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], first[some])
            wide = low.astype(np.uint64)
            bands = mix((wide.reshape(-1, BANDS, ROWS) * _ROW).sum(axis=2) + _BAND).view(np.int64)
            place = mix(wide + _PLACE) % np.uint64(BITS)
            flat = (np.arange(len(some))[:, None] * BITS + place.astype(np.int64)).ravel()
            odd = (np.bincount(flat, minlength=len(some) * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd).view(np.int64)
            none = np.diff(first) == 0
            lists = lambda flat, k: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(none, 0, k)))), pa.int32()), pa.array(flat.ravel(), pa.int64()))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(size), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), lists(bands, BANDS), lists(sketch, BITS // 64), lists(np.packbits(parity[some]).view(np.int64), PARITY // 64)],
                names=["rid", "doc_id", "text_hash", "n_shingles", "p1", "p2", "bands", "sketch", "parity"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b, offs in text_slices(batch, "text"):
            v, first = shingles(b, offs)
            own, p1, p2 = zip(*(_distinct(v[first[d] : first[d + 1]]) for d in range(hi - lo)), strict=True)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own])))
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(p1, np.uint64).view(np.int64)), pa.array(np.array(p2, np.uint64).view(np.int64)), sets], names=["p1", "p2", "shingles"])


def sketch(docs: DataFrame) -> DataFrame:
    """Of every row: a row number, id, text hash, set size, set fingerprint (p1, p2), band keys, odd sketch and set parity."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return to_workers(rows, _sketches, "rid long, doc_id long, text_hash long, n_shingles long, p1 long, p2 long, bands array<long>, sketch array<long>, parity array<long>")


def _differing(a: str, b: str, bits: int):
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(bits // 64)), F.lit(0))


def sketch_similarity(a: str, b: str):
    """Jaccard estimate from the XOR population count of two odd sketches."""
    z = _differing(a, b, BITS)
    odd = F.greatest(F.lit(1.0) - F.lit(2.0 / BITS) * z, F.lit(1e-9))
    return F.lit(1.0) + F.lit(BITS / (4.0 * SAMPLES)) * F.log(odd)


def connected(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the smallest node of its component.

    Large-star and small-star steps in turn: neighbours of a node are hung on its smallest one.
    Each step is a minimum by node, combined before its shuffle, and a join; the driver sees a count.
    """
    up = ws.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = up.union(up.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", "m").union(small.where("v <> m").select("v", "m")).toDF("u", "v").distinct()
        small = ws.keep(small)
        ws.drop(up, large)
        up = small
        now = up.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return up.union(up.select("v", "v")).toDF("node", "root").distinct()
        state = now


def _full_sets(ws: Workspace, docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the nodes in ``ids``, from a text of each class."""
    ids = ws.keep(ids.join(nodes, "node").select("node", "p1", "p2", "low"))
    lows = ids.select(F.col("low").alias("_low")).distinct()
    few = ids.count() * 16 <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(lows) if few else lows, F.col("doc_id").cast("long").eqNullSafe(F.col("_low")), "left_semi").select("text")
    sets = to_workers(texts, _sets, "p1 long, p2 long, shingles array<long>").join(ids, ["p1", "p2"])
    sets = ws.keep(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    ws.drop(ids)
    return sets


def _reaches(common, na: str, nb: str, threshold: float):
    """Whether ``common`` shingles of sets of ``na`` and ``nb`` make the threshold; whole numbers only."""
    return F.lit(100) * common >= F.lit(round(100 * threshold)) * (F.col(na) + F.col(nb) - common)


def _parity_admits(a: str, b: str, na: str, nb: str, threshold: float):
    """False only for pairs below the threshold: two sets differ in no fewer shingles than their parity bitmaps in bits."""
    z = _differing(a, b, PARITY)
    return F.lit(100) * (F.col(na) + F.col(nb) - z) >= F.lit(round(100 * threshold)) * (F.col(na) + F.col(nb) + z)


def _confirmed(ws: Workspace, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; sketches discard clear failures first."""
    sk = nodes.select("node", "sketch", "n_shingles", "parity")
    near = pairs.join(sk.toDF("b", "sb", "nb", "pb"), "b").join(sk.toDF("a", "sa", "na", "pa"), "a")
    near = near.where(_reaches(F.least("na", "nb"), "na", "nb", threshold) & _parity_admits("pa", "pb", "na", "nb", threshold) & (sketch_similarity("sa", "sb") >= threshold - SLACK))
    near = ws.keep(near.select("a", "b", "na", "nb"))
    sets = _full_sets(ws, docs, nodes, near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    both = near.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a")
    links = ws.keep(both.where(_reaches(F.size(F.array_intersect("xa", "xb")), "na", "nb", threshold)).select("a", "b"))
    ws.drop(near, sets)
    return links


def _open_members(ws: Workspace, docs: DataFrame, nodes: DataFrame, split: DataFrame, threshold: float) -> DataFrame:
    """Members of undecided buckets with ``shared``, the shingles that another undecided class holds too.

    Two sets have at most the smaller ``shared`` in common, so a member whose changed passages leave
    too few shared shingles is decided without meeting anyone.
    """
    sets = _full_sets(ws, docs, nodes, split.select("node").distinct())
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    own = held.where("node = last").groupBy("node").agg(F.count("*").alias("own"))
    sizes = nodes.select("node", "n_shingles", "parity").join(own, "node", "left").select("node", "n_shingles", "parity", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("shared"))
    out = ws.keep(split.join(sizes, "node").where(_reaches(F.col("shared"), "n_shingles", "shared", threshold)))
    ws.drop(sets)
    return out


def near_classes(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and class_size (rows with an equal set).

    Then text_hash, and ``component``: a number that tells components apart where ids are null or
    repeated; null for a row that is alone in its component.
    """
    ws = Workspace(docs.sparkSession, "near")
    rows = ws.keep(sketch(docs))
    full = rows.where("n_shingles > 0")
    nodes = ws.keep(full.groupBy("p1", "p2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")))
    keys = nodes.select(F.explode("bands").alias("bucket"), "node")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = ws.keep(keys.join(sizes, "bucket"))

    shared = members.groupBy("node").agg(F.sum("size").alias("shared"))
    hubs = members.join(shared, "node").groupBy("bucket").agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("hub"))
    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirmed(ws, docs, nodes, pairs, threshold)
    roots = connected(ws, links)

    placed = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", -F.col("root"))).alias("major")).where("parts > 1")
    split = ws.keep(placed.join(most, "bucket").select("bucket", "node", "root", "major"))
    open_ = _open_members(ws, docs, nodes, split, threshold)
    minor = open_.where("root <> major").select("bucket", F.col("node").alias("m"), F.col("root").alias("mr"), F.col("major").alias("mm"), F.col("n_shingles").alias("mn"), F.col("shared").alias("ms"), F.col("parity").alias("mp"))
    met = minor.join(open_.drop("major"), [minor["bucket"] == open_["bucket"], F.expr("root <> mr and (root = mm or node < m)"), _reaches(F.least("shared", "ms"), "n_shingles", "mn", threshold), _parity_admits("parity", "mp", "n_shingles", "mn", threshold)])
    rest = met.select(F.greatest("m", "node").alias("a"), F.least("m", "node").alias("b")).distinct()
    hub_pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = _confirmed(ws, docs, nodes, rest.join(hub_pairs, ["a", "b"], "left_anti"), threshold)
    roots = connected(ws, roots.toDF("a", "b").union(more))

    # one row for each class that is linked or holds several rows
    placed = nodes.join(roots, "node", "left").select("p1", "p2", "low", "class_size", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    lows = placed.where("linked").groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.where("linked or class_size > 1").join(lows, "root", "left")
    named = ws.keep(named.select("p1", "p2", "class_size", F.coalesce("component_id", "low").alias("component_id"), F.col("root").alias("component")))
    ws.drop(nodes, members, links, split, open_, more)
    out = rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("p1")).alias("p1"), "p2").join(named, ["p1", "p2"], "left")
    cid = F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_hash", "component")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, one if that id repeats.

    Components are told apart by their own number, not by their id: texts without an id, and
    unrelated texts under one id, all stay.
    """
    rows = near_classes(docs, threshold)
    texts = rows.where("kept and component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = texts.groupBy("component").agg(F.min("text_hash").alias("first"))
    texts = texts.join(first, "component").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n", (F.col("text_hash") == F.col("first")).alias("stays"))
    # equal texts are in one component, so id and text hash name the component too
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    gone = rows.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    stay = docs.join(gone.union(texts.where("not stays").select("_id", "_hash")), same, "left_anti")
    repeated = texts.where("stays and n > 1").select("_id", "_hash")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, same).dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
    return stay.join(repeated, same, "left_anti").unionByName(once)
