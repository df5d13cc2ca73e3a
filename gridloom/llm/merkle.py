"""Merkle manifest of a dataset: subtrees per group, one root, an inclusion proof per row.

Rows get their place inside their group from one range shuffle: the order is cut into ranges (a group
with a third of the rows is cut too), places inside a range are counted as the rows are written, and
a row per (group, range) says how many stand before.  The tree then grows by ``LEVELS`` levels at a
time inside blocks of ``ARITY ** LEVELS`` consecutive nodes, one shuffle each.  In a block every
level is a lag/lead window: the nodes of level L stand on every ``ARITY ** L``-th row, so siblings
are columns at fixed offsets of so many rows, masked by slot and by the length of the run, and the
rows of first children hash the parents.  The way back down is the same with lag columns: each row
takes the steps of its parent's row.  The first nodes of the blocks are the input of the next round,
and the roots of the groups form one more tree of the same kind.

A step of a proof is the concatenated digests of the run to the left and to the right of the node;
a run of one node has a step with two empty sides, since its parent is its digest hashed again.

Edge cases: a null group is a group of its own and comes first; null fields are ``-``; a group of one
row is its own root; rows with equal order keys follow by leaf digest, nulls first, and equal rows
all get a place; an empty table has an empty manifest; texts are hashed whole where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, bounded, fold_remainder

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Bytes of a row with a proof, about: digests of up to 20 levels.
PROOF_BYTES = 2 * 64 * 20
#: monotonically_increasing_id() holds the partition above this bit.
PARTITION_BIT = 33


def field(c: Column) -> Column:
    """UTF-8 byte count, ':' and value; '-' for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def proof_digest(steps: Column) -> Column:
    """One digest over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(steps: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def placed(ws: Workspace, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) by ``order`` inside their ``key`` and the ``size`` of the key."""
    at = ws.keep(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_range", F.shiftright("_at", PARTITION_BIT))
    per = at.groupBy("key", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    one = Window.partitionBy("key")  # a row per range, not per node
    before = F.coalesce(F.sum("_n").over(one.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = ws.keep(per.select("key", "_range", "_first", before.alias("_before"), F.sum("_n").over(one).alias("size")))
    pos = F.col("_before") + F.col("_at") - F.col("_first")
    return at.join(bounded(per, per.count(), 100), ["key", "_range"]).select(*rows.columns, pos.alias("pos"), "size")


def _level(k: int) -> tuple[int, Column, Column, Column, Column]:
    """Of level ``k`` of a block: rows between two nodes, whether the row holds one, its slot, the length of its run, whether a level follows."""
    span = ARITY**k
    nodes = F.floor((F.col("size") + (span - 1)) / span)
    at = F.floor(F.col("pos") / span)
    slot = at % ARITY
    return span, F.col("pos") % span == 0, slot, F.least(F.lit(ARITY), nodes - at + slot), nodes > 1


def climb(nodes: DataFrame) -> DataFrame:
    """``LEVELS`` levels over (key, pos, size, node, …): adds ``steps`` of every row and ``top`` on the first row of a block."""
    w = Window.partitionBy("key", "block").orderBy("pos")
    df = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("n0", F.col("node"))
    names = df.columns[:-1]
    for k in range(LEVELS):
        span, here, slot, run, live = _level(k)
        ups = [F.lead(f"n{k}", span * j).over(w).alias(f"a{j}") for j in range(1, ARITY)]
        backs = [F.lag(f"n{k}", span * j).over(w).alias(f"b{j}") for j in range(1, ARITY)]
        steps = [f"s{i}" for i in range(k)]
        df = df.select(*names, *steps, f"n{k}", *ups, *backs)
        left = F.concat(*(F.when(slot >= j, F.col(f"b{j}")).otherwise("") for j in range(ARITY - 1, 0, -1)))
        right = F.concat(*(F.when(slot + j < run, F.col(f"a{j}")).otherwise("") for j in range(1, ARITY)))
        step = F.when(here & live, F.struct(left.alias("l"), right.alias("r")))
        parent = F.when(here & (slot == 0), F.when(live, digest(F.col(f"n{k}"), right)).otherwise(F.col(f"n{k}")))
        df = df.select(*names, *steps, step.alias(f"s{k}"), parent.alias(f"n{k + 1}"))
    whole = lambda s: F.when(F.col(s).isNotNull(), F.array(s)).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
    names = [*names, f"n{LEVELS}"]
    df = df.select(*names, *(f"s{i}" for i in range(LEVELS - 1)), whole(f"s{LEVELS - 1}").alias("steps"))
    for k in range(LEVELS - 2, -1, -1):  # a row of level k takes the steps of its parent's row, so many slots back
        span, _, slot, _, _ = _level(k)
        steps = [f"s{i}" for i in range(k)]
        df = df.select(*names, *steps, f"s{k}", "steps", *(F.lag("steps", span * j).over(w).alias(f"b{j}") for j in range(1, ARITY)))
        above = F.col("steps")
        for j in range(1, ARITY):
            above = F.when(slot == j, F.col(f"b{j}")).otherwise(above)
        df = df.select(*names, *steps, F.concat(whole(f"s{k}"), above).alias("steps"))
    return df.withColumnRenamed(f"n{LEVELS}", "top")


def grown(ws: Workspace, rows: DataFrame) -> list[DataFrame]:
    """The rounds over placed rows (key, pos, size, node, …), the leaves first; the last has one block per key."""
    rounds, left = [], rows.agg(F.max("size")).first()[0] or 0
    while left:
        rounds.append(ws.keep(climb(rows)))
        left = 0 if left <= BLOCK else -(-left // BLOCK)
        first = rounds[-1].where(F.col("pos") % BLOCK == 0)
        rows = first.select("key", F.col("block").alias("pos"), F.floor((F.col("size") + (BLOCK - 1)) / BLOCK).alias("size"), F.col("top").alias("node"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(key, root) of every tree."""
    return rounds[-1].where("pos = 0").select("key", F.col("top").alias("root"))


def with_paths(ws: Workspace, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round with all steps to the root; ``above`` (key, steps, …) is what follows the root of a key."""
    more = [c for c in above.columns if c not in ("key", "steps")]
    up, on = above.withColumnRenamed("steps", "_up"), ["key"]
    for k in range(len(rounds) - 1, -1, -1):
        joined = rounds[k].join(bounded(up, up.count(), PROOF_BYTES), on).withColumn("steps", F.concat("steps", "_up"))
        if k:
            up, on = ws.keep(joined.select("key", F.col("pos").alias("block"), F.col("steps").alias("_up"), *more)), ["key", "block"]
    return joined.drop("_up")


def manifest(df: DataFrame, group: str, order: Sequence[str], leaf: Column, carry: Sequence[Column] = ()) -> DataFrame:
    """leaf, subroot, root, steps and the ``carry`` columns of every row of ``df``."""
    ws = Workspace(df.sparkSession, "merkle")
    names = [f"c{i}" for i in range(len(carry))]
    keys = [f"o{i}" for i in range(len(order))]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    rows = df.select(key.alias("key"), *(F.col(o).alias(k) for o, k in zip(order, keys, strict=True)), leaf.alias("node"), *(c.alias(n) for c, n in zip(carry, names, strict=True)))
    rows = ws.keep(rows.withColumn("_row", F.monotonically_increasing_id()))  # texts are read and hashed once; equal rows are told apart
    trees = grown(ws, placed(ws, rows, [*keys, "node", "_row"]).drop("_row", *keys))
    if not trees:
        return rows.select(F.col("node").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("steps"), *names)
    subroots = roots(trees).select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("node"))
    whole = grown(ws, placed(ws, subroots, ["group"]))
    no_steps = F.array().cast("array<struct<l:string,r:string>>")
    above = with_paths(ws, whole, roots(whole).withColumn("steps", no_steps))
    above = ws.keep(above.select(F.col("group").alias("key"), "steps", F.col("node").alias("subroot"), "root"))
    return with_paths(ws, trees, above).select(F.col("node").alias("leaf"), "subroot", "root", "steps", *names)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, digest of the proof, the root folded from the tampered text, verified.

    Texts of documents with an even id checksum are tampered with: their line feeds go.
    """
    parts = {c: field(F.col(c)) for c in FIELDS}
    cut = field(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    changed = (fold_remainder(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    tampered = F.when(changed, digest(*(parts | {"text": cut}).values()))
    m = manifest(docs, "source", ["doc_id"], digest(*parts.values()), [F.col("doc_id"), tampered])
    out = m.select(F.col("c0").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                   folded(F.col("steps"), F.coalesce("c1", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
