"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them) and by slice of
a seeded order, so the driver sees patterns, never documents.  A flow network routes words from
patterns to source quotas.  Its costs are convex in repetition: the k-th reading of a pattern's
words costs k, so the flow first spreads over unread words and repeats as little and as evenly as it
can.  The flow says how often a pattern is read in whole and which part of it once more; that part
is taken from the documents in the seeded order.  Slices before the boundary are in, slices behind
it are out, and only the documents of the boundary slice are put in exact order, so no source is
ever sorted in one task.

Targets: sources in code-point order, null last, weigh 5, 2, 1 repeating and share 150 % of all
words; a target stops at twice its source's words and the excess is shared by weight among the
others until none is above.

Edge cases: null text has no words; a document without words follows its slice and adds none.
Null is a source of its own.  Repeated rows are documents of their own; equal hashes are ordered
by size, so sums never depend on task order.  Reruns agree.  Extra columns are carried along.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, bounded

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
#: Slices of the seeded order; 3 hexadecimal digits of the hash.
DIGITS = 3
#: Patterns that the driver plans at most; more raise an error.
MAX_PATTERNS = 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """Target words of each source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = [s for s in open_ if rate * w[s] > most * sizes[s]]
        if not over:
            return out | {s: rate * w[s] for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], most: int = MOST) -> list[dict[int, int]]:
    """Words routed from each pattern to each of its sources: most words first, then least repetition cost.

    Successive cheapest augmenting paths.  The k-th layer of a pattern costs k for every pattern and
    moving a flow between sources costs nothing, so the cheapest path ends in the lowest layer with
    room: layers are filled in turn, each to its maximum.
    """
    n, s = len(capacity), len(quota)
    used, need = [0] * n, list(quota)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    holders: list[list[int]] = [[] for _ in range(s)]
    for p, ms in enumerate(members):
        for m in ms:
            holders[m].append(p)
    for layer in range(1, most + 1):
        for m in range(s):
            while need[m] > 0:
                # from source m to the nearest pattern with room in this layer, over flows that can move
                came, queue, end = {("s", m): None}, deque([("s", m)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    for nxt in [("p", p) for p in holders[x]] if kind == "s" else [("s", t) for t, f in flow[x].items() if f]:
                        if nxt not in came:
                            came[nxt] = node
                            queue.append(nxt)
                            if nxt[0] == "p" and used[nxt[1]] < layer * capacity[nxt[1]]:
                                end = nxt
                                break
                if end is None:
                    break
                path, node = [], end
                while node is not None:
                    path.append(node[1])
                    node = came[node]
                # pattern with room, source, pattern, source, ..., source m: each pattern gives to the next source
                gives, takes = list(zip(path[::2], path[1::2], strict=True)), list(zip(path[2::2], path[1::2], strict=False))
                push = min([need[m], layer * capacity[end[1]] - used[end[1]], *(flow[p][t] for p, t in takes)])
                for p, t in gives:
                    flow[p][t] = flow[p].get(t, 0) + push
                for p, t in takes:
                    flow[p][t] -= push
                used[end[1]] += push
                need[m] -= push
    return [{t: f for t, f in row.items() if f} for row in flow]


def _key(pattern: Column) -> Column:
    """A pattern as one string, nulls told apart."""
    return F.concat(F.size(pattern), F.lit(":"), F.concat_ws("\x1f", F.transform(pattern, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("")))))


def mix(docs: DataFrame, sources: Column | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size and target (of its first source), copies (readings of the document) and taken (size * copies).

    ``sources`` is an array of the sources that hold the document; the default is the one in ``source``.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    pattern = F.array_sort(F.array_distinct(F.array(F.col("source")) if sources is None else sources))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    carried = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    base = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)), words(F.col("text")).alias("_size"), pattern.alias("_pattern"), order.alias("_order"))
    base = base.withColumns({"_slice": F.conv(F.substring("_order", 1, DIGITS), 16, 10).cast("int"), "_k": _key(F.col("_pattern"))})
    slices = ws.keep(base.groupBy("_k", "_pattern", "_slice").agg(F.sum("_size").alias("words")))
    rows = slices.groupBy("_k", "_pattern").agg(F.sum("words").alias("words")).orderBy("_k").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict[str | None, int] = {}
    for r in rows:
        for s in r["_pattern"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    goal = targets(sizes)
    number = {s: i for i, s in enumerate(goal)}
    quota = [int(g + Fraction(1, 10**6)) for g in goal.values()]
    flow = min_cost_flow([r["words"] for r in rows], [[number[s] for s in r["_pattern"]] for r in rows], quota)
    plan = []
    for r, f in zip(rows, flow, strict=True):
        whole, rest = divmod(sum(f.values()), r["words"]) if r["words"] else (0, 0)
        first = r["_pattern"][0] if r["_pattern"] else None
        plan.append((r["_k"], whole, rest, sizes.get(first, 0), round(float(goal.get(first, 0)), 6)))
    table = spark.createDataFrame(plan, "_k string, _whole long, _rest long, source_size long, target double")
    # the slice in which the running sum passes the part that is read once more
    upto = F.sum("words").over(Window.partitionBy("_k").orderBy("_slice"))
    edge = slices.withColumn("_upto", upto).join(table, "_k").where(F.col("_upto") > F.col("_rest"))
    edge = edge.groupBy("_k").agg(F.min(F.struct(F.col("_slice").alias("s"), (F.col("_upto") - F.col("words")).alias("b"))).alias("_e"))
    table = table.join(edge, "_k", "left").select(*table.columns, F.coalesce("_e.s", F.lit(16**DIGITS)).alias("_edge"), F.coalesce("_e.b", F.lit(0)).alias("_before"))

    keyed = base.join(bounded(ws.keep(table), len(plan), 200), "_k")
    inside = keyed.where(F.col("_slice") == F.col("_edge"))
    run = Window.partitionBy("_k").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_size").over(run), F.lit(0))
    inside = inside.withColumn("_again", start * 2 + F.col("_size") <= F.col("_rest") * 2)
    outside = keyed.where(F.col("_slice") != F.col("_edge")).withColumn("_again", F.col("_slice") < F.col("_edge"))
    both = outside.unionByName(inside).withColumn("copies", F.col("_whole") + F.col("_again").cast("int"))
    return both.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as the mix reads them: once for each reading, none for documents left out."""
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), "doc_id", "text", "source")
    rows = mix(plain, seed=seed).where("copies > 0").withColumn("_reading", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
