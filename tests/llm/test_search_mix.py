"""Exact top-k and the source mix."""

import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import topk
from gridloom.llm.mixing import apply_mix, min_cost_flow, mix, targets

VEC = "vec_id long, embedding array<float>, label int, v int, score string"


def best(rows, k):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, u) in enumerate(ok):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(u, w, strict=True)), c) for m, (c, w) in enumerate(ok) if m != n and len(w) == len(u))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def test_topk_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.5, 0.25, 0.015625]) * rnd.random() for _ in range(6)]) for i in range(400)]
    rows += [(400 + k, list(rows[k][1])) for k in range(60)]  # ties
    rows += [(1001, None), (1002, []), (1020, [None] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] + [0.0] * 5), (1080, [1.0, 2.0]), (1081, [1.0, -2.0]), (None, rows[0][1]), (20, list(rows[20][1])), (40, [9.0] * 6), (41, [9.0] * 6), (41, [3.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VEC)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == best(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ball_tree_prunes_nothing_needed():
    rng = np.random.default_rng(0)
    x, q = np.floor(rng.normal(0, 20, (3000, 8))), np.floor(rng.normal(0, 20, (5, 8)))
    tree = topk.BallTree(x, 64)
    assert sorted(tree.order) == list(range(3000))
    up = tree.bounds(q)
    for (a, b), n in zip(tree.spans, range(len(tree.spans)), strict=True):
        assert ((q @ tree.x[a:b].T).max(axis=1) <= up[:, n]).all()


def test_targets_and_flow():
    t = targets({"a": 10, "b": 1000, "c": 1000, None: 500})
    assert t["a"] == 20 and sum(t.values()) == Fraction(3, 2) * 2510 and all(v <= 2 * s for v, s in zip((t["b"], t["c"], t[None]), (1000, 1000, 500), strict=True))
    # an overlapping pattern gives to whichever source needs it; repetition only when unread words are gone
    flow = min_cost_flow([100, 100, 50], [[0], [1], [0, 1]], [160, 90])
    assert sum(f.get(0, 0) for f in flow) == 160 and sum(f.get(1, 0) for f in flow) == 90
    assert sum(flow[2].values()) == 50 and sum(flow[0].values()) == 110
    assert min_cost_flow([10], [[0]], [50]) == [{0: 20}]
    assert min_cost_flow([0, 5], [[0], [0]], [3]) == [{}, {0: 3}]


DOC = "doc_id long, text string, source string, size string, target int, c0 int"


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40])), rnd.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(700, None, "a"), (701, "\xa0 x", "b"), (5, "w w", "a"), (5, "w w", "a"), (None, "w", "c"), (702, "long " * 5000, "d")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOC)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    goal = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(goal[r.source])) < 1e-5
    assert all(abs(taken[s] - float(goal[s])) <= 41 for s in ("a", "b", "c", None))
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    assert apply_mix(df).columns == df.columns and apply_mix(df).count() == sum(r.copies for r in got)
    assert mix(df.limit(0)).count() == apply_mix(df.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * 10, "a", ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "b"]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, held array<string>")
    got = mix(df, F.col("held")).collect()
    assert len(got) == 300 and abs(sum(r.taken for r in got) - 1.5 * 4000) <= 60
