"""Quality network, periodic runs and Merkle manifest: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, quality, runs
from gridloom.llm.common import Workspace

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, node string, n_runs int, quality_score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, n, "k", 1, "n", 2, 3) for i, t, s, n in rows], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 3 + 1):
        k, n = 0, len(words) - q
        while k < n:
            e = k
            while e < n and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(24, 3 * q):
                out.setdefault((k, e - k + q), q)
            k = e + 1
    return sorted((k, n, q) for (k, n), q in out.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), hashlib.sha256(left).hexdigest())


def test_find_runs_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randrange(1, 6)):
            words, n = [], rnd.randrange(0, 260)
            while len(words) < n:
                unit = [rnd.randrange(rnd.choice([1, 2, 3, 40])) for _ in range(rnd.randrange(1, 60))]
                words += (unit * rnd.randrange(1, 12))[: rnd.randrange(1, 300)]
                words += [99] * (rnd.random() < 0.5)
            docs.append(words)
        first = np.cumsum([0] + [len(d) for d in docs])
        got = runs.find_runs(np.array([x for d in docs for x in d], dtype=np.uint64), first)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d)]


def test_transform_counts_squared_differences():
    rng = np.random.default_rng(2)
    for size in (8, 32):
        p, w = rng.integers(0, 3, (50, size)).astype(np.uint64), rng.integers(0, 3, (50, 3 * size - 1)).astype(np.uint64)
        w[:, 5 : 5 + size] = p
        w[:25] += np.uint64(1 << 30)  # large numbers take more primes
        p[:25] += np.uint64(1 << 30)
        want = [[(p[r] == w[r, o : o + size]).all() for o in range(2 * size)] for r in range(50)]
        assert (runs.occurrences(p, w) == np.array(want)).all()


def test_long_texts():
    assert runs.find_runs(np.zeros(60_000, np.uint64), np.array([0, 60_000])).tolist() == [[0, 0, 60_000, 1]]
    unit = np.random.default_rng(1).integers(0, 900, 15_000).astype(np.uint64)
    assert runs.find_runs(np.tile(unit, 3), np.array([0, 45_000])).tolist() == [[0, 0, 45_000, 15_000]]


def test_runs_edge_cases(spark):
    rep = " ".join(["x y z"] * 20)
    rows = [(k, t, "s", 0) for k, t in enumerate([None, "", " \t\n", "a b", rep, "Start " + rep + " x end", rep.upper() + " " + rep, "w " * 23, "w " * 24, "é " * 30 + "f " * 30])]
    rows += [(4, rep, "s", 0), (None, rep, "s", 0), (None, None, "s", 0)]
    rows += [(100 + k, " ".join(f"w{(k * i * i) % 41}" for i in range(20 + 9 * k)), "s", 0) for k in range(30)]
    out = runs.collapse_runs(frame(spark, rows))
    assert out.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    assert runs.collapse_runs(frame(spark, [])).count() == 0


def test_runs_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 1500}
    got = {tuple(r) for r in runs.collapse_runs(docs).collect()}
    assert want <= got and len(got) == docs.count() and any(r[1] for r in want)


# --- Merkle manifest -----------------------------------------------------------------------------


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        steps, level = {m: [] for _, m in nodes}, [(h, [m]) for h, m in nodes]
        while len(level) > 1:
            above = []
            for i in range(0, len(level), 3):
                run = level[i : i + 3]
                for s, (_, members) in enumerate(run):
                    for m in members:
                        steps[m].append(("".join(x[0] for x in run[:s]), "".join(x[0] for x in run[s + 1 :])))
                above.append((sha(*(x[0] for x in run)), [m for x in run for m in x[1]]))
            level = above
        return level[0][0], steps

    groups = {}
    for k, (i, text, source, n) in enumerate(rows):
        groups.setdefault(source, []).append((i is not None, i or 0, sha(enc(i), enc(source), enc("en"), enc(n), enc(text)), k))
    subs, place = [], {}
    for s in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(groups[s])
        sub, steps = climb([(x[2], x[3]) for x in leaves])
        subs.append((sub, s))
        place |= {x[3]: (x[2], sub, s, steps[x[3]]) for x in leaves}
    root, top = climb(subs)
    out = []
    for k, (i, text, source, n) in enumerate(rows):
        leaf, sub, s, steps = place[k]
        steps = steps + top[s]
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        node = sha(enc(i), enc(source), enc("en"), enc(n), enc(cut))
        for a, b in steps:
            node = sha(a, node, b)
        out.append((i, leaf, sub, root, sha(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [merkle.LEVELS, 2])
def test_manifest_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "LEVELS", block)
    monkeypatch.setattr(merkle, "BLOCK", merkle.ARITY**block)
    rows = [(k, f"line {k}\nof text" if k % 3 else f"one line {k}", "hot", k % 7) for k in range(95)]
    rows += [(200 + k, "é\n\n" * k, s, None) for k, s in enumerate(["ä", "z", "", "B", "z", "z", "z"])]
    rows += [(None, None, None, None), (None, "x\ny", None, 1), (5, "x\ny", None, 1), (300, None, "hot", 2), (301, "", "lone", 0)]
    rows += [(7, "twice\n", "hot", 1), (7, "twice\n", "hot", 1), (7, "other\n", "hot", 1), (302, "w " * 100_000, "long", 0)]
    got = merkle.document_manifest(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)
    assert {r.verified for r in got.collect()} == {True, False}


def test_manifest_small_tables(spark):
    assert merkle.document_manifest(frame(spark, [])).count() == 0
    one = merkle.document_manifest(frame(spark, [(1, "a", "s", 1)])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("") and one.verified


def test_places_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("key"), (F.col("id") * 7919 % 5000).alias("o"))
    got = merkle.placed(Workspace(spark, "t"), rows, ["o"]).collect()
    for key in ("rare", "hot"):
        mine = sorted((r.o, r.pos, r.size) for r in got if r.key == key)
        assert [p for _, p, _ in mine] == list(range(len(mine))) and {n for _, _, n in mine} == {len(mine)}


# --- quality -------------------------------------------------------------------------------------


def test_gradient():
    texts = [b"some good words here, of a kind " * 9, b"BAD!! BAD!! BAD!! " * 20, "é".encode() * 40, b"", b"word " * 70]
    y, weight = np.array([1, 0, 1, 0, 0]), np.array([0.2, 0.3, 0.1, 0.2, 0.2])
    x, first = quality.halves(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    net = quality.Network.start()
    rng = np.random.default_rng(0)
    net.parts["v"] = rng.normal(0, 1, net.parts["v"].shape)

    def loss():
        z = net.forward(x, first, net.tables())
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    g, base = net.step(x, first, y, weight), loss()
    for k, p in net.parts.items():
        away = rng.normal(0, 1, p.shape) * 1e-3
        p += away
        up = loss()
        p -= 2 * away
        down = loss()
        p += away
        assert (up - down) / 2 == pytest.approx(float((g[k] * away).sum()), rel=0.05, abs=2e-5), k
    assert loss() == pytest.approx(base, abs=1e-5)


def test_whole_text_is_read():
    net = quality.Network.start()
    long = b"plain words go on and on here " * 3000
    texts = [long, long + b"#### #### #### ####", long[:-1]]
    x, first = quality.halves(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    a, b, c = net.forward(x, first, net.tables())
    alone = [net.forward(*quality.halves(np.frombuffer(t, np.uint8), np.array([0, len(t)])), net.tables())[0] for t in texts]
    assert a != b and [a, b, c] == pytest.approx(alone, abs=1e-5)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.held_out_scores(docs, labels)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and rows[r.doc_id].held_out]
    good, bad = [r for r, q in held if q == 1], [r for r, q in held if q == 0]
    auc = np.mean([(a.score > b.score) + (a.score == b.score) / 2 for a in good for b in bad])
    assert auc > 0.97 and np.mean([r.predicted for r in good]) > 0.95 and np.mean([r.predicted for r in bad]) < 0.25


def test_quality_edge_cases(spark):
    docs = frame(spark, [(1, None, "s", 0), (2, "", "s", 0), (None, "some text", "s", 0), (4, "w " * 100_000, "s", 0), (4, "some text", "s", 0)])
    kind = "doc_id long, quality int"
    none = quality.held_out_scores(docs, spark.createDataFrame([], kind)).collect()
    assert len(none) == 5 and {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    one = quality.held_out_scores(docs, spark.createDataFrame([(1, 1), (4, 1), (4, None), (None, 1)], kind)).collect()
    assert {r.score for r in one} == {1.0}
    model = quality.train([b"fine words", b"BAD!! " * 30], np.array([1, 0]), 0.5)
    out = quality.score(docs, model)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and out.count() == 5
    scores = {(r.doc_id, r.text is None): r.quality_score for r in out.collect()}
    assert scores[1, True] == scores[2, False]
    assert quality.score(frame(spark, []), model).count() == 0
