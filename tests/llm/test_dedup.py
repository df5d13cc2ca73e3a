"""Exact and near dedup: edge cases and brute force."""

import random

import pytest

from gridloom.llm.exact_dedup import drop_exact_duplicates, exact_groups
from gridloom.llm.near_dedup import connected, drop_near_duplicates, near_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, kept string, _h int, p1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{k}" for k in range(30_000))
    return [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, long), (6, long), (6, long), (7, "ÉCOLE"), (8, "école"), (None, "only null"), (None, "x y"), (10, "X Y")]


def test_exact_groups(spark, rows):
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(frame(spark, rows)).collect()}
    by = {}
    for i, r in got.items():
        by.setdefault(i[0], []).append(r)
    assert {by[i][0].keep_id for i in (1, 2, 9)} == {9} and by[1][0].group_size == 3 and not by[1][0].kept and by[9][0].kept
    assert by[3][0].keep_id == 4 and by[4][0].group_size == 2
    assert by[7][0].keep_id == 7 and by[8][0].keep_id == 8
    assert by[5][0].keep_id == 6 and by[6][0].group_size == 3
    assert {(r.keep_id, r.kept) for r in by[None]} == {(10, False), (None, True)}
    assert exact_groups(frame(spark, rows)).count() == len(rows)


def test_exact_drop(spark, rows):
    out = drop_exact_duplicates(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 4, 6, 7, 8, 9, 10]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_groups(none).count() == drop_exact_duplicates(none).count() == 0
    assert near_classes(none).count() == drop_near_duplicates(none).count() == 0


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  TWO"), (5, "one two three")]
    for base in range(6):  # stars and chains of copies with more and more changes
        words = [word() for _ in range(rnd.choice([20, 60, 150]))]
        for k in range(25):
            copy = list(words)
            for _ in range(rnd.randrange(0, 1 + len(words) // 12)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((100 * (base + 1) + k, " ".join(copy)))
            if k % 3 == 0:
                words = copy
    rows += [(1000, rows[20][1]), (50, rows[40][1].upper())]
    want = brute(rows)
    got = {r.doc_id: r for r in near_classes(frame(spark, rows)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = {r.doc_id for r in drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_repeated_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (7, "z y x w v u t")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_classes(frame(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (7, 7, True)]
    assert sorted((r.doc_id or 0) for r in drop_near_duplicates(frame(spark, rows)).collect()) == [0, 1, 7]


def test_near_null_and_shared_ids(spark):
    one, two, three = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z a c e g"
    rows = [(None, one), (None, one.upper()), (None, two), (None, three), (None, None), (None, "")]  # three texts and two empty ones without an id
    rows += [(5, "1 2 3 4 5 6 7 8"), (5, "1 2 3 4 5 6 7 8"), (5, "9 8 7 6 5 4 3"), (5, ""), (6, "1 2 3 4 5 6 7 8")]  # one id over two unrelated texts
    out = drop_near_duplicates(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()))
    assert got == sorted([(0, one), (0, two), (0, three), (0, ""), (0, ""), (5, "1 2 3 4 5 6 7 8"), (5, "9 8 7 6 5 4 3"), (5, "")])


def test_connected_chain(spark):
    from gridloom.llm.common import Workspace

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.root for r in connected(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}
