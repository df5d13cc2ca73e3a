"""Whole history, hot dates, ordered corrections: what earlier versions cut, gathered or lost."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import session
from gridloom.operators import econometrics as E, evaluation as V, inference as I, joins as J, learning as L, scenarios as N, tables as K, windows as W
from gridloom.sources import files
from gridloom.streaming import jobs as T


def test_shared_folder_is_asked_for(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_grain_is_a_choice(spark):
    df = spark.createDataFrame([(1, f"2024-01-{d:02d}", 1) for d in range(1, 15)], "entity int, date string, n int").withColumn("date", F.to_date("date"))
    assert K.at_grain(df, "day", ["entity"], "date", ["n"]).count() == 14
    assert {str(r.date): r.n for r in K.at_grain(df, "week", ["entity"], "date", ["n"]).collect()} == {"2024-01-01": 1, "2024-01-08": 7, "2024-01-15": 6}
    with pytest.raises(ValueError):
        K.at_grain(df, "month", ["entity"], "date", ["n"])


def series(spark, xs):
    return spark.createDataFrame([(1, i, None if x is None else float(x)) for i, x in enumerate(xs)], "entity int, i int, x double").withColumn("date", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("i")))


def test_ewma_sees_the_whole_past(spark):
    rnd = random.Random(1)
    xs = [None if rnd.random() < 0.1 else rnd.gauss(0, 1) + (50 if i < 5 else 0) for i in range(400)]
    lam = 0.5 ** (1 / 3)
    got = W.ewma(series(spark, xs), "x", 3.0, "m", "s").orderBy("i").collect()
    for i in (2, 40, 63, 64, 200, 399):
        ws = [(lam ** (i - j), xs[j]) for j in range(i + 1) if xs[j] is not None]
        if len(ws) >= 3:
            assert abs(got[i].m - sum(w * x for w, x in ws) / sum(w for w, _ in ws)) < 1e-9


def test_sample_entropy_counts_every_pair(spark):
    rnd = random.Random(2)
    xs = [rnd.choice([0, 1, 2]) + rnd.random() / 5 for _ in range(1500)]
    z = (np.array(xs) - np.mean(xs)) / np.std(xs)
    w = np.lib.stride_tricks.sliding_window_view(z, 3)
    two = three = 0
    for k in range(len(w)):
        d = np.abs(w[k + 1 :] - w[k]) <= 0.2
        two += 2 * int(d[:, :2].all(axis=1).sum())
        three += 2 * int(d.all(axis=1).sum())
    got = E.sample_entropy(series(spark, xs), "x").first()
    assert (got.n, got.pairs_m, got.pairs_m1) == (1500, two, three) and abs(got.sampen + math.log(three / two)) < 1e-12


def test_residuals_are_not_cut(spark):
    got = N.residual_blocks(series(spark, [i % 7 for i in range(300)]), ["entity"], "x", "date", 1.0)
    assert got.first().n == 300
    assert N.residual_blocks(series(spark, [i % 7 for i in range(300)]), ["entity"], "x", "date", 1.0, since=F.col("i") >= 200).first().n == 100


def test_one_date_with_many_entities(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("entity"), F.lit("2024-01-01").cast("date").alias("date"), (F.col("id") % 1000).cast("double").alias("x"))
    for d in (W.cross_deviation(df, "x"), J.leave_one_out(df, ["date"], "x", "m"), J.peer_mean(df, ["date"], "x", "m")):
        assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()
    dev = W.cross_deviation(df, "x").agg(F.min("dev"), F.max("dev")).first()
    assert dev[0] == -499.5 and dev[1] == 499.5
    rank = W.cross_rank_pct(df, "x", ["date"], "p").agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert abs(rank[0] - 500.5 / 1e6) < 1e-12 and abs(rank[1] - (1 - 499.5 / 1e6)) < 1e-12 and rank[2] == 1_000_000
    ref = J.rank_in_reference(df, df, "date", "x", "r").agg(F.min("r"), F.max("r"), F.min("n_ref")).first()
    assert tuple(ref) == (0.001, 1.0, 1_000_000)


def test_groups_join_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert sorted(r.s for r in J.with_group(df, ["g"], s=F.sum("x")).collect()) == [4.0, 4.0, 5.0]


def test_absorb_says_when_it_does_not_converge(spark):
    from gridloom.operators.moments import absorb

    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randrange(9), rnd.randrange(9), rnd.random()) for _ in range(40)], "a int, b int, x double")
    with pytest.raises(RuntimeError):
        absorb(df, ["x"], ["a", "b"], tol=0.0, max_iter=2)


def test_corrections_in_any_order(spark, tmp_path):
    schema = "k int, part int, ts long, id long, value double"
    rows = [(1, 0, 10, 1, 1.0), (1, 0, 30, 2, 3.0), (1, 0, 20, 3, 2.0), (2, 0, 5, 5, 8.0), (2, 0, 5, 4, 7.0)]
    base = spark.createDataFrame([(1, 0, 0.0), (3, 0, 9.0)], "k int, part int, value double")
    src = str(tmp_path / "in")
    for i, r in enumerate(rows):  # one file a batch: the newest first, then older ones
        spark.createDataFrame([rows[(i + 1) % len(rows)]], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = T.apply_corrections(stream, base, ["k", "part"], "part", str(tmp_path / "out"), ["ts", "id"])
    assert sorted((r.k, r.value) for r in got.collect()) == [(1, 3.0), (2, 8.0), (3, 9.0)]


def test_shuffled_is_the_same_on_every_cluster(spark):
    df = spark.range(500).select("id", F.col("id").alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, L.shuffled(df, "x", ["id"]).select("id", "x").collect())))
        assert out[0] == out[1] and sorted(x for _, x in out[0]) == list(range(500)) and out[0] != [(i, i) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shadow_test_can_confirm(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random()) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, 3 * a + rnd.gauss(0, 0.1)) for i, a, b in rows], "id int, good double, noise double, y double")
    got = {r.feature: r for r in L.boruta(df, ["good", "noise"], "y", ["id"], rounds=6).collect()}
    assert got["good"].hits == 6 and got["good"].verdict == "confirmed" and abs(got["good"].p - (1 / 3) ** 6) < 1e-12
    assert got["noise"].verdict == "rejected"


def test_rejected_documents_are_counted(spark, tmp_path):
    for name, text in (("a", json.dumps({"entity": 1, "entries": [{"category": "x", "n": 2}]})), ("b", "{not json"), ("c", "")):
        d = tmp_path / "date=2024-01-01" / name
        d.mkdir(parents=True)
        (d / "doc.json").write_text(text)
    assert files.read_event_counts(spark, str(tmp_path)).count() == 1
    bad = files.rejected_event_counts(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and "/b/" in bad[0].file


def test_chi_square_tail(spark):
    # known points of the distribution
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251178, 3, 0.05), (16.918977604620448, 9, 0.05), (29.58829844507442, 10, 0.001), (0.0, 4, 1.0)]
    df = spark.createDataFrame([(x, k, p) for x, k, p in known], "x double, k int, p double")
    assert all(abs(r.q - r.p) < 1e-9 for r in I.chi2_tail(df, "x", "k", "q").collect())


def test_pit_summary(spark):
    df = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("p"))
    got = V.pit_summary(df, "p").first()
    assert got.n == 1000 and abs(got.mean_percentile - 0.5) < 1e-12 and got.middle_half == 0.5


def test_components_match_a_dense_solution(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 25)) * [[1.0]] + 0.3 * rng.normal(size=(40, 25))
    rows = [(e, int(d), float(x[d, e])) for e in range(25) for d in range(40) if (d * 7 + e) % 11]
    df = spark.createDataFrame(rows, "entity int, date int, x double")
    z = np.zeros((40, 25))
    for e in range(25):
        at = [d for d in range(40) if (d * 7 + e) % 11]
        z[at, e] = (x[at, e] - x[at, e].mean()) / x[at, e].std(ddof=1)
    w, q = np.linalg.eigh(z @ z.T)
    share, dated, load = E.panel_pca(df, "x", 3, tol=1e-13)
    assert np.allclose([r.share for r in share.orderBy("component").collect()], w[::-1][:3] / w.sum(), atol=1e-9)
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in dated.orderBy("date").collect()])
    want = q[:, ::-1][:, :3] * np.sqrt(w[::-1][:3])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)
    loads = np.array([[r.load1, r.load2, r.load3] for r in load.orderBy("entity").collect()])
    assert abs(np.sum((z - got @ loads.T) ** 2) - w[::-1][3:].sum()) < 1e-6 * w.sum()
    # training rows alone decide the loadings; later dates are scored with them
    first = E.panel_pca(df.where("date < 25"), "x", 2, tol=1e-13)[2].orderBy("entity").collect()
    held = E.panel_pca(df, "x", 2, train=F.col("date") < 25, tol=1e-13)
    assert np.allclose([abs(r.load1) for r in first], [abs(r.load1) for r in held[2].orderBy("entity").collect()], atol=1e-6) and held[1].count() == 40


def test_stream_join_runs_no_empty_batch(spark, tmp_path):
    """The inner join drains its input in one batch; the whole state is not walked again for nothing."""
    from pathlib import Path

    for side, days in (("l", (1, 40)), ("r", (2, 90))):
        d = spark.createDataFrame([(k, f"2024-01-01 00:00:0{k}", day) for k in (1, 2) for day in days], f"key_{side} int, ts string, day int")
        d.select(f"key_{side}", (F.to_timestamp("ts") + F.make_interval(days=F.col("day"))).alias(f"{side}_ts")).write.parquet(str(tmp_path / side))
    a, b = (T.file_stream(spark, str(tmp_path / s), f"{s}_ts", f"{s}_ts") for s in "lr")
    got = T.run_to_table(T.matched(a, b, "key", 45, "1 day").select("key_l", "l_ts", "r_ts"), "join", flush=False)
    assert sorted(r.key_l for r in got.collect()) == [1, 1, 2, 2]
    out = Path(got.inputFiles()[0].removeprefix("file:")).parent
    assert [p.name for p in Path(f"{out}-state/commits").iterdir() if not p.name.startswith(".")] == ["0"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
