"""Runs and transitions of label sequences against a plain loop, and the mixture on planted states."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import states as ST


def plain(rows):
    """(run rows, transition counts) of (group, day, state) rows."""
    runs, pairs = [], Counter()
    groups = {}
    for g, day, s in rows:
        if day is not None and s is not None:
            groups.setdefault(g, []).append((day, s))
    for g, seq in groups.items():
        seq.sort()
        run, last = 0, None
        for day, s in seq:
            if s != last:
                run += 1
                runs.append([g, run, s, day, day, 0])
            if last is not None:
                pairs[g, last, s] += 1
            runs[-1][4], runs[-1][5], last = day, runs[-1][5] + 1, s
    return {tuple(x) for x in runs}, pairs


@pytest.mark.parametrize("step", [1, 9, 400])
def test_runs_and_transitions(spark, step):
    rng, day0 = random.Random(5), dt.date(1969, 12, 1)
    rows = [(g, day0 + dt.timedelta(days=k), rng.choice([0, 0, 0, 1, 2])) for g in ("a", "b", None) for k in range(120) if rng.random() < 0.7]
    rows += [("one", day0, 4), ("gaps", day0, 1), ("gaps", day0 + dt.timedelta(days=900), 1), ("a", None, 1), ("b", day0 + dt.timedelta(days=3), None)]
    rows += [("ties", day0, 1), ("ties", day0, 1), ("ties", day0, 2), ("ties", day0 + dt.timedelta(days=1), 2)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "g string, date date, state int, run string, prev_state int").repartition(5)
    ordered = ST.order_runs(df, ["g"], step=step)
    runs, pairs = plain(rows)
    assert {(r.g, r.run, r.state, r.starts, r.ends, r.days) for r in ST.state_runs(ordered, ["g"]).collect()} == runs
    got = ST.state_transitions(ordered, ["g"]).collect()
    assert {(r.g, r.from_state, r.to_state): r.n for r in got} == pairs
    total = Counter()
    for (g, a, _), n in pairs.items():
        total[g, a] += n
    assert all(abs(r.share - r.n / total[r.g, r.from_state]) < 1e-12 for r in got)


def test_profile(spark):
    day0, labels = dt.date(2001, 1, 1), [0, 0, 0, 1, 1, 0, 0, 2, 2, 2]
    rows = [(day0 + dt.timedelta(days=i), s, [1.0, -1.0, -2.0][s], [0.1, 0.5, 0.3][s]) for i, s in enumerate(labels)]
    d = ST.order_runs(spark.createDataFrame(rows, "date date, state int, ret double, vol double"))
    p = {r.state: r for r in ST.state_profile(d, ["ret", "vol"], "ret", "vol").collect()}
    assert [p[s].label for s in range(3)] == ["expansion, calm", "contraction, high volatility", "contraction, calm"]
    assert [(p[s].days, p[s].runs, p[s].longest_run) for s in range(3)] == [(5, 2, 3), (2, 1, 2), (3, 1, 3)]
    assert abs(p[0].persistence - 3 / 5) < 1e-12 and abs(p[0].expected_stay - 2.5) < 1e-12
    assert p[2].persistence == 1.0 and p[2].expected_stay is None


def test_no_rows(spark):
    d = ST.order_runs(spark.createDataFrame([], "date date, state int, ret double, vol double"))
    assert ST.state_runs(d).count() == 0 and ST.state_transitions(d).count() == 0 and ST.state_profile(d, ["ret", "vol"], "ret", "vol").count() == 0


def test_mixture_finds_planted_states(spark):
    """Two regimes far apart and a column without spread; a table without spread is one state."""
    rng, day0 = random.Random(1), dt.date(2000, 1, 1)
    truth = [(k // 60) % 2 for k in range(480)]
    rows = [(day0 + dt.timedelta(days=k), rng.gauss(4 * s, 0.5), rng.gauss(-3 * s, 0.5), 1.0) for k, s in enumerate(truth)]
    d = spark.createDataFrame(rows, "date date, a double, b double, c double")
    got = [r.state for r in ST.mixture_states(d, ["a", "b", "c"], (2,)).orderBy("date").collect()]
    assert sum(x == y for x, y in zip(got, truth)) in (0, 480)
    chosen = ST.mixture_states(d, ["a", "b", "c"]).groupBy("state").count().count()
    assert 2 <= chosen <= 4
    assert {r.state for r in ST.mixture_states(d.withColumn("a", F.lit(0.0)), ["a"]).collect()} == {0}


def test_retest_states(spark):
    from gridloom.operators import inference as I

    rows = [("ok", 0.4, 0.01, 0.2, 2.5, 5), ("weak", 0.4, 0.01, 0.2, 1.5, 5), ("turned", 0.4, 0.01, -0.2, -9.0, 5), ("short", 0.4, 0.01, 0.2, 9.0, 2), ("no_t", 0.4, 0.01, None, None, 5),
            ("nan_t", 0.4, 0.01, 0.2, float("nan"), 5), ("edge", 0.4, 0.05, 0.2, 9.0, 5), ("no_p", 0.4, None, 0.2, 9.0, 5), ("no_w", 0.4, 0.01, 0.2, 9.0, None), ("at_bar", 0.4, 0.01, 0.2, 2.0, 3)]
    d = I.retest_states(spark.createDataFrame(rows, "k string, coef double, p double, slope double, t double, windows int"), "coef", "p", "slope", "t", "windows")
    assert {r.k: r.state for r in d.collect()} == {"ok": "survives", "weak": "fades", "turned": "reversed", "short": "not estimable", "no_t": "not estimable", "nan_t": "not estimable",
                                                   "edge": "not selected", "no_p": "not selected", "no_w": "not estimable", "at_bar": "fades"}
    assert I.retest_summary(d).first().asDict() == {"cells": 10, "selected": 8, "estimable": 4, "reversed": 1, "survive": 1}


def test_series_is_computed_once(spark):
    """However often the fits read the series, what lies below it runs once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rng = random.Random(3)
    rows = [(dt.date(2001, 1, 1) + dt.timedelta(days=k), rng.gauss(6.0 * (k % 2), 1.0), rng.gauss(0.0, 1.0)) for k in range(60)]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    assert ST.mixture_states(df.mapInPandas(counted, df.schema), ["a", "b"], counts=(2,)).count() == 60
    assert seen.value == 60
