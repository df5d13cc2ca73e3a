"""Joins: size-checked enrichment, spines, ranges, as-of, horizon, peer and pair joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BROADCAST_BYTES = 8 * 1024 * 1024
BROADCAST_MEMORY = 32 * 1024 * 1024
SALT = 16


def plan_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(dim: DataFrame) -> bool:
    """Whether a dimension is small by the optimizer's estimate and, counted, as rows of a hash table.

    The estimate is of compressed files, which hold a million short rows in a few MB; the driver
    holds every row with its key, its pointers and a word or two per column.
    """
    return plan_bytes(dim) <= BROADCAST_BYTES and dim.count() * (40 + 16 * len(dim.columns)) <= BROADCAST_MEMORY


def enrich(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
           spread: str | None = None) -> DataFrame:
    """Attach a dimension to a row-grain table.

    A dimension that ``fits_broadcast`` is broadcast.  Beyond that both sides are shuffled on
    ``on`` plus a salt taken from ``spread`` (a column that varies within a hot key), with the
    dimension replicated once per salt, so a key holding a third of the rows is still split
    over ``SALT`` tasks.  The hint keeps the optimizer from broadcasting it by its own estimate.
    """
    on = list(on)
    if fits_broadcast(dim):
        return big.join(F.broadcast(dim), on, how)
    if spread is None or how not in ("inner", "left", "left_semi", "left_anti"):
        return big.join(dim.hint("merge"), on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def with_scalars(df: DataFrame, stats: DataFrame, name: str = "s") -> DataFrame:
    """Attach a one-row table as struct column ``name`` through a scalar subquery (no cross join)."""
    one = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias(name))
    return df.withColumn(name, one.scalar())


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, out: str,
           default: Column | None = None) -> DataFrame:
    """Dictionary lookup as a left join; ``default`` fills the misses."""
    m = mapping.select(F.col(key), F.col(value).alias(out))
    j = enrich(df, m, [key], "left", spread=None)
    return j if default is None else j.withColumn(out, F.coalesce(F.col(out), default))


def date_spine(df: DataFrame, entity: str, date: str, full: bool = False) -> DataFrame:
    """Regular daily grid per entity, over its own span or (``full``) the span of the table."""
    own = df.groupBy(entity).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    if full:
        own = with_scalars(own.select(entity), df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")), "b")
        own = own.select(entity, F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    return own.select(entity, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(date))


def event_window(dates: DataFrame, events: DataFrame, date: str, lo: int, hi: int,
                 out: str = "in_window") -> DataFrame:
    """Flag dates in [event + lo, event + hi].  The bounded offsets turn the range into an equi-join."""
    marks = events.select(
        F.explode(F.sequence(F.date_add(date, lo), F.date_add(date, hi), F.expr("interval 1 day"))).alias(date)
    ).distinct().withColumn(out, F.lit(True))
    return dates.join(marks, date, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def nearest_marks(dates: DataFrame, marks: DataFrame, date: str) -> DataFrame:
    """Previous and next mark per date by a union and two ordered fills (date-grain data only)."""
    tagged = (
        dates.select(F.col(date).alias("d"), F.lit(None).cast("date").alias("m"))
        .unionByName(marks.select(F.col(date).alias("d"), F.col(date).alias("m")))
        .groupBy("d").agg(F.max("m").alias("m"), F.lit(1).alias("g"))
    )
    g = Window.partitionBy("g")
    run = (Window.unboundedPreceding, 0)
    return tagged.select(
        F.col("d").alias(date),
        F.last("m", True).over(g.orderBy("d").rowsBetween(*run)).alias("prev_mark"),
        F.last("m", True).over(g.orderBy(F.col("d").desc()).rowsBetween(*run)).alias("next_mark"))


def signed_distance(dates: DataFrame, marks: DataFrame, date: str, out: str) -> DataFrame:
    """Days from the nearest mark: positive after it, negative before it; a tie takes the earlier."""
    near = nearest_marks(dates.select(date).distinct(), marks.select(date).distinct(), date)
    back = F.datediff(date, "prev_mark")
    fwd = F.datediff(date, "next_mark")
    d = (F.when(F.col("prev_mark").isNull(), fwd).when(F.col("next_mark").isNull(), back)
         .when(F.abs(back) <= F.abs(fwd), back).otherwise(fwd))
    return dates.join(near.select(date, d.cast("long").alias(out)), date, "left")


def asof_backward(df: DataFrame, marks: DataFrame, entity: str, date: str, mark: str,
                  out: str = "last_mark") -> DataFrame:
    """Latest mark at or before each row's date, within the entity."""
    rows = df.withColumn("_m", F.lit(None).cast("date")).withColumn("_r", F.lit(1))
    pts = marks.select(entity, F.col(mark).alias(date)).distinct().withColumn("_m", F.col(date)).withColumn("_r", F.lit(0))
    w = Window.partitionBy(entity).orderBy(date, "_r").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(pts, allowMissingColumns=True)
        .withColumn(out, F.last("_m", True).over(w))
        .where("_r = 1").drop("_m", "_r")
    )


def last_mark_any(df: DataFrame, marks: DataFrame, entity: str, mark: str,
                  out: str = "last_mark") -> DataFrame:
    """Latest mark of the entity even if it lies in the future of the row."""
    return df.join(marks.groupBy(entity).agg(F.max(mark).alias(out)), entity, "left")


def at_horizon(df: DataFrame, entity: str, date: str, value: str, h: int, out: str) -> DataFrame:
    """Value of the same entity exactly ``h`` calendar days ahead, NULL when that day is missing."""
    fut = df.select(F.col(entity), F.date_sub(date, h).alias(date), F.col(value).alias(out))
    return df.join(fut, [entity, date], "left")


def at_horizons(df: DataFrame, entity: str, date: str, value: str, hs: Sequence[int], out: str) -> DataFrame:
    """Long form of ``at_horizon``: one row per (row, horizon).

    A range frame on the day number reads the value exactly ``h`` days ahead, so all horizons come
    from one ordering of the series, whose rows are bounded by the calendar.
    """
    day = Window.partitionBy(entity).orderBy(F.unix_date(date))
    each = [F.struct(F.lit(h).alias("h"), F.max(value).over(day.rangeBetween(h, h)).alias(out)) for h in hs]
    d = df.withColumn("_at", F.array(*each))
    return d.select(*df.columns, F.explode("_at").alias("_at")).select(*df.columns, F.col("_at.h").alias("h"), F.col(f"_at.{out}").alias(out))


def with_group(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach aggregates of the row's group.

    The aggregate is combined before its shuffle and joined back, so a group (one date with all its
    entities) is never gathered in one task; Spark broadcasts or splits the join by its real size.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    stats = df.groupBy(*[F.col(k).alias(g) for k, g in zip(by, keys)]).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(by, keys)], "left").drop(*keys)


def leave_one_out(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the others in the group: (sum - x) / (n - 1)."""
    d = with_group(df, by, _n=F.count(value), _s=F.sum(value))
    return d.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("_n") > 1), (F.col("_s") - F.col(value)) / (F.col("_n") - 1))).drop("_n", "_s")


def peer_mean(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Row-normalised spatial lag: mean of the group's other members present, NULL when alone."""
    own = F.coalesce(F.col(value), F.lit(0.0))
    n = F.col("_n") - F.col(value).isNotNull().cast("int")
    d = with_group(df, by, _n=F.count(value), _s=F.sum(value))
    return d.withColumn(out, F.when(n > 0, (F.col("_s") - own) / n)).drop("_n", "_s")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: the test behind a many-to-one join."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails the job when the right side repeats a key."""
    ok = right.groupBy(*on).agg(
        F.count("*").alias("_copies"),
        *[F.first(c).alias(c) for c in right.columns if c not in on])
    ok = ok.withColumn("_copies", F.when(F.col("_copies") > 1, F.raise_error(F.lit("right side repeats a key"))).otherwise(1))
    return left.join(ok.where("_copies = 1").drop("_copies"), list(on), how)


def rank_in_reference(df: DataFrame, ref: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Share of the reference population on the same ``by`` whose value is <= the row's value."""
    from gridloom.operators.quantiles import running

    both = df.select(by, value, F.lit(0).alias("_ref")).unionByName(ref.select(by, value, F.lit(1).alias("_ref")))
    ranks = running(both, value, [by], ["_ref"]).select(F.col(by).alias("_by"), "v", "c__ref")
    n = ref.groupBy(F.col(by).alias("_d")).agg(F.count("*").alias("_n"))
    d = df.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & (F.col(value).cast("double") == F.col("v")), "left").join(n, F.col(by).eqNullSafe(F.col("_d")), "left")
    return d.withColumn(out, F.when(F.col("_n") > 0, F.coalesce("c__ref", F.lit(0)) / F.col("_n"))).withColumn("n_ref", F.coalesce("_n", F.lit(0)).cast("long")).drop("_by", "v", "c__ref", "_d", "_n")


def alive_on_date(spans: DataFrame, start: str, end: str, dates: DataFrame, date: str) -> DataFrame:
    """Number of spans covering each date: +1 at the start, -1 after the end, running sum."""
    steps = (
        spans.select(F.col(start).alias(date), F.lit(1).alias("step"))
        .unionByName(spans.select(F.date_add(end, 1).alias(date), F.lit(-1).alias("step")))
        .unionByName(dates.select(date).distinct().withColumn("step", F.lit(0)))
        .groupBy(date).agg(F.sum("step").alias("step"), F.lit(1).alias("g"))
    )
    run = steps.select(date, F.sum("step").over(Window.partitionBy("g").orderBy(date)).alias("expected"))
    return run.join(dates.select(date).distinct(), date, "left_semi")


def coverage_status(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected units with a label saying whether a destination exists."""
    have = actual.select(*on).distinct().withColumn("_h", F.lit(1))
    return expected.join(have, list(on), "left").withColumn(
        "status", F.when(F.col("_h").isNull(), "missing").otherwise("covered")).drop("_h")
