"""Structured Streaming forms of the panel operators; each shares its logic with a batch one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.joins import enrich
from gridloom.session import materialise, scratch


def file_stream(spark: SparkSession, path: str, ts: str, out: str = "ts") -> DataFrame:
    """Parquet files as a stream with the schema of the stored table; event time as a UTC timestamp."""
    schema = spark.read.parquet(path).schema
    d = spark.readStream.schema(schema).parquet(path)
    return d.withColumn(out, F.col(ts).cast("timestamp"))


def run_to_table(df: DataFrame, name: str, mode: str = "append", flush: bool = True) -> DataFrame:
    """Drain what is available into a Parquet table with its own checkpoint and read it back.

    ``flush`` runs the empty batch after the last data, whose watermark closes windows and sessions.  An inner
    join gives nothing then; without it, rows past the watermark leave the state with the next data.
    """
    spark = df.sparkSession
    out, empty = scratch(spark, name), "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty, "true")
    spark.conf.set(empty, before if flush else "false")
    try:
        q = (df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(empty, before)
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, name: str, fn: Callable[[DataFrame, int], None]) -> None:
    q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", scratch(df.sparkSession, f"{name}-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ stateless shape, windowed state
def deduplicated(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One row per capture identity while its watermark is open."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def last_of_day(stream: DataFrame, keys: list[str], value: str, order: str, delay: str) -> DataFrame:
    """Last scan of each day once the day is closed."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), *keys)
    return g.agg(F.max_by(value, F.struct("ts", order)).alias(value), F.count("*").alias("scans")).select(
        F.to_date("window.start").alias("date"), *keys, value, "scans")


def windowed_mean(stream: DataFrame, keys: list[str], value: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """Tumbling (``slide`` None) or sliding means, sds and counts."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", delay).groupBy(w, *keys).agg(
        F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), *keys, "mean", "sd", "n")


def gap_episodes(stream: DataFrame, keys: list[str], value: str, gap: str, delay: str) -> DataFrame:
    """Session windows: an episode closes after a silence of ``gap``."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "mean")


# ------------------------------------------------------------------ corrections, state, alerts, joins
def apply_corrections(stream: DataFrame, base: DataFrame, keys: list[str], part: str, path: str, order: list[str]) -> DataFrame:
    """Late rows replace stored ones in a table partitioned by ``part``.

    The row with the greatest ``order`` (time, then a unique id) stays, whichever batch brings it
    and in whatever order; rows of ``base`` carry none and give way to any correction.

    A batch reads and rewrites only the partitions it touches.  The new partitions are written
    aside first and then swapped in, and a keyed upsert applied twice changes nothing, so a
    retried batch is harmless.
    """
    spark = stream.sparkSession
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    base = base.select("*", *[F.lit(None).cast(kinds[o]).alias(o) for o in order])
    base.write.mode("overwrite").partitionBy(part).parquet(path)
    cols, types = base.columns, base.schema
    latest = lambda d: d.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(cols)

    def step(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        new = materialise(latest(batch.select(cols)), "late")
        old = s.read.schema(types).parquet(path).join(new.select(part).distinct(), part, "left_semi")
        fresh = materialise(latest(old.select(cols).unionByName(new)), "fresh")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    run_batches(stream, "corrections", step)
    return spark.read.schema(types).parquet(path).select([c for c in cols if c not in order])


def running_stock(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and sum per key: a built-in streaming aggregate, combined before the shuffle.

    Every batch appends the keys it changed under its own id; the latest row per key is the stock.
    """
    g = stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("stock"))
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stock")
    q = (g.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state")
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).trigger(availableNow=True).start())
    q.awaitTermination()
    d = spark.read.schema(g.schema).parquet(out)
    return d.groupBy(key).agg(F.max("n").alias("n"), F.max_by("stock", "n").alias("stock"))


def staleness_alerts(stream: DataFrame, key: str, silence: str, delay: str) -> DataFrame:
    """An alert per key and silence: the session ends once the watermark has passed last event + ``silence``."""
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", silence), key).agg(F.max("ts").alias("last_seen"))
    return g.select(key, "last_seen", F.col("session_window.end").alias("alert_at"))


def enriched(stream: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Stream with a static dimension, broadcast when small."""
    return enrich(stream, static, on, "inner")


def matched(left: DataFrame, right: DataFrame, on: str, within_days: int, delay: str) -> DataFrame:
    """Stream-stream join on a key with event times at most ``within_days`` apart; both states expire."""
    a, b = left.withWatermark("l_ts", delay), right.withWatermark("r_ts", delay)
    cond = f"{on}_l = {on}_r and r_ts >= l_ts - interval {within_days} days and r_ts <= l_ts + interval {within_days} days"
    return a.join(b, F.expr(cond), "inner")
