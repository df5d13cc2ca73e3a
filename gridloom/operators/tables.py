"""Incremental table maintenance on Parquet: keep-last append, upsert, anti-load, marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.aggs import last_row


def append_keep_last(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored plus new captures, NULL identities dropped, the later load winning per key."""
    u = stored.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return last_row(u.where(ok), keys, ["_load", *order]).drop("_load")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows with the same key; the rest of ``old`` is carried forward."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def not_loaded(source: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.join(loaded.select(*keys).distinct(), list(keys), "left_anti")


def merge_blocks(old: DataFrame, new: DataFrame, block: str = "block") -> DataFrame:
    """Metric table merge: a block present in ``new`` is replaced whole, others stay."""
    return upsert(old, new, [block])


def export_mart(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    d = df if where is None else df.where(where)
    return d.select(*columns)


def at_grain(df: DataFrame, grain: str, by: Sequence[str], date: str, sums: Sequence[str]) -> DataFrame:
    """Sums per key and ``grain``: ``day``, or ``week`` ending Monday."""
    if grain not in ("day", "week"):
        raise ValueError(grain)
    monday = F.date_add(F.date_trunc("week", F.date_sub(date, 1)).cast("date"), 7)
    return df.groupBy(*by, (monday if grain == "week" else F.col(date)).alias(date)).agg(*[F.sum(c).alias(c) for c in sums])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_text_table(df: DataFrame, path: str, fmt: str = "csv", gzip: bool = False) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if gzip:
        w = w.option("compression", "gzip")
    w.save(path)
