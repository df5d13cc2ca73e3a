"""Values embedded in pages and texts, extracted with regular expressions over a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions import scalar as S


def embedded_series(pages: DataFrame, key: str, html: str, name: str) -> DataFrame:
    """``name = {labels:[...], values:[...]}`` to rows; arrays cut to the shorter, bad dates dropped."""
    lab = F.regexp_extract(html, name + r"\s*=\s*\{\s*labels\s*:\s*(\[[^\]]*\])", 1)
    val = F.regexp_extract(html, name + r"\s*=\s*\{.*?values\s*:\s*(\[[^\]]*\])", 1)
    d = pages.select(key, F.from_json(lab, "array<string>").alias("l"), F.from_json(val, "array<double>").alias("v"))
    n = F.least(F.size("l"), F.size("v"))
    d = d.where(n > 0).withColumn("z", F.arrays_zip(F.slice("l", F.lit(1), n).alias("l"), F.slice("v", F.lit(1), n).alias("v")))
    e = d.select(key, F.explode("z").alias("z")).select(key, F.try_to_timestamp(F.col("z.l"), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
                                                        F.col("z.v").alias("value"))
    return e.where("date is not null")


def html_cells(pages: DataFrame, key: str, html: str, pattern: str, groups: int = 2) -> DataFrame:
    """All matches of a cell pattern per page, numbered; group i becomes column c_i."""
    cols = [F.regexp_extract_all(html, F.lit(pattern), i + 1).alias(f"c_{i}") for i in range(groups)]
    z = F.posexplode(F.arrays_zip(*[f"c_{i}" for i in range(groups)])).alias("pos", "z")
    return pages.select(key, *cols).select(key, z).select(
        key, F.col("pos").cast("long").alias("pos"), *[F.col(f"z.c_{i}").alias(f"c_{i}") for i in range(groups)])


def kv_blocks(texts: DataFrame, key: str, text: str, samples: str, min_samples: float) -> DataFrame:
    """Candidate blocks (split by blank-free lines) with the chosen one flagged.

    A block with at least ``min_samples`` wins by page order; without one the largest does.
    """
    lines = F.posexplode(F.split(text, "\n")).alias("pos", "block")
    d = texts.select(key, lines).where(F.length("block") > 0)
    d = d.withColumn("samples", F.regexp_count("block", F.lit(samples)).cast("long"))
    ok = F.col("samples") >= min_samples
    w = Window.partitionBy(key).orderBy(ok.desc(), F.when(ok, F.col("pos")), F.col("samples").desc(), F.col("pos"))
    return d.withColumn("chosen", F.row_number().over(w) == 1)


def kv_field(block: Column, key: str) -> Column:
    """Value of ``key:value`` wherever it stands in the line; NULL when absent or empty."""
    v = F.trim(F.regexp_extract(block, rf"(?i)\b{key}\s*:\s*([^,]*)", 1))
    return F.when(v != "", v)


def kv_row(block: Column) -> list[Column]:
    """Name, times, amount bounds and total of one ``Name, k:v, k:v`` row."""
    lo, hi = S.range_bounds(F.coalesce(kv_field(block, "amount"), F.lit("")))
    name = F.trim(F.regexp_replace(F.regexp_extract(block, r"^(.*?)[A-Za-z_]+\s*:", 1), r",\s*$", ""))
    return [name.alias("name"), S.first_number(kv_field(block, "times")).alias("times"), lo.alias("amount_lo"),
            hi.alias("amount_hi"), S.first_number(kv_field(block, "total")).alias("total")]


def census(pages: DataFrame, key: str, items: Column) -> DataFrame:
    """Array of (category, count) structs to one summed row per (key, category)."""
    e = pages.select(key, F.explode(items).alias("i"))
    return e.groupBy(key, F.col("i.category").alias("category")).agg(F.sum("i.n").alias("n"))
