"""Exact dedup by two passes over the rows and a Bloom filter, in DataFrame functions only.

Pass one hashes every text (A-Z lower-cased, null as empty) and counts, in a blocked Bloom filter,
the bits that at least two texts set: a text hash picks a block of 2^15 bits and ``BITS_OF_A_TEXT``
positions in it.  Only these short bit numbers travel.  Pass two probes the filter where the rows
lie.  A row with a bit that no other text set is unique and passes straight through; only the
others, the possibly repeated ones, are grouped by the SHA-256 of the text, so a false positive
costs a shuffled row and never changes the result.  The filter grows with the table (16 bits a
row): below the broadcast bound it goes to every executor, beyond it rows meet it by block.

Edge cases: null and empty texts are equal.  The largest ``doc_id`` stays, a null one only in a
group without any other.  ``exact_groups`` marks every row that carries the id that stays;
``drop_exact_duplicates`` leaves exactly one row per text.  Extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, ascii_lower, bounded

BLOCK = 32768  # bits of one Bloom block, the size of Spark's bitmaps
BITS_OF_A_ROW = 16
BITS_OF_A_TEXT = 2


def _bits(blocks: int) -> tuple[Column, list[Column]]:
    """Block and positions of a text hash ``_h``."""
    places = [F.shiftrightunsigned("_h", 15 * k).bitwiseAND(F.lit(BLOCK - 1)).cast("int") for k in range(BITS_OF_A_TEXT)]
    return F.pmod(F.shiftrightunsigned("_h", 15 * BITS_OF_A_TEXT), F.lit(blocks)), places


def _is_set(bitmap: Column, place: Column) -> Column:
    """Whether the bit at ``place`` is set; the byte is read as hexadecimal digits."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def repeated_filter(ws: Workspace, texts: Column, df: DataFrame) -> tuple[DataFrame, int]:
    """(_block, _bitmap) of the bits that two or more rows set, and the number of blocks of the whole filter."""
    blocks = max(1, math.ceil(df.count() * BITS_OF_A_ROW / BLOCK))
    block, places = _bits(blocks)
    seen = df.select(F.xxhash64(texts).alias("_h")).select(block.alias("_block"), F.explode(F.array_distinct(F.array(*places))).alias("_place"))
    twice = seen.groupBy("_block", "_place").agg(F.count("*").alias("_n")).where("_n > 1")
    return ws.keep(twice.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_place")).alias("_bitmap"))), blocks


def probed(df: DataFrame, ws: Workspace) -> DataFrame:
    """``df`` with the SHA-256 ``_sha`` of the normalised text and whether it is ``_maybe`` repeated."""
    texts = ascii_lower(F.col("text"))
    bloom, blocks = repeated_filter(ws, texts, df)
    block, places = _bits(blocks)
    keyed = df.withColumn("_text", texts).withColumn("_h", F.xxhash64("_text")).withColumn("_sha", F.sha2("_text", 256)).drop("_text")
    met = keyed.withColumn("_block", block).join(bounded(bloom, blocks, BLOCK // 8), "_block", "left")
    hit = F.lit(True)
    for p in places:
        hit = hit & _is_set(F.col("_bitmap"), p)
    return met.withColumn("_maybe", F.col("_bitmap").isNotNull() & hit).drop("_bitmap", "_block", "_h")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(docs.sparkSession, "exact")
    rows = ws.keep(probed(docs.select("doc_id", "text"), ws).select("doc_id", F.col("_sha").alias("text_sha256"), "_maybe"))
    once = rows.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = rows.where("_maybe").drop("_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    both = once.unionByName(maybe.join(groups, "text_sha256"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; full ties are settled by the other columns."""
    ws = Workspace(docs.sparkSession, "exact")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(docs.columns)))}
    rows = plain.withColumn("text", F.col(at["text"])).withColumn("doc_id", F.col(at["doc_id"]))
    rows = probed(rows, ws)
    best = rows.where("_maybe").groupBy("_sha").agg(F.max_by(F.struct(*plain.columns), F.struct("doc_id", F.xxhash64(*plain.columns))).alias("_row"))
    return rows.where("not _maybe").select(*plain.columns).unionByName(best.select("_row.*")).toDF(*docs.columns)
