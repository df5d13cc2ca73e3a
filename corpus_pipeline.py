"""From raw documents to token ids: toxicity, exact dedup, near-dedup, source mix, byte-pair encoding.

Each stage works on everything its predecessor kept; its result is written as Parquet in the shared
folder and reread.  All stages but the last return rows of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe
from gridloom.llm.common import Workspace
from gridloom.llm.exact_dedup import drop_exact_duplicates
from gridloom.llm.mixing import apply_mix
from gridloom.llm.near_dedup import drop_near_duplicates
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; labels of one fold of five are not learnt from."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id."""
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it."""
    return apply_mix(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` without the text; n_tokens, token_ids, decoded_sha256 of the text that the ids give
    back, and ``restored``: whether that is the text itself (null as empty)."""
    return bpe.encode(docs, tokenizer_path(), round_trip=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe_codec", bpe_codec)]

#: SQL cannot express the classifier and the tokenizer; each stage is tested against brute force on what it gets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir))
    return docs
