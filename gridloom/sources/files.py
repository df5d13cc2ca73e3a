"""File sources with declared schemas: nested JSON, CSV, TSV, gzip CSV, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SNAPSHOT = "status string, last_run_at double, snapshots array<array<struct<id: long, time: double, price: double, volume: double>>>"
BOOK = ("update_time double, sellers array<struct<name: string, amount: long, price: double, time: double>>, "
        "buyers array<struct<name: string, amount: long, price: double, time: double>>")
COUNTS = "entity long, entries array<struct<category: string, n: long>>"


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One document per entity with ``snapshots[[...]]``; entity from the folder ``entity=...``."""
    d = spark.read.schema(SNAPSHOT).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    d = d.withColumn("entity", F.regexp_extract(F.col("_metadata.file_path"), r"entity=([^/]+)/", 1).cast("int"))
    e = d.select("entity", "status", F.explode(F.flatten("snapshots")).alias("s"))
    return e.select("entity", "status", F.timestamp_seconds("s.time").alias("ts"),
                    F.when(F.col("s.price") != -1, F.col("s.price")).alias("price"),
                    F.when(F.col("s.volume") != -1, F.col("s.volume")).alias("volume"))


def read_order_books(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Book documents to long offers with a side label; entity from the folder name."""
    d = spark.read.schema(BOOK).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    d = d.withColumn("entity", F.regexp_extract(F.col("_metadata.file_path"), r"entity=([^/]+)/", 1).cast("int"))

    def side(c, label):
        return d.select("entity", "update_time", F.lit(label).alias("side"), F.explode(c).alias("o")).select(
            "entity", "update_time", "side", "o.name", "o.amount", "o.price", "o.time")

    return side("sellers", "sell").unionByName(side("buyers", "buy"))


def read_event_counts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Count documents in folders ``date=...``, entity inside the document; ``rejected_event_counts`` names those that give no rows."""
    d = (spark.read.schema(COUNTS).option("multiLine", multi_line).option("mode", "PERMISSIVE")
         .option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).json(path))
    day = F.regexp_extract(F.col("_metadata.file_path"), r"date=([^/]+)/", 1).try_cast("date")
    return d.select("entity", day.alias("date"), F.explode("entries").alias("e")).select("entity", "date", "e.category", "e.n")


def rejected_event_counts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, documents) of the count documents that do not parse, so that a load can state what it left out."""
    d = (spark.read.schema(f"{COUNTS}, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path))
    return d.where("_corrupt is not null and entity is null").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("documents"))


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


def read_tsv_headerless(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_csv_gz(spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """gzip is not splittable: repartition after the scan so that later work is spread."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d.repartition(partitions) if partitions else d


def read_parquet_cols(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def ingest_manifest(df: DataFrame, source, stamp: str, status: str) -> DataFrame:
    """Rows, last stamp and last status per source."""
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.max(stamp).alias("last_run"),
                                  F.max_by(status, stamp).alias("status"))


def null_share_profile(df: DataFrame, cols: Sequence[str], sentinel=None) -> DataFrame:
    """Share of missing values per column in one pass, long form."""
    def miss(c):
        m = F.col(c).isNull()
        return m if sentinel is None else (m | (F.col(c) == sentinel))

    a = df.agg(*[F.avg(miss(c).cast("double")).alias(c) for c in cols])
    return a.unpivot([], list(cols), "column_name", "null_share")
