"""Readers of the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quireflow import contracts
from quireflow.functions import intake


def schema(name: str) -> StructType:
    return StructType.fromDDL(contracts.SCHEMAS[name])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(path)


def stream_table(spark: SparkSession, name: str, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema(name))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a table; columns it does not have are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def unique(df: DataFrame, name: str) -> DataFrame:
    """One row per key: files carry no constraints, so repeated rows are dropped on read."""
    return df.dropDuplicates(contracts.KEYS[name])


def split_documents(documents: DataFrame, lines_per_page: int = 20) -> DataFrame:
    """Page rows of documents (job_id, client_id, text): 0-based pages of ``lines_per_page`` lines
    with storage key and first status. Whole texts; documents without a page or with more than
    the page limit keep one row that says why they are refused."""
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    counted = documents.withColumn("_lines", lines).withColumn(
        "total_pages", F.ceil(F.size("_lines") / lines_per_page).cast("int"))
    reason = F.when(F.col("total_pages") < 1, "no_pages").when(F.col("total_pages") > contracts.MAX_PAGES, "too_many_pages")
    pages = F.transform(F.sequence(F.lit(0), F.col("total_pages") - 1), lambda i: F.struct(
        i.alias("page_idx"), F.array_join(F.slice("_lines", i * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("page_text")))
    judged = counted.withColumn("refused_reason", reason)
    kept = judged.withColumn("_p", F.when(F.col("refused_reason").isNull(), pages))
    exploded = kept.select("job_id", "client_id", "total_pages", "refused_reason", F.inline_outer("_p"))
    return exploded.withColumn("object_key", F.when(F.col("page_idx").isNotNull(), intake.page_key(F.col("job_id"), F.col("page_idx")))) \
        .withColumn("status", F.when(F.col("page_idx").isNotNull(), "PENDING").otherwise("REJECTED"))
