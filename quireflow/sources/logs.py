"""JSON log lines and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.sources.tables import schema


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("logs")).json(path)


def document_trace(logs: DataFrame, request_id: str | None = None) -> DataFrame:
    """Log lines of one request in time order, or those of all requests as they come: sorting whole logs
    is for whoever needs it."""
    if request_id is None:
        return logs.filter("request_id is not null")
    return logs.filter(F.col("request_id") == request_id).orderBy("ts")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("metrics")).parquet(path)
