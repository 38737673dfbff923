"""Sinks: frame archive, page results, assembled documents and the message export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import intake
from quireflow.operators import pages as page_ops
from quireflow.operators import scan

PART_PAGES = c.MAX_PAGES


def archive_lines(frames: DataFrame) -> DataFrame:
    """Frames as JSON lines, every column a field (``received_at`` among them)."""
    return frames.select(F.to_json(F.struct(*frames.columns)).alias("value"))


def write_archive(frames: DataFrame, path: str) -> None:
    archive_lines(frames).write.mode("append").text(path)


def keyed_results(results: DataFrame) -> DataFrame:
    """Results (job_id, page_idx, name, result) with their storage key."""
    return results.withColumn("key", intake.result_key(F.col("job_id"), F.col("page_idx"), F.col("name")))


def write_results(results: DataFrame, path: str, partition: str = "day") -> None:
    """Results into partitions that are replaced as a whole: writing them again changes nothing."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def assembled_documents(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents in page order, in parts of at most ``PART_PAGES`` pages (one part for documents
    within the page limit): page list, missing pages of the job, and whether it is complete.

    ``results`` has job_id, page_idx and result; jobs has job_id, total_pages, status."""
    missing = page_ops.missing_pages(jobs, results).groupBy("job_id").agg(F.count("*").alias("missing_pages"))
    parts = results.withColumn("part", F.floor(F.col("page_idx") / PART_PAGES)).groupBy("job_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("page_idx", "result"))).alias("pages"))
    joined = jobs.select("job_id", "total_pages", "status").join(parts, "job_id", "left").join(missing, "job_id", "left")
    return joined.withColumn("missing_pages", F.coalesce("missing_pages", F.lit(0))).withColumn(
        "complete", (F.col("status") == "COMPLETE") & (F.col("missing_pages") == 0))


def send_batches(outbox: DataFrame, batch: int = c.SEND_BATCH, chunk: int = c.SEND_CHUNK, **route) -> DataFrame:
    """Unsent rows oldest first: batch number, and the chunk of their queue within the batch."""
    waiting = outbox.filter("sent_at is null").withColumn("_all", F.lit(0))
    placed = scan.numbered(waiting, ["_all"], ["id"], "_rn", 0, **route).withColumn("batch", F.floor(F.col("_rn") / batch))
    in_queue = scan.numbered(placed, ["batch", "queue"], ["id"], "_q", 0, **route)
    return in_queue.withColumn("chunk", F.floor(F.col("_q") / chunk)).drop("_all", "_rn", "_q")


def oldest_batch(outbox: DataFrame, batch: int = c.SEND_BATCH) -> DataFrame:
    """The next rows to send."""
    return outbox.filter("sent_at is null").orderBy("id").limit(batch)


def mark_sent(outbox: DataFrame, sent: DataFrame, at: Column) -> DataFrame:
    """Outbox with ``sent_at`` set on the rows whose id was sent."""
    marks = sent.select("id").dropDuplicates().withColumn("_s", F.lit(True))
    return outbox.join(marks, "id", "left").withColumn(
        "sent_at", F.when(F.col("_s") & F.col("sent_at").isNull(), at).otherwise(F.col("sent_at"))).drop("_s")
