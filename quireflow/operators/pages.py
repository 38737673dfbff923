"""State of jobs, pages and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import intake, shaping
from quireflow.operators import scan, stats

PAGE = ["job_id", "page_idx"]

# The statuses of a page, in order.
PAGE_STATUSES = ("PENDING", "FAST_QUEUED", "FAST_PROCESSING", "FAST_COMPLETED", "SLOW_QUEUED", "SLOW_PROCESSING", "RETRY_WAIT", "COMPLETED", "FAILED")

# The status changes a page may make ("" is the page's creation).
TRANSITIONS = (
    ("", "PENDING"), ("PENDING", "FAST_QUEUED"), ("PENDING", "FAST_PROCESSING"), ("FAST_QUEUED", "FAST_PROCESSING"),
    ("FAST_PROCESSING", "FAST_PROCESSING"), ("FAST_PROCESSING", "FAST_COMPLETED"), ("FAST_PROCESSING", "RETRY_WAIT"),
    ("FAST_PROCESSING", "FAILED"), ("FAST_COMPLETED", "SLOW_QUEUED"), ("FAST_COMPLETED", "SLOW_PROCESSING"),
    ("SLOW_QUEUED", "SLOW_PROCESSING"), ("SLOW_PROCESSING", "SLOW_PROCESSING"), ("SLOW_PROCESSING", "RETRY_WAIT"),
    ("SLOW_PROCESSING", "COMPLETED"), ("SLOW_PROCESSING", "FAILED"), ("RETRY_WAIT", "FAST_QUEUED"),
    ("RETRY_WAIT", "SLOW_QUEUED"), ("RETRY_WAIT", "FAST_PROCESSING"), ("RETRY_WAIT", "SLOW_PROCESSING"),
)


# --- joins ------------------------------------------------------------------------------------

def apply_sent(pages: DataFrame, sent: DataFrame) -> DataFrame:
    """Pages after their messages (job_id, page_idx, queue, sent_at) went out: pages still
    waiting in that stage become queued, all others stay as they are."""
    once = sent.groupBy(*PAGE, F.col("queue").alias("stage")).agg(F.max("sent_at").alias("_sent_at"))
    moved = F.col("_sent_at").isNotNull() & F.col("status").isin(*c.SENDABLE_STATUSES)
    queued = F.when(F.col("stage") == "fast", "FAST_QUEUED").otherwise("SLOW_QUEUED")
    columns = {"status": F.when(moved, queued).otherwise(F.col("status")),
               "status_at": F.when(moved, F.col("_sent_at")).otherwise(F.col("status_at"))}
    return pages.join(once, [*PAGE, "stage"], "left").select(
        *[columns[n].alias(n) if n in columns else F.col(n) for n in pages.columns])


def final_results(pages: DataFrame, fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Final source of each page: the VLM result, else the layout result as a fallback, else
    none; with the kind of event that announces it. ``fast`` and ``slow`` have one row per page."""
    joined = pages.join(fast.select(*PAGE, F.col("result").alias("fast_result")), PAGE, "left") \
        .join(slow.select(*PAGE, F.col("result").alias("slow_result")), PAGE, "left")
    source = F.when(F.col("slow_result").isNotNull(), "vlm") \
        .when(F.col("fast_result").isNotNull(), "layout_fallback").otherwise("none")
    return joined.withColumn("source", source) \
        .withColumn("result", F.coalesce("slow_result", "fast_result")) \
        .withColumn("kind", intake.event_kind(F.col("source"), F.col("source") == "none")) \
        .withColumn("low_confidence", F.col("source") != "vlm").drop("fast_result", "slow_result")


def split_messages(messages: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages to work on, stale duplicates): a message counts while its page is in the
    message's stage and not finished."""
    live = pages.filter(intake.unfinished(F.col("status"))).select(*PAGE, "stage")
    return messages.join(live, [*PAGE, "stage"], "left_semi"), messages.join(live, [*PAGE, "stage"], "left_anti")


def missing_pages(jobs: DataFrame, received: DataFrame) -> DataFrame:
    """(job_id, page_idx) expected from ``total_pages`` but not received."""
    # Very long documents are cut into runs of pages first, so no single row explodes far.
    runs = jobs.filter("total_pages > 0").select(
        "job_id", "total_pages", F.explode(F.sequence(F.lit(0), F.col("total_pages") - 1, F.lit(10_000))).alias("_a"))
    expected = runs.select("job_id", F.explode(F.sequence(
        "_a", F.least(F.col("_a") + 9_999, F.col("total_pages") - 1))).alias("page_idx"))
    return expected.join(received.select(*PAGE), PAGE, "left_anti")


def with_request(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of a job with the job's request id. (AQE splits the partitions of a hot job.)"""
    return rows.join(jobs.select("job_id", "request_id"), "job_id", "left")


def visible_to(jobs: DataFrame, callers: DataFrame) -> DataFrame:
    """(caller, job) combinations in which the caller owns the job; callers has client_id, job_id."""
    return callers.join(jobs.select("job_id", "client_id"), ["job_id", "client_id"], "left_semi")


# --- aggregates ---------------------------------------------------------------------------------

def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("job_id", "status").agg(F.count("*").alias("n"))


def status_maps(pages: DataFrame) -> DataFrame:
    """One map status -> count per job (at most one entry per status)."""
    return status_counts(pages).groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("states"))


def unfinished_ages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Unfinished pages per status: how many, and seconds since the oldest got there."""
    return pages.filter(intake.unfinished(F.col("status"))).groupBy("status").agg(
        F.count("*").alias("n"), shaping.seconds_between(F.min("status_at"), as_of).alias("oldest_s"))


def send_backlog(outbox: DataFrame, as_of: Column) -> DataFrame:
    """Unsent rows and the age of the oldest (one row, zeros when nothing waits)."""
    waiting = F.when(F.col("sent_at").isNull(), F.col("created_at"))
    return outbox.agg(F.count(waiting).alias("unsent"), F.coalesce(
        shaping.seconds_between(F.min(waiting), as_of), F.lit(0.0)).alias("oldest_s"))


def send_lags(outbox: DataFrame, **route) -> DataFrame:
    """Distribution of seconds between creating and sending a message, per queue."""
    lags = outbox.filter("sent_at is not null") \
        .withColumn("lag_s", shaping.seconds_between(F.col("created_at"), F.col("sent_at")))
    return stats.quantiles(lags, ["queue"], "lag_s", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, **route)


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; no rows means exactly once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def loss_audit(pages: DataFrame) -> DataFrame:
    """Pages per final state and how many are unfinished (one row)."""
    status = F.col("status")
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status == "FAILED").alias("failed"), F.count_if(intake.unfinished(status)).alias("unfinished")) \
        .withColumn("all_finished", F.col("unfinished") == 0)


def completion(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs with finished pages, the pages in each status (``states``), whether they are complete, and whether
    only partly successful."""
    status = F.col("status")
    each = {name: F.count_if(status == name) for name in PAGE_STATUSES}  # one aggregation, no second shuffle for the map
    done = pages.groupBy("job_id").agg(
        F.count_if(~intake.unfinished(status)).alias("finished"), each["FAILED"].alias("failed_pages"), each["COMPLETED"].alias("completed_pages"),
        F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("status"), each[n].alias("n")) for n in sorted(PAGE_STATUSES)]), lambda e: e["n"] > 0)).alias("states"))
    counts = ["finished", "failed_pages", "completed_pages"]
    return jobs.select("job_id", "total_pages").join(done, "job_id", "left").fillna(0, counts) \
        .withColumn("complete", (F.col("finished") == F.col("total_pages")) & (F.col("total_pages") > 0)) \
        .withColumn("partial", F.col("complete") & (F.col("failed_pages") > 0))


# --- status history --------------------------------------------------------------------------------

def status_spans(log: DataFrame, **route) -> DataFrame:
    """Status log (job_id, page_idx, at, step, status) with the previous status, the seconds spent
    in it before the change, and whether the change is allowed."""
    spans = scan.neighbours(log, PAGE, ["at", "step"], 1, {
        "previous": lambda ordered, _: F.lag("status").over(ordered),
        "_since": lambda ordered, _: F.lag("at").over(ordered)}, **route)
    allowed = log.sparkSession.createDataFrame(list(TRANSITIONS), "_from string, status string").withColumn("_ok", F.lit(True))
    joined = spans.withColumn("_from", F.coalesce("previous", F.lit(""))).join(F.broadcast(allowed), ["_from", "status"], "left")
    return joined.withColumn("waited_s", shaping.seconds_between(F.col("_since"), F.col("at"))) \
        .withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_from", "_ok", "_since")


def queue_waits(spans: DataFrame, **route) -> DataFrame:
    """Seconds a page waited until a stage picked it up: distribution per stage."""
    picked = spans.filter(F.col("status").isin("FAST_PROCESSING", "SLOW_PROCESSING") & F.col("waited_s").isNotNull()) \
        .withColumn("stage", F.when(F.col("status") == "FAST_PROCESSING", "fast").otherwise("slow"))
    return stats.quantiles(picked, ["stage"], "waited_s", {"p50": 0.5, "p95": 0.95, "longest": 1.0}, **route)


def page_latencies(pages: DataFrame, **route) -> DataFrame:
    """Seconds from creating to completing a page: distribution per source."""
    done = pages.filter("completed_at is not null") \
        .withColumn("latency_s", shaping.seconds_between(F.col("created_at"), F.col("completed_at")))
    return stats.quantiles(done, ["source"], "latency_s", {"p50": 0.5, "p95": 0.95, "longest": 1.0}, **route)


def outcome_counts(steps: DataFrame) -> DataFrame:
    """Worked messages per stage and action (retries with their reason, give-ups, duplicates)."""
    return steps.groupBy("stage", "action").agg(F.count("*").alias("n"))


def late_stage_results(steps: DataFrame) -> DataFrame:
    """Stage results that came after their page had gone on, with the reason."""
    over = F.col("status").isin(*c.TERMINAL_STATUSES)
    return steps.filter("action = 'duplicate'").withColumn("reason", F.when(over, "page_finished").otherwise("stage_passed"))
