"""Run, load and latency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.operators import ordered, scan, stats

PART_PAGES = c.MAX_PAGES  # pages per part of a list: a document within the page limit is one part


def run_summary(frames: DataFrame) -> DataFrame:
    """Per job: frames, pages by source, low-confidence pages and elapsed seconds."""
    page = F.col("page_idx").isNotNull()
    source = lambda s: F.count_if(page & (F.col("source") == s))
    return frames.groupBy("job_id").agg(
        F.count("*").alias("frames"), F.count_if(page).alias("pages"), source("vlm").alias("vlm"),
        source("layout_fallback").alias("layout_fallback"), source("none").alias("none"),
        F.count_if(page & F.col("low_confidence")).alias("low_confidence_pages"),
        (F.unix_micros(F.max("received_at")) - F.unix_micros(F.min("received_at"))).alias("elapsed_us"))


def page_lists(frames: DataFrame, **route) -> DataFrame:
    """Per job: page indexes in order of arrival and the low-confidence ones, in parts of bounded
    length (part 0 holds everything of a document within the page limit)."""
    pages = frames.filter("page_idx is not null")
    placed = scan.numbered(pages, ["job_id"], ["arrival"], "_rn", 0, **route)
    low = F.when(F.col("low_confidence"), F.col("page_idx"))
    parted = placed.withColumn("part", F.floor(F.col("_rn") / PART_PAGES))
    listed = F.array_sort(F.collect_list(F.struct("_rn", "page_idx")))
    return parted.groupBy("job_id", "part").agg(
        F.transform(listed, lambda r: r["page_idx"]).alias("arrival_order"),
        F.array_sort(F.collect_list(low)).alias("low_confidence_pages"))


def load_report(assembled: DataFrame, jobs: DataFrame, results: DataFrame, elapsed_s: float) -> DataFrame:
    """One row: pages delivered in order and per second, those of them that are fallbacks, out-of-order
    arrivals, whether every job's pages all came out in order. ``assembled`` is ``ordered.reassembly``;
    jobs has job_id, total_pages; results has job_id, page_idx, low_confidence, one row per page."""
    low = results.filter("low_confidence").join(assembled.select("job_id", F.col("emitted").alias("_out")), "job_id") \
        .filter(F.col("page_idx") < F.col("_out")).groupBy("job_id").agg(F.count("*").alias("_low"))
    joined = jobs.select("job_id", "total_pages").join(assembled, "job_id", "left").join(low, "job_id", "left")
    return joined.agg(
        F.count("*").alias("jobs"), F.coalesce(F.sum("emitted"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("_low"), F.lit(0)).alias("fallback_pages"),
        F.coalesce(F.sum("out_of_order"), F.lit(0)).alias("out_of_order_arrivals"),
        F.bool_and(F.coalesce(F.col("emitted") == F.col("total_pages"), F.lit(False))).alias("all_in_order")) \
        .withColumn("pages_per_s", F.round(F.col("pages") / F.lit(float(elapsed_s)), 2))


def latency_report(marks: DataFrame, **route) -> DataFrame:
    """min, median, p90, p95, p99 and max of each measure; ``marks`` has (measure, ms)."""
    wanted = {"min": 0.0, "med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
    return stats.quantiles(marks, ["measure"], "ms", wanted, **route)


def latency_marks(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(measure, ms) rows from page arrivals (job_id, received_at) and jobs (job_id, uploaded_ms,
    accepted_at, finished_at)."""
    arrived = pages.join(jobs.select("job_id", "accepted_at"), "job_id")
    since = lambda end, start: (F.unix_millis(end) - F.unix_millis(start)).cast("double")
    page_ms = since(F.col("received_at"), F.col("accepted_at"))
    each = arrived.select(F.lit("page").alias("measure"), page_ms.alias("ms"))
    first = arrived.groupBy("job_id").agg(F.min(page_ms).alias("ms")).select(F.lit("first_page").alias("measure"), "ms")
    job = jobs.filter("finished_at is not null").select(
        F.lit("job").alias("measure"), since(F.col("finished_at"), F.col("accepted_at")).alias("ms"))
    upload = jobs.select(F.lit("upload").alias("measure"), F.col("upload_ms").cast("double").alias("ms"))
    return each.unionByName(first).unionByName(job).unionByName(upload)


def throughput(pages: DataFrame, jobs: DataFrame, **route) -> DataFrame:
    """One row: busy window (first job accepted to last job finished), rates, when 95 % of the
    pages were done, and the tail after that."""
    done = pages.withColumn("_ms", F.unix_millis("received_at").cast("double"))
    marks = stats.quantiles(done, [], "_ms", {"_p95": 0.95}, **route)
    counted = pages.agg(F.count("*").alias("pages"))
    span = jobs.agg(F.unix_millis(F.min("accepted_at")).alias("_from"), F.unix_millis(F.max("finished_at")).alias("_to"),
                    F.count("finished_at").alias("jobs"))
    # Three single rows become one.
    rows = span.unionByName(counted, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    row = rows.agg(*[F.max(n).alias(n) for n in rows.columns])
    window, bulk = (F.col("_to") - F.col("_from")) / 1000, (F.col("_p95") - F.col("_from")) / 1000
    per = lambda n, s: F.when(s > 0, n / s).otherwise(0.0)
    return row.select(
        "jobs", "pages", window.alias("window_s"), per(F.col("pages"), window).alias("pages_per_s"),
        per(F.col("jobs"), window).alias("jobs_per_s"), bulk.alias("pages_95pct_s"),
        per(0.95 * F.col("pages"), bulk).alias("pages_per_s_first_95pct"), (window - bulk).alias("tail_s"))


def phase_report(samples: DataFrame) -> DataFrame:
    """Per phase of a load run (samples: phase, ts, rps, concurrency, p95, throttled, admission_rps):
    extremes, first and last rates, and the checks on them."""
    first = lambda v: F.min_by(v, F.struct("ts", "sample_no"))
    last = lambda v: F.max_by(v, F.struct("ts", "sample_no"))
    out = samples.groupBy("phase").agg(
        F.min("rps").alias("min_rps"), F.max("rps").alias("max_rps"), first("rps").alias("first_rps"), last("rps").alias("last_rps"),
        F.min("concurrency").alias("min_concurrency"), first("concurrency").alias("first_concurrency"),
        F.max("p95").alias("max_p95"), F.sum("throttled").alias("throttled"), F.min("admission_rps").alias("min_admission_rps"))
    return out.withColumns({
        "rps_rose": F.col("max_rps") > F.col("first_rps"), "saw_throttling": F.col("throttled") > 0,
        "rps_halved": F.col("min_rps") <= F.col("first_rps") / 2, "p95_rose": F.col("max_p95") > 6.0,
        "concurrency_cut": F.col("min_concurrency") < F.col("first_concurrency"),
        "rps_recovered": F.col("last_rps") > F.col("min_rps"), "admission_throttled": F.col("min_admission_rps") < 100})
