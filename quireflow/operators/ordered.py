"""Ordered event streams: sequence numbers, completeness watermarks, bitmaps and reassembly.

An event row has job_id, seq, kind, page_idx (null for job events) and total_pages.
``page_watermark`` is the lowest page index not emitted yet; it has nothing to do with event time.
Everything here is linear in the number of events: no self-join within a job. ``route`` goes to
``scan``; ``sizes`` are (rows, rows of the largest job), measured once by whoever knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import shaping
from quireflow.operators import scan
from quireflow.session import written

JOB = ["job_id"]


def allocate_seq(commits: DataFrame, order: list[str], **route) -> DataFrame:
    """Gap-free ``seq`` per job in commit order."""
    return scan.numbered(commits, JOB, order, "seq", 1, **route)


def audit_arrivals(frames: DataFrame, arrival: str = "arrival", **route) -> DataFrame:
    """Frames in arrival order with what a reader would do: ``duplicate`` frames are ignored,
    a ``gap`` makes it reconnect."""
    seen = scan.running(frames, JOB, [arrival], {"_last": scan.Running("max", F.col("seq"), inclusive=False)}, **route)
    last = F.coalesce("_last", F.lit(0))
    return seen.withColumn("duplicate", F.col("seq") <= last).withColumn("gap", F.col("seq") > last + 1).drop("_last")


def flush_points(events: DataFrame, **route) -> DataFrame:
    """(job_id, page_idx, first_seq, flush_seq): when each page of the contiguous prefix can be
    emitted in document order. Pages behind a missing page have no flush point and are left out."""
    pages = events.filter(F.col("page_idx").isNotNull()).groupBy("job_id", "page_idx").agg(F.min("seq").alias("first_seq"))
    placed = scan.running(pages, JOB, ["page_idx"], {
        "_rn": scan.row_count(), "flush_seq": scan.Running("max", F.col("first_seq"))}, **route)
    return placed.filter(F.col("page_idx") == F.col("_rn") - 1).drop("_rn")


def _measured(events: DataFrame, route: dict) -> tuple[DataFrame, dict]:
    """Events and a route with sizes. Where nobody knows them, the events are written, as measuring reads them once more."""
    if route.get("sizes"):
        return events, route
    events = written(events)
    return events, {**route, "sizes": scan.group_stats(events, JOB)}


def with_watermark(events: DataFrame, **route) -> DataFrame:
    """Events with ``page_watermark`` after them and ``watermark_before``, in one pass: every order is a window over the job, so the
    events are hashed once. A page has its place among the first events of the job's pages; where none is missing before it, a
    row at its flush point raises the watermark."""
    events, route = _measured(events, route)
    placed = scan.running(events, ["job_id", "page_idx"], ["seq"], {"_times": scan.row_count()}, **route)
    first = F.col("page_idx").isNotNull() & (F.col("_times") == 1)
    ranked = scan.running(placed.withColumn("_rest", ~first), [*JOB], ["_rest", "page_idx", "seq"], {
        "_rn": scan.Running("sum", F.when(first, 1).otherwise(0).cast("long")), "_flush": scan.Running("max", F.when(first, F.col("seq")))}, **route)
    row = lambda at, flushed, event: F.struct(at.cast("long").alias("_at"), F.lit(flushed).cast("long").alias("_flushes"), F.lit(event).alias("_event"))
    flush = F.when(first & (F.col("page_idx") == F.col("_rn") - 1), row(F.col("_flush"), 1, False))
    rows = ranked.select(*events.columns, F.inline(F.filter(F.array(row(F.col("seq"), 0, True), flush), lambda r: r.isNotNull())))
    route = {**route, "sizes": tuple(2 * n for n in route["sizes"])}  # a flush point per event at most
    raised = scan.Running("sum", F.col("_flushes"))
    summed = scan.running(rows, JOB, ["_at", "_event", "page_idx"], {"page_watermark": raised}, **route)
    out = scan.running(summed, ["job_id", "_at"], ["_event", "page_idx"], {"_here": raised}, **route).filter("_event")
    return out.withColumn("watermark_before", F.col("page_watermark") - F.col("_here")).drop("_at", "_flushes", "_event", "_here")


def with_window_bits(events: DataFrame, **route) -> DataFrame:
    """Events (with ``page_watermark``) and ``window_bits``: bit i is set when page watermark + i
    has been emitted by then, for the 64 pages from the watermark.

    Pages are kept as 64-page words. Each word is a running OR over the events that set its bits;
    an event looks up the two words its window touches, by position in the same order."""
    events, route = _measured(events, route)
    size = F.lit(c.WINDOW_SIZE)
    base, number = F.col("page_watermark").cast("long"), lambda n: F.lit(n).cast("long")

    def row(word: Column, which: int, bit: Column) -> Column:  # which: -1 sets a bit, 0 and 1 look a word up
        return F.struct(word.cast("long").alias("_word"), F.lit(which).alias("_which"), bit.alias("_bit"))

    bit = F.call_function("shiftleft", number(1), F.pmod("page_idx", size).cast("int"))
    update = F.when(F.col("page_idx").isNotNull(), row(F.floor(F.col("page_idx") / size), -1, bit))
    lookups = [row(F.floor(base / size) + k, k, number(0)) for k in (0, 1)]
    rows = events.select("*", F.inline(F.filter(F.array(update, *lookups), lambda r: r.isNotNull())))
    route = {**route, "sizes": tuple(3 * n for n in route["sizes"])}  # two lookups per event and the updates
    words = scan.running(rows, ["job_id", "_word"], ["seq", "_which"], {"_bits": scan.Running("bit_or", F.col("_bit"))}, **route).filter("_which >= 0")
    pair = scan.running(words, ["job_id", "seq"], ["_which"], {"_low": scan.Running("max", F.when(F.col("_which") == 0, F.col("_bits")))}, **route).filter("_which = 1")
    shift = F.pmod(base, size).cast("int")
    low = F.call_function("shiftrightunsigned", F.col("_low"), shift)
    high = F.when(shift == 0, number(0)).otherwise(F.call_function("shiftleft", F.col("_bits"), F.lit(c.WINDOW_SIZE) - shift))
    return pair.select(*events.columns, low.bitwiseOR(high).alias("window_bits"))


def framed(events: DataFrame, jobs: DataFrame, emitted_at: Column, **route) -> DataFrame:
    """Events with their full ``header`` (jobs: job_id, client_id, request_id)."""
    full = with_window_bits(with_watermark(events, **route), **route)
    owner = jobs.select("job_id", "client_id", "request_id")
    return full.join(owner, "job_id").withColumn("header", shaping.frame_header(
        F.col("job_id"), F.col("client_id"), F.col("request_id"), F.col("seq"), F.col("page_idx"), F.col("total_pages"),
        F.col("page_watermark"), F.col("window_bits"), emitted_at))


def reassembly(frames: DataFrame, arrival: str = "arrival", **route) -> DataFrame:
    """What a reorder buffer sees per job: out-of-order arrivals, most pages buffered, pages
    emitted in order, duplicates, whether the job completed or failed.

    A repeated frame is a duplicate; a page counts when its first frame arrives."""
    audited = written(audit_arrivals(frames, arrival, **route))
    unique = audited.filter(~F.col("duplicate"))
    if route.get("sizes"):  # files are not hashed by anything
        unique = scan.together(unique, JOB, route["sizes"], route.get("max_group_rows", scan.MAX_GROUP_ROWS))
    marked = with_watermark(unique, **route)
    is_page = F.col("page_idx").isNotNull()
    counted = scan.running(marked, JOB, ["seq"], {
        "_received": scan.Running("sum", is_page.cast("long"))}, **route)
    waiting = F.when(is_page, F.col("_received") - F.col("watermark_before"))
    stats = counted.groupBy("job_id").agg(
        F.count_if(is_page).alias("pages"),
        F.count_if(is_page & (F.col("page_idx") != F.col("watermark_before"))).alias("out_of_order"),
        F.coalesce(F.max(waiting), F.lit(0)).alias("max_buffered"),
        F.max("page_watermark").alias("emitted"),
        F.bool_or(F.col("kind") == "job_complete").alias("complete"),
        F.bool_or(F.col("kind") == "job_failed").alias("failed"))
    repeats = audited.groupBy("job_id").agg(F.count_if("duplicate").alias("duplicates"))
    return stats.join(repeats, "job_id")
