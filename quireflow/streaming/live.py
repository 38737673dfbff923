"""Streaming queries: windows, replays, reassembly, duplicates, gauges and exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quireflow import contracts as c
from quireflow.functions import calls as fx
from quireflow.operators import calls as call_ops
from quireflow.operators import folds, scan, stats
from quireflow.operators.scan import Fold
from quireflow.session import ROCKSDB_PROVIDER, scratch_path
from quireflow.sources import stores
from quireflow.streaming.processors import REASSEMBLED, LimitsReplay, LiveWindows, OrderedReplay, Reassembly, SharedReplay, StatusCounts, UniqueFrames


def use_rocksdb(spark: SparkSession) -> None:
    """State too large for memory belongs into RocksDB, which the state processors require."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into files of the shared folder; read them back."""
    spark = stream.sparkSession
    path = scratch_path(spark, "streams")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


# --- windows ------------------------------------------------------------------------------------

def counted_calls(calls: DataFrame, seconds: int, exact: bool, ends: Column) -> DataFrame:
    """Calls of each Arrow batch summed per window and latency slot: far fewer rows than calls go into the shuffle. The row that ends a
    model's input keeps its place with a null window."""
    timed_out = F.col("timed_out")
    latency = F.when(~timed_out, F.col("latency_s"))
    one = lambda condition: F.when(condition, 1).otherwise(0).cast("bigint")
    rows = call_ops.with_outcome(calls.filter(ends | ~F.col("replay"))).select(
        "model", F.when(~ends, F.coalesce(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)), F.lit(LiveWindows.NO_TIME))).alias("win"),
        (latency if exact else stats.slot_value(stats.slot_of(latency))).cast("double").alias("slot"), one(~ends).alias("calls"),
        one(F.col("outcome") == "throttled").alias("throttled"), one(timed_out).alias("timeouts"),
        one(~timed_out & (F.col("status") >= 500)).alias("server_errors"), one(latency.isNotNull()).alias("latencies"), F.unix_micros("ts").alias("at_us"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["model", "win", "slot"]).aggregate([*[(n, "sum") for n in LiveWindows.COUNTS], ("at_us", "max")])
            sums = sums.rename_columns([n.removesuffix("_sum").removesuffix("_max") for n in sums.column_names])
            yield from sums.select(batch.schema.names).to_batches()

    return rows.mapInArrow(summed, LiveWindows.COUNTED)


def window_rows(calls: DataFrame, seconds: int = c.WINDOW_S, delay_s: int = 0, exact: bool = True, ends: Column | None = None) -> DataFrame:
    """Tumbling call windows of a stream, cache replays left out: ``window`` rows, each once, when the model's clock is ``delay_s`` past its end, and ``late``
    rows with the counts of calls whose window has gone. Calls in are calls of both kinds out and of windows still open.

    Latencies are counted per value with ``exact``, otherwise per slot (``stats.slot_of``), whose number is bounded: p95 then lies
    within half a per cent of the exact one. A row for which ``ends`` holds closes the windows of its model."""
    counted = counted_calls(calls, seconds, exact, F.lit(False) if ends is None else ends)
    return counted.groupBy("model").transformWithStateInPandas(
        LiveWindows(seconds * 1_000_000, delay_s * 1_000_000), LiveWindows.SCHEMA, "Append", "None")


def call_windows(calls: DataFrame, seconds: int = c.WINDOW_S, delay_s: int = 0, exact: bool = True, ends: Column | None = None) -> DataFrame:
    """The closed windows of ``window_rows``."""
    return window_rows(calls, seconds, delay_s, exact, ends).filter("what = 'window'").drop("what")


def judged(windows: DataFrame) -> DataFrame:
    """Closed windows with verdict and the model's constants."""
    known = call_ops.with_limits(windows)
    return known.withColumn("verdict", fx.verdict(
        F.col("calls"), F.col("throttled"), F.col("timeouts"), F.col("server_errors"),
        F.when(F.col("latencies") > 0, F.col("p95")), F.col("nominal_latency_s"), F.col("normal_error_rate")))


def limits(judged_windows: DataFrame) -> DataFrame:
    """Adaptive limits after each closed window."""
    schema = StructType.fromDDL("model string, win bigint, verdict string, " + folds.LIMITS.outputs)
    return judged_windows.groupBy("model").transformWithStateInPandas(LimitsReplay(schema), schema, "Append", "None")


# --- replays --------------------------------------------------------------------------------------

def replay(rows: DataFrame, keys: Sequence[str], at: Column, order: Sequence[str], keep: Sequence[str], fold: Fold,
           delay_s: float, ends: Column | None = None, shares: int | None = None) -> DataFrame:
    """A fold over a stream in event-time order (column ``at``, with which ``order`` must agree). Rows wait until their key's clock, the
    latest time it has seen, is ``delay_s`` ahead; every row comes out once, ``late`` and without outputs if its turn has passed. A
    row for which ``ends`` holds ends its key's input: all that waits is folded, and the row itself does not come out. Few keys have a
    state row each; very many are dealt to ``shares``."""
    key_fields = [rows.schema[k] for k in keys] + [rows.schema[k] for k in keep]
    schema = StructType(key_fields + StructType.fromDDL(fold.outputs + ", late boolean").fields)
    timed = rows.withColumns({"at_ms": F.unix_millis(at), "ends": F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)})
    if shares is None:
        return timed.groupBy(*keys).transformWithStateInPandas(
            OrderedReplay(fold, list(order), list(keep), schema, int(delay_s * 1000)), schema, "Append", "None")
    dealt = SharedReplay(list(keys), fold, list(order), list(keep), schema, int(delay_s * 1000))
    named = timed.select(F.pmod(F.xxhash64(*keys), F.lit(shares)).alias("share"), F.to_json(F.struct(*keys)).alias("key"), *dealt.columns)
    return named.groupBy("share").transformWithStateInPandas(dealt, schema, "Append", "None")


def breaker(calls: DataFrame, delay_s: float, fold: Fold | None = None, ends: Column | None = None) -> DataFrame:
    rows = call_ops.with_outcome(calls).withColumn("at_s", F.unix_micros("ts") / 1e6)
    fold = fold or folds.breaker_fold()
    fold = Fold(fold.inputs, fold.outputs, folds.counting_trips(fold.step))
    return replay(rows, ["model"], F.col("ts"), ["at_s", "call_id"], ["call_id"], fold, delay_s, ends)


def retry_grants(calls: DataFrame, delay_s: float, seconds: int = c.WINDOW_S, ends: Column | None = None) -> DataFrame:
    rows = calls.withColumn("win", call_ops.window_id(F.col("ts"), seconds)).withColumn("at_us", F.unix_micros("ts"))
    return replay(rows, ["model"], F.col("ts"), ["at_us", "call_id"], ["call_id"], folds.RETRIES, delay_s, ends)


def page_states(deliveries: DataFrame, delay_s: float, ends: Column | None = None, shares: int | None = None) -> DataFrame:
    """Deliveries (job_id, page_idx, at, step, ...) with the page's state afterwards. Pages are dealt to ``shares`` state rows (eight per
    shuffle partition), of which very many pages want more."""
    shares = shares or 8 * int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replay(deliveries, ["job_id", "page_idx"], F.col("at"), ["step"], ["step"], folds.PAGES, delay_s, ends, shares)


# --- reassembly ---------------------------------------------------------------------------------------

SEQ_BLOCK = 1024  # sequence numbers of a job that share a clock


def told_apart(frames: DataFrame, keep: Sequence[str] = (), delay_s: float = 3600, shares: int | None = None) -> DataFrame:
    """Every frame (job_id, seq, at) with ``what``: ``first``, ``repeat`` of a seq seen within ``delay_s``, or ``late``, older than that. Blocks of
    sequence numbers are dealt to ``shares`` state rows (eight per shuffle partition), so no job holds one up."""
    spark = frames.sparkSession
    shares = shares or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([StructField("job_id", frames.schema["job_id"].dataType), StructField("seq", LongType()), *[frames.schema[k] for k in keep], StructField("what", StringType())])
    rows = frames.withColumns({"at_ms": F.unix_millis("at"), "block": F.floor(F.col("seq") / SEQ_BLOCK)}).withColumn("share", F.pmod(F.xxhash64("job_id", "block"), F.lit(shares)))
    return rows.groupBy("share").transformWithStateInPandas(UniqueFrames(list(keep), schema, int(delay_s * 1000)), schema, "Append", "None")


def without_duplicates(frames: DataFrame, keep: Sequence[str] = (), delay_s: float = 3600) -> DataFrame:
    """Frames with repeats left out, also those too late to be told."""
    return told_apart(frames, keep, delay_s).filter("what = 'first'").drop("what")


def reassembled(frames: DataFrame, idle_s: int | None = None, keep_s: int | None = None, shares: int | None = None) -> DataFrame:
    """Frames (job_id, seq, page_idx, payload, total_pages; kind, if jobs may fail) as pages in document order, with one
    completion or failure per job and a ``late`` row for every frame that comes again or after a failure; with ``idle_s`` also a row whenever
    a job has been silent that long. With ``keep_s`` nothing is kept of a job so long after its end.

    Jobs are dealt to ``shares`` state rows (eight per shuffle partition). A batch reads the rows it has jobs in, so a store of very
    many jobs wants more of them."""
    spark = frames.sparkSession
    shares = shares or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.col("kind") if "kind" in frames.columns else F.lit(None).cast("string")
    # The job as a string: beside a null, pandas would make a number of it that cannot hold every id.
    rows = frames.select(F.pmod(F.xxhash64("job_id"), F.lit(shares)).alias("share"), F.col("job_id").cast("string").alias("job"), "seq", kind.alias("kind"),
                         F.col("page_idx").cast("bigint").alias("page_idx"), "payload", F.col("total_pages").cast("bigint").alias("total_pages"))
    # Timers keep a stream running even when nothing arrives, so they are only asked for when needed.
    timers = "None" if idle_s is None and keep_s is None else "ProcessingTime"
    return rows.groupBy("share").transformWithStateInPandas(Reassembly(idle_s, keep_s), REASSEMBLED, "Append", timers)


# --- exactly-once sinks and gauges ----------------------------------------------------------------------

def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], every: str | None = None):
    """A foreachBatch run over everything available, or every so often."""
    path = scratch_path(stream.sparkSession, "streams")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def appended_once(batch: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Rows of a batch whose keys the store at ``path`` does not hold yet, appended to it.

    What is there already stays as it is, so neither a repeated batch nor another split into batches changes
    anything. The store lies in ``parts`` folders by a hash of the keys; of it, just the folders that the batch touches are read."""
    spark = batch.sparkSession
    fresh = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).dropDuplicates(list(keys)).persist()
    new = fresh
    if _exists(spark, path):
        touched = F.broadcast(fresh.select("part").distinct())  # a row per folder at most; prunes the folders that are read
        there = spark.read.schema(fresh.schema).parquet(path).join(touched, "part", "left_semi").select(*keys)
        new = fresh.join(there, list(keys), "left_anti")
    new.select(fresh.columns).repartition("part").write.mode("append").partitionBy("part").parquet(path)
    fresh.unpersist()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


STORE_PARTS = 64  # folders of a store; for larger stores give more: a batch reads the folders it has keys in


def results_once(results: DataFrame, path: str, parts: int = STORE_PARTS):
    """Results (job_id, page_idx, ...) written once each, however they are split into batches."""
    return each_batch(results, lambda batch, _: appended_once(batch, path, ["job_id", "page_idx"], parts))


def send_once(outbox: DataFrame, path: str, parts: int = STORE_PARTS):
    """Unsent rows (id, ...) exported once each, however often a batch is repeated."""
    return each_batch(outbox, lambda batch, _: appended_once(batch.filter("sent_at is null"), path, ["id"], parts))


def numbered_sends(outbox: DataFrame, path: str):
    """Unsent rows (id, queue, ...), which come in the order of their ids, under ``path`` with ``batch`` and ``chunk`` as
    ``stores.send_batches`` numbers them: both go on where the last micro-batch stopped, however the stream is cut.

    What goes on are counters, a row per queue, written under ``path``_counters for each micro-batch and read by the next; a repeated
    micro-batch starts from the same ones and writes the same rows again."""

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(f"{path}_counters/{batch_id - 1}").collect() if batch_id else []  # a row per queue
        sent = sum(r.sent for r in before)
        going_on = sent // c.SEND_BATCH
        began = spark.createDataFrame([(going_on, r.queue, r.open) for r in before], "batch bigint, queue string, began bigint")
        unsent = rows.filter("sent_at is null").drop("sent_at").withColumn("_all", F.lit(0))
        placed = scan.numbered(unsent, ["_all"], ["id"], "_place", sent).withColumn("batch", F.floor(F.col("_place") / c.SEND_BATCH))
        in_batch = F.row_number().over(Window.partitionBy("batch", "queue").orderBy("id")) - 1  # no more rows than a batch has
        chunked = placed.join(F.broadcast(began), ["batch", "queue"], "left").withColumn("chunk", F.floor((in_batch + F.coalesce("began", F.lit(0))) / c.SEND_CHUNK))
        chunked.drop("began", "_place", "_all").write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")
        done = spark.read.schema(chunked.drop("began", "_place", "_all").schema).parquet(f"{path}/micro_batch={batch_id}")
        now = {r.queue: r for r in done.groupBy("queue").agg(F.count("*").alias("n"), F.max("batch").alias("last")).collect()}
        last = (sent + sum(r.n for r in now.values())) // c.SEND_BATCH
        fresh = {r.queue: r.n for r in done.filter(F.col("batch") == last).groupBy("queue").agg(F.count("*").alias("n")).collect()}
        old = {r.queue: r for r in before}
        counters = [(q, (old[q].sent if q in old else 0) + (now[q].n if q in now else 0), fresh.get(q, 0) + (old[q].open if q in old and last == going_on else 0)) for q in sorted({*old, *now})]
        spark.createDataFrame(counters, "queue string, sent bigint, open bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}_counters/{batch_id}")

    return each_batch(outbox, write)


def gauges(changes: DataFrame) -> DataFrame:
    """Things per status and since when the oldest of them, after every batch that changes a status: (status, turn, n, oldest_us); the row of the
    highest ``turn`` is the present one.

    ``changes`` are rows (status, status_at, was_status, was_at), the last two null for a new thing, as change logs with a before-image give
    them. Each counts +1 where the thing is and -1 where it was, so they may come in any order, and nothing is kept of a thing itself. Changes are summed
    per status and time before the shuffle."""
    both = F.array(F.struct(F.col("status"), F.unix_micros("status_at").alias("at_us"), F.lit(1).cast("bigint").alias("delta")),
                   F.struct(F.col("was_status").alias("status"), F.unix_micros("was_at").alias("at_us"), F.lit(-1).cast("bigint").alias("delta")))
    rows = changes.select(F.inline(both)).filter("status is not null").withColumn("at_us", F.coalesce("at_us", F.lit(0)))  # without a time: the oldest

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["status", "at_us"]).aggregate([("delta", "sum")]).rename_columns(["status", "at_us", "delta"])
            yield from sums.to_batches()

    return rows.mapInArrow(summed, "status string, at_us bigint, delta bigint").groupBy("status") \
        .transformWithStateInPandas(StatusCounts(), StatusCounts.SCHEMA, "Append", "None")
