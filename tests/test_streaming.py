"""Streams give what the batch operators give."""

from comparing import rows
from pyspark.sql import functions as F

from quireflow.operators import folds
from quireflow.plans import inputs
from quireflow.session import scratch_path
from quireflow.streaming import live

SF = "/root/testdata/sf0.001"


def streamed(df, parts=3, last=None):
    """``df`` as a stream of several files, read one per micro-batch, in scrambled order, and ``last`` behind them."""
    path = scratch_path(df.sparkSession, "test-stream")
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    live.use_rocksdb(df.sparkSession)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_breaker_and_budget(spark):
    calls = inputs.calls(spark, SF)
    fold = folds.breaker_fold(open_s=3600.0)
    names = ["model", "call_id", "permit", "breaker", "trips"]
    batch = rows(folds.replay_breaker(calls, fold=fold).select(names))
    ends = F.col("call_id").isNull()
    last = spark.createDataFrame([("layout",), ("vlm",)], "model string").select(*[F.col(c) if c == "model" else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns])
    whole = live.run_available(live.breaker(streamed(calls, 1, last), 0, fold, ends))
    assert rows(whole.select(names)) == batch and whole.filter("late").isEmpty()
    scattered = live.run_available(live.breaker(streamed(calls, 4, last), 40 * 86_400, fold, ends))  # waits for everything
    assert rows(scattered.select(names)) == batch
    grants = live.run_available(live.retry_grants(streamed(calls, 1, last), 0, inputs.WINDOW_S, ends))
    assert rows(grants.select("call_id", "granted")) == rows(folds.replay_retries(calls, inputs.WINDOW_S).select("call_id", "granted"))


def test_every_row_comes_out_in_its_turn_or_as_late(spark):
    base = spark.range(240).selectExpr("id % 2 k", "id", "timestamp_seconds(id * 60) at", "cast(id % 7 as int) v")
    from quireflow.operators.scan import Fold, replay

    fold = Fold(("v",), "total bigint", lambda s, v: ((s or 0) * 2 % 1009 + v, ((s or 0) * 2 % 1009 + v,)))
    # Five files, one per batch; rows come up to half an hour late.
    path = scratch_path(spark, "test-stream")
    scattered = base.withColumn("part", F.floor((F.col("id") + F.pmod(F.hash("id"), F.lit(30))) / 60))
    for part in range(5):
        scattered.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    ends = spark.range(2).selectExpr("id k", "cast(null as bigint) id", "cast(null as timestamp) at", "cast(null as int) v")
    ends.coalesce(1).write.mode("append").parquet(path)
    live.use_rocksdb(spark)
    source = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(path)
    batch = {r.id: r.total for r in replay(base, ["k"], ["id"], fold).collect()}
    patient = live.run_available(live.replay(source, ["k"], F.col("at"), ["id"], ["id"], fold, 3600, F.col("id").isNull())).collect()
    assert {r.id: r.total for r in patient} == batch and not any(r.late for r in patient)
    hasty = live.run_available(live.replay(source, ["k"], F.col("at"), ["id"], ["id"], fold, 60, F.col("id").isNull())).collect()
    assert sorted(r.id for r in hasty) == list(range(240)) and 0 < sum(r.late for r in hasty) < 100
    assert all((r.total is None) == r.late for r in hasty)
    unended = live.run_available(live.replay(source, ["k"], F.col("at"), ["id"], ["id"], fold, 3600)).filter("id is not null").collect()
    assert len(unended) < 240 and all(batch[r.id] == r.total for r in unended)  # what the clock has not passed stays open


def test_a_stopped_stream_goes_on_where_it_was(spark):
    """The checkpoint is the cursor: stopped after some batches and started again, every event comes once."""
    events = spark.range(60).selectExpr("id job_id", "id % 5 seq", "'k' kind", "timestamp_seconds(id) at")
    path, out = scratch_path(spark, "cursor-in"), scratch_path(spark, "cursor-out")
    for part in range(3):
        events.filter(f"job_id % 6 = {part}").coalesce(1).write.mode("append").parquet(path)

    def run():
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        live.without_duplicates(source, ["kind"]).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cursor") \
            .trigger(availableNow=True).start().awaitTermination()
        return sorted(r.job_id for r in spark.read.parquet(f"{out}/rows").collect())

    live.use_rocksdb(spark)
    assert run() == [i for i in range(60) if i % 6 < 3]
    for part in range(3, 6):
        events.filter(f"job_id % 6 = {part}").coalesce(1).write.mode("append").parquet(path)
    assert run() == list(range(60)) and run() == list(range(60))


def test_page_states(spark):
    deliveries = inputs.deliveries(spark, SF)
    names = ["job_id", "page_idx", "step", "action", "status", "fast_attempts", "slow_attempts", "source"]
    stream = live.run_available(live.page_states(streamed(deliveries.withColumnRenamed("ts", "at"), 1), 0)).filter("not late")
    batch = set(map(tuple, folds.replay_pages(deliveries, ["step"]).select(names).collect()))
    got = set(map(tuple, stream.select(names).collect()))
    assert got and got <= batch


def test_reassembly_of_scattered_frames(spark):
    frames = inputs.frames(spark, SF).filter("job_id < 80").select("job_id", "seq", "page_idx", F.col("kind").alias("payload"), "total_pages").cache()
    got = live.run_available(live.reassembled(streamed(frames, 5))).collect()
    state, expected = {}, []
    for f in frames.dropDuplicates(["job_id", "seq"]).orderBy("job_id", "seq").collect():
        state[f.job_id], (ready, finished) = folds.assembly_step(state.get(f.job_id), f.seq, f.page_idx, f.payload, f.total_pages)
        expected += [(f.job_id, "page", k, p) for k, p in ready] + ([(f.job_id, "complete", None, None)] if finished else [])
    seen = frames.groupBy("job_id", "seq", "page_idx", "payload").count().filter("count > 1").collect()
    expected += [(f.job_id, "late", f.page_idx, f.payload) for f in seen for _ in range(f["count"] - 1)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def started(stream, every="1 second"):
    path = scratch_path(stream.sparkSession, "idle")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(processingTime=every).start()
    return query, f"{path}/out"


def found(spark, path, what):
    from quireflow.streaming.processors import REASSEMBLED

    try:
        return sorted(r.job_id for r in spark.read.schema(REASSEMBLED).parquet(path).filter(F.col("what") == what).select("job_id").distinct().collect())
    except Exception:  # noqa: BLE001 - nothing written yet
        return []


def test_idle_jobs_are_reported_and_ended_ones_forgotten(spark):
    frames = spark.createDataFrame([(1, 1, "page_result", 0, "a", 2), (2, 1, "page_result", 0, "a", 1), (3, 1, "page_result", 0, "a", 9), (3, 2, "job_failed", None, None, 9)],
                                   "job_id long, seq long, kind string, page_idx int, payload string, total_pages int")
    query, path = started(live.reassembled(streamed(frames, 1), idle_s=1, keep_s=1))
    try:
        for _ in range(60):
            query.awaitTermination(1)
            state = query.lastProgress and query.lastProgress.stateOperators
            if found(spark, path, "idle") and state and state[0].numRowsTotal <= 2:
                break
    finally:
        query.stop()
    # job 1 goes on; of jobs 2 and 3 nothing is left, and no timer of theirs has fired again
    assert found(spark, path, "idle") == [1] and found(spark, path, "complete") == [2] and found(spark, path, "failed") == [3]
    assert state[0].numRowsTotal <= 2


def test_a_failed_job_shows_nothing_more(spark):
    frames = spark.createDataFrame([(1, 1, "page_result", 0, "a", 3), (1, 3, "job_failed", None, "why", 3), (1, 2, "page_result", 1, "b", 3), (1, 4, "page_result", 2, "c", 3)],
                                   "job_id long, seq long, kind string, page_idx int, payload string, total_pages int")
    for parts in (1, 4):
        out = sorted(((r.what, r.page_idx, r.payload) for r in live.run_available(live.reassembled(streamed(frames, parts))).collect()), key=str)
        assert out == sorted([("page", 0, "a"), ("page", 1, "b"), ("failed", None, "why"), ("late", 2, "c")], key=str)


def test_jobs_share_state_rows(spark):
    """Few state rows for many jobs, among them one without an id, one whose id is no double, and two that hold more than a row carries."""
    many, large = 700, (1 << 60) + 1
    frame = lambda job, seq, total, kind="page_result": (job, seq, kind, seq - 1, f"{job}/{seq}", total)
    rows = [frame(job, seq, 3) for job in [*range(300), None, large] for seq in (1, 2, 3)]
    rows += [frame(job, seq, many) for job in (1000, 1001) for seq in range(2, many + 1)]
    rows += [frame(1000, 1, many), (1001, 1, "job_failed", None, "why", many), frame(7, 2, 3)]
    frames = spark.createDataFrame(rows, "job_id long, seq long, kind string, page_idx int, payload string, total_pages int")
    first = frames.filter("seq > 1 or job_id < 1000")  # what the two large jobs wait for comes at last
    stream = live.reassembled(streamed(first, 4, frames.filter("seq = 1 and job_id >= 1000 or seq = 1 and job_id is null").select(frames.columns)), shares=4)
    path = scratch_path(spark, "shares")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4
    got = sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{path}/out").collect()), key=str)
    want = [(job, "page", k, f"{job}/{k + 1}") for job, n in [*((j, 3) for j in [*range(300), None, large]), (1000, many)] for k in range(n)]
    want += [(job, "complete", None, None) for job in [*range(300), None, large, 1000]] + [(7, "late", 1, "7/2"), (1001, "failed", None, "why")]
    want += [(1001, "late", seq - 1, f"1001/{seq}") for seq in range(2, many + 1)]
    assert got == sorted(want, key=str)


def test_windows_and_limits(spark):
    from quireflow.operators import calls as ops

    calls = inputs.calls(spark, SF)
    ends = F.col("call_id").isNull()
    last = spark.createDataFrame([("layout",), ("vlm",)], "model string").select(*[F.col(c) if c == "model" else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns])
    stream = live.run_available(live.limits(live.judged(live.call_windows(streamed(calls, 1, last), inputs.WINDOW_S, ends=ends))))
    judged = ops.judged(ops.with_idle_windows(ops.call_windows(calls, inputs.WINDOW_S))).select("model", "win", "verdict")
    names = ["model", "win", "verdict", "rps", "concurrency", "overload_streak", "healthy_streak"]
    assert rows(stream.select(names)) == rows(folds.replay_limits(judged).select(names))


def test_no_call_is_lost_and_sketches_are_near(spark):
    calls = inputs.calls(spark, SF)
    for parts in (1, 6):
        out = live.run_available(live.window_rows(streamed(calls, parts), inputs.WINDOW_S, 30 * 86_400, exact=False))
        assert out.isEmpty()  # nothing closes while the clock has not passed
    ends = F.col("call_id").isNull()
    last = spark.createDataFrame([("layout",), ("vlm",)], "model string").select(*[F.col(c) if c == "model" else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns])
    hasty = live.run_available(live.window_rows(streamed(calls, 6, last), inputs.WINDOW_S, 0, ends=ends))
    counts = {r.what: r.n for r in hasty.groupBy("what").agg(F.sum("calls").alias("n")).collect()}
    assert counts["late"] > 0 and sum(counts.values()) == calls.filter(~F.col("replay")).count()
    exact, near = ({(r.model, r.win): r.p95 for r in live.run_available(live.call_windows(streamed(calls, 3, last), inputs.WINDOW_S, 40 * 86_400, e, ends)).collect()} for e in (True, False))
    assert exact.keys() == near.keys() and all(abs(near[k] - v) <= 0.005 * v + 1e-12 for k, v in exact.items())


def test_a_repeated_run_changes_nothing(spark):
    results = spark.range(50).selectExpr("id job_id", "cast(id % 5 as int) page_idx", "'vlm' source")
    path = scratch_path(spark, "once")
    for parts in (5, 5, 2):
        live.results_once(streamed(results, parts), path).awaitTermination()
    assert spark.read.parquet(path).count() == 50


def test_sends_and_gauges_over_several_batches(spark):
    outbox = spark.range(30).selectExpr("id", "'fast' queue", "if(id < 10, timestamp_seconds(id), null) sent_at")
    path = scratch_path(spark, "sent")
    for parts in (6, 3):  # the first batch may have nothing to send
        live.send_once(streamed(outbox, parts), path).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10, 30))
    changes = spark.range(70).selectExpr("if(id >= 63, 'FAST_QUEUED', 'PENDING') status", "timestamp_seconds(id) status_at", "if(id >= 7, 'PENDING', null) was_status", "if(id >= 7, timestamp_seconds(id - 7), null) was_at")
    for parts in (1, 4):
        turns = live.run_available(live.gauges(streamed(changes, parts))).collect()
        now = {s: max((r.turn, r.n, r.oldest_us) for r in turns if r.status == s)[1:] for s in ("PENDING", "FAST_QUEUED")}
        assert now == {"PENDING": (0, None), "FAST_QUEUED": (7, 63_000_000)}


def test_send_numbers_go_on_however_the_stream_is_cut(spark):
    from quireflow.sources import stores

    outbox = spark.range(730).selectExpr("id", "concat('q', id * id % 3) queue", "if(id % 11 = 0, timestamp_seconds(id), null) sent_at")
    want = rows(stores.send_batches(outbox).select("id", "queue", "batch", "chunk"))
    for cuts in ([730], [95, 100, 101, 350, 730], [1, 2, 400, 700, 730]):
        path, source = scratch_path(spark, "sends"), scratch_path(spark, "sends-in")
        for a, b in zip([0, *cuts], cuts, strict=False):
            outbox.filter(f"id >= {a} and id < {b}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(outbox.schema).option("maxFilesPerTrigger", 1).parquet(source)
        live.numbered_sends(stream, path).awaitTermination()
        assert rows(spark.read.parquet(path).select("id", "queue", "batch", "chunk")) == want


def test_an_input_in_time_is_derived_once(spark):
    from quireflow.plans import live_plans

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(50).mapInPandas(counted, "id long")
    stream = live_plans._in_time(rows, F.col("id"), "once")
    assert stream.columns == ["id"] and seen.value == 50


def test_files_of_a_written_input_grow_with_its_rows(spark, monkeypatch):
    from quireflow.plans import live_plans

    paths = []
    monkeypatch.setattr(live_plans, "scratch_path", lambda s, kind: paths.append(scratch_path(s, kind)) or paths[-1])
    live_plans._written(spark.range(1000), "many", 2 * live_plans.FILES * live_plans.FILE_ROWS)
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 2 * live_plans.FILES
