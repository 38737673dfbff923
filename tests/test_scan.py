"""Both routes of every ordered operator give the same rows, a third of which share one key."""

import pytest
from comparing import rows
from pyspark.sql import functions as F

from quireflow.operators import calls, folds, ordered, scan, stats
from quireflow.operators.scan import Running

SPREAD = {"max_group_rows": 50, "chunk_rows": 700}


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 40 as string)) k", "cast(pmod(hash(id), 500) as int) v").cache()


def test_running(data):
    columns = {"s": Running("sum", F.col("v")), "before": Running("max", F.col("v"), False), "low": Running("min", F.col("v")),
               "n": scan.row_count(), "bits": Running("bit_or", F.col("v"))}
    assert rows(scan.running(data, ["k"], ["v", "id"], columns)) == rows(scan.running(data, ["k"], ["v", "id"], columns, **SPREAD))


@pytest.mark.parametrize("forward", [False, True])
def test_neighbours(data, forward):
    step = F.lead if forward else F.lag
    columns = {"next": lambda o, _: step("v").over(o), "sum": lambda _, f: F.sum("v").over(f)}
    assert rows(scan.neighbours(data, ["k"], ["id"], 19, columns, forward)) == rows(scan.neighbours(data, ["k"], ["id"], 19, columns, forward, **SPREAD))


def test_replay_in_chunks_is_the_sequential_replay(data):
    def step(state, v):
        total, streak = state or (0, 0)
        state = [(total * 3 + v) % 7 if v % 5 else 0, streak + 1 if v % 11 else 0]
        return state, tuple(state)

    fold = scan.Fold(("v",), "total int, streak int", step)
    expected, state = [], {}
    for row in data.orderBy("k", "id").collect():
        state[row.k], out = step(state.get(row.k), row.v)
        expected.append((row.id, row.k, row.v, *out))
    for size in (100_000, 300):
        assert rows(scan.replay(data, ["k"], ["id"], fold, chunk_rows=size)) == sorted(expected, key=str)


@pytest.mark.parametrize("interpolate", [True, False])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(data, interpolate, keys):
    wanted = {"a": 0.5, "b": 0.95}
    one = rows(stats.quantiles(data, keys, "v", wanted, interpolate))
    other = rows(stats.quantiles(data, keys, "v", wanted, interpolate, max_group_rows=10))
    assert len(one) == len(other)
    for x, y in zip(one, other):
        assert x[:-2] == y[:-2] and x[-2:] == pytest.approx(y[-2:])


def test_nearest_rank_of_twenty_is_the_nineteenth(spark):
    assert stats.quantiles(spark.range(1, 21), [], "id", {"q": 0.95}, False).first().q == 19


def test_stream_operators_spread(spark):
    events = spark.range(900).selectExpr(
        "if(id % 3 = 0, 0, id % 7 + 1) job_id", "id", "cast(pmod(hash(id), 100000) as int) r")
    events = scan.numbered(events, ["job_id"], ["id"], "n", 0)
    # Pages arrive in a scrambled order; a few never do.
    events = events.withColumn("page_idx", F.col("n").cast("int")).filter("r % 29 != 0")
    events = ordered.allocate_seq(events, ["r", "id"]).selectExpr("job_id", "seq", "'page_result' kind", "page_idx", "1000 total_pages").cache()
    one = ordered.with_window_bits(ordered.with_watermark(events))
    other = ordered.with_window_bits(ordered.with_watermark(events, **SPREAD), **SPREAD)
    assert rows(one.select("job_id", "seq", "page_watermark", "watermark_before", "window_bits")) == \
        rows(other.select("job_id", "seq", "page_watermark", "watermark_before", "window_bits"))
    done, by_job = {}, {}
    for row in one.orderBy("job_id", "seq").collect():
        pages = done.setdefault(row.job_id, set())
        pages.add(row.page_idx)
        mark = by_job.get(row.job_id, 0)
        assert row.watermark_before == mark
        while mark in pages:
            mark += 1
        by_job[row.job_id] = mark
        assert row.page_watermark == mark
        bits = sum(1 << k for k in range(64) if mark + k in pages)
        assert row.window_bits % (1 << 64) == bits


def test_breaker_and_budget_replays_spread(spark):
    log = spark.range(3000).selectExpr(
        "id call_id", "if(id % 4 = 0, 'vlm', 'layout') model", "timestamp_micros(id * 7000000) ts",
        "case when pmod(hash(id), 10) < 6 then 200 when pmod(hash(id), 10) = 6 then 429 when pmod(hash(id), 100) = 70 then 401 when pmod(hash(id), 10) < 9 then 503 end status",
        "false timed_out", "1.0D latency_s", "id % 3 = 0 is_retry", "id % 50 = 0 replay", "1.0D retry_after_s").cache()
    assert rows(folds.replay_breaker(log)) == rows(folds.replay_breaker(log, chunk_rows=100))
    assert rows(folds.replay_retries(log, 60)) == rows(folds.replay_retries(log, 60, chunk_rows=100))
    assert rows(calls.call_windows(log, 600)) == rows(calls.call_windows(log, 600, max_group_rows=10))
    assert rows(calls.failure_ratio(log)) == rows(calls.failure_ratio(log, **SPREAD))


@pytest.mark.parametrize("interpolate", [True, False])
def test_groups_of_nothing_but_nulls_stay_on_both_routes(spark, interpolate):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 3), ("b", 1), ("b", None), ("b", 2)], "k string, v int")
    one = rows(stats.quantiles(df, ["k"], "v", {"q": 0.5}, interpolate))
    assert one == rows(stats.quantiles(df, ["k"], "v", {"q": 0.5}, interpolate, max_group_rows=1)) and len(one) == 3


def test_models_without_constants_keep_their_rows(spark):
    base = spark.range(40).selectExpr("if(id % 2 = 0, 'slow', 'other') model", "id call_id", "timestamp_seconds(id) ts", "200 status", "false timed_out", "1.0D latency_s", "false replay", "false is_retry")
    windows = calls.judged(calls.call_windows(base, 10))
    assert windows.count() == 8
    assert calls.call_windows(base, 10).count() == windows.count()
    spaced = calls.spacing_audit(base, spark.createDataFrame([("slow", 0.1)], "model string, rps double"))
    assert spaced.count() == 40 and spaced.filter("model = 'other' and too_close").isEmpty()
    limits = folds.replay_limits(windows.select("model", "win", "verdict"))
    assert limits.count() == 8 and limits.filter("model = 'other' and rps is not null").isEmpty()


def test_a_breaker_replay_of_forty_chunks_takes_few_rounds(spark, monkeypatch):
    rounds = []
    ends_of = scan._ends_of
    monkeypatch.setattr(scan, "_ends_of", lambda *a: rounds.append(1) or ends_of(*a))
    base = spark.range(40_000).selectExpr("'m' model", "id call_id", "timestamp_seconds(id) ts", "if(pmod(hash(id), 10) < 4, 500, 200) status", "false timed_out", "false replay")
    one = folds.replay_breaker(base)
    other = folds.replay_breaker(base, chunk_rows=1000, sizes=(40_000, 40_000))
    assert rows(one.select("call_id", "permit", "breaker", "trips")) == rows(other.select("call_id", "permit", "breaker", "trips"))
    assert len(rounds) <= 3


def test_watermark_and_window_bits_hash_the_events_once(spark):
    events = spark.createDataFrame([(j, s, "page_result", p, 3) for j in range(4) for s, p in ((1, 0), (2, 2), (3, 1))],
                                   "job_id long, seq long, kind string, page_idx int, total_pages int")
    sizes = (12, 3)
    full = ordered.with_window_bits(ordered.with_watermark(scan.together(events, ["job_id"], sizes), sizes=sizes), sizes=sizes)
    assert [(r.page_watermark, r.watermark_before, r.window_bits) for r in full.filter("job_id = 2").orderBy("seq").collect()] == [(1, 0, 0), (1, 1, 2), (3, 1, 0)]
    assert full._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_rows_that_are_hashed_together_get_partitions_by_their_number(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert scan.together(rows, ["k"], (10_000, 1), part_rows=100).rdd.getNumPartitions() == 100
    assert scan.together(rows, ["k"], (10_000, 5000), max_group_rows=1000) is rows


def test_totals_of_both_routes(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, v int")
    want = [("a", 1, 3), ("a", 2, 3), ("b", 5, 5), (None, 7, 7)]
    for largest in (10, 0):
        got = scan.totals(rows, ["k"], {"s": F.sum("v")}, max_group_rows=largest).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
