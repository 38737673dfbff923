"""Analytics over the log of model calls.

A call row has: call_id, model, ts (end of the call), status, timed_out, latency_s, is_retry,
replay (answered from the idempotency cache) and retry_after_s.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import calls as fx
from quireflow.operators import scan, stats


def window_id(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def with_outcome(calls: DataFrame) -> DataFrame:
    return calls.withColumn("outcome", fx.classify(F.col("status"), F.col("timed_out")))


def call_windows(calls: DataFrame, seconds: int = c.WINDOW_S, keys: Sequence[str] = ("model",),
                 max_group_rows: int = scan.MAX_GROUP_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Tumbling windows of calls per key, cache replays left out.

    Timeouts give no latency; a connection error gives one but is no server error."""
    group = [*keys, "win"]
    rows = with_outcome(calls.filter(~F.col("replay"))).withColumn("win", window_id(F.col("ts"), seconds)) \
        .withColumn("_latency", F.when(~F.col("timed_out"), F.col("latency_s")))
    timed_out = F.col("timed_out")
    aggs = [
        F.count("*").alias("calls"),
        F.count_if(~F.col("is_retry")).alias("first_calls"),
        F.count_if(F.col("outcome") == "throttled").alias("throttled"),
        F.count_if(timed_out).alias("timeouts"),
        F.count_if(~timed_out & (F.col("status") >= 500)).alias("server_errors"),
        F.count("_latency").alias("latencies"),
    ]
    _, largest = sizes or scan.group_stats(rows, group)
    if largest <= max_group_rows:
        p95 = F.expr("percentile_disc(0.95) within group (order by _latency)")
        return rows.groupBy(*group).agg(*aggs, F.coalesce(p95, F.lit(0.0)).alias("p95"))
    p95s = stats.quantiles(rows, group, "_latency", {"p95": 0.95}, interpolate=False,
                          max_group_rows=max_group_rows, sizes=sizes)
    return rows.groupBy(*group).agg(*aggs).join(p95s, group, "left").withColumn("p95", F.coalesce("p95", F.lit(0.0)))


def with_limits(df: DataFrame, columns: Sequence[str] | None = None, limits: DataFrame | None = None) -> DataFrame:
    """The per-model constants attached to rows with a ``model``; null for a model that ``limits`` (the
    known models by default, two rows) does not have."""
    known = scan.broadcast_checked(limits) if limits is not None else F.broadcast(c.model_limits(df.sparkSession))
    return df.join(known.select("model", *columns) if columns else known, "model", "left")


def judged(windows: DataFrame) -> DataFrame:
    """Windows with their verdict."""
    known = with_limits(windows, ["nominal_latency_s", "normal_error_rate"])
    p95 = F.when(F.col("latencies") > 0, F.col("p95"))
    return known.withColumn("verdict", fx.verdict(
        F.col("calls"), F.col("throttled"), F.col("timeouts"), F.col("server_errors"), p95,
        F.col("nominal_latency_s"), F.col("normal_error_rate"))).drop("nominal_latency_s", "normal_error_rate")


def with_idle_windows(windows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Every window id between a key's first and last, idle ones with zero counts: a running
    controller judges those too."""
    span = windows.groupBy(*keys).agg(F.min("win").alias("_a"), F.max("win").alias("_b"))
    # Cut long spans into pieces first, so that no single row explodes into all of them.
    pieces = span.select(*keys, "_b", F.explode(F.sequence("_a", "_b", F.lit(100_000))).alias("_a"))
    every = pieces.repartition(*keys, "_a").select(
        *keys, F.explode(F.sequence("_a", F.least(F.col("_b"), F.col("_a") + 99_999))).alias("win"))
    counts = [f for f in windows.columns if f not in (*keys, "win")]
    return every.join(windows, [*keys, "win"], "left").fillna(0, counts)


def success_rate(windows: DataFrame, seconds: int = c.WINDOW_S) -> DataFrame:
    """Successful calls per second of each window."""
    bad = F.col("throttled") + F.col("timeouts") + F.col("server_errors")
    return windows.withColumn("success_rps", F.greatest(F.lit(0), F.col("calls") - bad) / seconds)


def drain_time(windows: DataFrame, depths: DataFrame, seconds: int = c.WINDOW_S) -> DataFrame:
    """Seconds to empty the queue at the previous window's success rate, per window."""
    rates = success_rate(windows, seconds).select("model", (F.col("win") + 1).alias("win"), "success_rps")
    rate = F.coalesce("success_rps", F.lit(0.0))
    return depths.join(rates, ["model", "win"], "left") \
        .withColumn("success_rps", rate) \
        .withColumn("drain_s", F.col("depth") / F.greatest(F.col("success_rps"), F.lit(0.1)))


def retry_budget(calls: DataFrame, seconds: int = c.WINDOW_S, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per window: first calls and retries over it and the window before, and whether the
    retries stay within the budget. Each window is added to itself and to the next one, so
    nothing has to be sorted."""
    own = calls.filter(~F.col("replay")).withColumn("win", window_id(F.col("ts"), seconds)) \
        .groupBy(*keys, "win").agg(F.count_if(~F.col("is_retry")).alias("first_calls"), F.count_if("is_retry").alias("retries"))
    both = own.select(*keys, F.explode(F.array(F.struct("win", F.lit(1).alias("own")), F.struct(
        (F.col("win") + 1).alias("win"), F.lit(0).alias("own")))).alias("_w"), "first_calls", "retries")
    summed = both.groupBy(*keys, F.col("_w.win").alias("win")).agg(
        F.sum("first_calls").alias("first_calls"), F.sum("retries").alias("retries"), F.max("_w.own").alias("_own"))
    allowed = F.greatest(F.lit(float(c.RETRY_BUDGET_MIN)), c.RETRY_BUDGET_RATIO * F.col("first_calls"))
    return summed.filter("_own = 1").drop("_own").withColumn("within_budget", F.col("retries") <= allowed)


def failure_ratio(calls: DataFrame, reach: int = c.BREAKER_WINDOW, keys: Sequence[str] = ("model",),
                  **route) -> DataFrame:
    """Failure share of the last ``reach`` recorded calls, null until there are that many."""
    recorded = with_outcome(calls.filter(~F.col("replay"))).filter(F.col("outcome").isin("ok", "retry")) \
        .withColumn("_fail", (F.col("outcome") == "retry").cast("int"))
    return scan.neighbours(recorded, keys, ["ts", "call_id"], reach - 1, {
        "_n": lambda _, framed: F.count("*").over(framed), "_fails": lambda _, framed: F.sum("_fail").over(framed),
    }, **route).withColumn("failure_ratio", F.when(F.col("_n") == reach, F.col("_fails") / reach)) \
        .drop("_fail", "_n", "_fails")


def queue_depth(changes: DataFrame, seconds: int, **route) -> DataFrame:
    """Queue depth at the end of each window with changes, and the admission tier it allows.

    ``changes`` has queue, ts and delta (+1 enqueued, -1 taken). Changes are summed per window
    first; the running sum then only sees windows."""
    per_window = changes.groupBy("queue", window_id(F.col("ts"), seconds).alias("win")).agg(F.sum("delta").alias("_d"))
    depth = scan.running(per_window, ["queue"], ["win"], {"depth": scan.Running("sum", F.col("_d"))}, **route)
    return depth.drop("_d").withColumn("admission_rps", fx.admission_rps(F.col("depth")))


def in_flight(calls: DataFrame, keys: Sequence[str] = ("model",), **route) -> DataFrame:
    """Calls in flight after every instant at which that changes; a slot is held from the start
    of its call to the end, but no longer than its lifetime."""
    end_us = F.unix_micros("ts")
    start_us = end_us - F.round(F.col("latency_s") * 1e6).cast("long")
    until_us = F.least(end_us, start_us + c.SLOT_TTL_S * 1_000_000)
    edges = calls.select(*keys, F.explode(F.array(
        F.struct(start_us.alias("at_us"), F.lit(1).alias("delta")),
        F.struct(until_us.alias("at_us"), F.lit(-1).alias("delta")))).alias("e"))
    changes = edges.groupBy(*keys, F.col("e.at_us").alias("at_us")).agg(F.sum("e.delta").alias("_d"))
    return scan.running(changes, keys, ["at_us"], {"in_flight": scan.Running("sum", F.col("_d"))}, **route).drop("_d")


def spacing_audit(calls: DataFrame, rates: DataFrame, key: str = "model", **route) -> DataFrame:
    """Calls that follow the one before sooner than 1/rate; ``rates`` has (key, rps)."""
    spaced = scan.neighbours(calls, [key], ["ts", "call_id"], 1, {
        "_last": lambda ordered, _: F.lag(F.unix_micros("ts")).over(ordered)}, **route)
    gap = (F.unix_micros("ts") - F.col("_last")) / 1e6
    return spaced.withColumn("gap_s", gap).drop("_last").join(scan.broadcast_checked(rates), key, "left") \
        .withColumn("too_close", F.coalesce(F.col("gap_s") < 1 / F.col("rps"), F.lit(False))).drop("rps")


def freeze_audit(calls: DataFrame, keys: Sequence[str] = ("model",), **route) -> DataFrame:
    """Whether each call came before the freeze of an earlier 429 had ended."""
    until = F.when(F.col("outcome") == "throttled", F.unix_micros("ts") + F.round(F.col("retry_after_s") * 1e6).cast("long"))
    frozen = scan.running(with_outcome(calls), keys, ["ts", "call_id"],
                          {"frozen_until_us": scan.Running("max", until, inclusive=False)}, **route)
    return frozen.withColumn("in_freeze", F.coalesce(F.unix_micros("ts") < F.col("frozen_until_us"), F.lit(False)))


def request_excess(requests: DataFrame, key: str, rate: float, burst: int, **route) -> DataFrame:
    """Leaky-bucket excess of each request (key, ts, request_no) if none were refused, and
    whether it passes ``burst``. With S = n - rate * t, the excess is S minus its running minimum."""
    placed = scan.numbered(requests, [key], ["ts", "request_no"], "_n", 1, **route) \
        .withColumn("_s", F.col("_n") - F.unix_micros("ts") / 1e6 * F.lit(float(rate)))
    low = scan.running(placed, [key], ["ts", "request_no"], {"_low": scan.Running("min", F.col("_s"))}, **route)
    return low.withColumn("excess", F.col("_s") - F.col("_low")).withColumn("over_burst", F.col("excess") > burst) \
        .drop("_n", "_s", "_low")


def late_call_results(replayed: DataFrame) -> DataFrame:
    """Calls whose result came while the breaker took none, with the reason: ``breaker_open``, or ``probes_used`` while it was half open."""
    return replayed.filter("permit = 'deny'").withColumn("reason", F.when(F.col("breaker") == "open", "breaker_open").otherwise("probes_used"))
