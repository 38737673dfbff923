"""Model-call expressions: outcome classes, delays, admission and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow import contracts as c


def classify(status: Column, timed_out: Column) -> Column:
    """Outcome class of one call; a null status is a connection error."""
    return (
        F.when(timed_out | status.isNull() | (status == 408) | (status >= 500), "retry")
        .when(status < 300, "ok")
        .when(status == 429, "throttled")
        .when(status.isin(401, 403), "auth")
        .otherwise("permanent")
    )


def unit_draw(key: Column) -> Column:
    """A repeatable number in [0, 1) drawn from a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def backoff_s(draw: Column, attempt: Column) -> Column:
    """Full-jitter exponential backoff."""
    return draw * F.least(F.lit(c.MAX_DELAY_S), F.lit(c.BASE_DELAY_S) * F.pow(F.lit(2.0), attempt))


def deferral_s(draw: Column) -> Column:
    """Delay of a retry the budget deferred: the upper half of the longest delay."""
    return c.MAX_DELAY_S / 2 + draw * (c.MAX_DELAY_S / 2)


def send_delay_s(delay: Column) -> Column:
    """Whole seconds within what a queue message may be delayed."""
    return F.least(F.lit(c.MAX_SEND_DELAY_S), F.greatest(F.lit(0), delay.cast("int")))


def retry_after_s(ms_header: Column, s_header: Column) -> Column:
    """Milliseconds header first, then the seconds header; 1 s without a readable value."""
    ms, s = ms_header.try_cast("bigint") / 1000.0, s_header.try_cast("double")
    has_ms = ms_header.isNotNull() & (ms_header != "")
    read = F.when(has_ms, ms).when(s_header.isNull(), F.lit(1.0)).otherwise(s)
    return F.when(read.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), read))


def admission_rps(depth: Column) -> Column:
    """Cap on the fast stage's rate from the slow queue's depth."""
    return F.when(depth < 100, 100.0).when(depth < 500, 50.0).when(depth < 1000, 20.0).otherwise(0.0)


def verdict(calls: Column, throttled: Column, timeouts: Column, server_errors: Column, p95: Column,
            nominal_latency_s: Column, normal_error_rate: Column) -> Column:
    """overload, healthy or unknown for one window (null p95: no latencies)."""
    slow = F.coalesce(p95 > 2 * nominal_latency_s, F.lit(False))
    small = calls < c.MIN_SAMPLES
    loaded = slow | (throttled / calls >= 0.01) | (timeouts / calls >= 0.05) \
        | (server_errors / calls > 2 * normal_error_rate)
    return (
        F.when(small & (throttled > 0), "overload")
        .when(small & (timeouts == 0) & (server_errors == 0) & ~slow, "healthy")
        .when(small, "unknown")
        .when(loaded, "overload")
        .otherwise("healthy")
    )
