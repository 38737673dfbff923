"""State machines of the call and page logs: pure step functions, shared by the batch replays
below and the stream processors of ``quireflow.streaming``.

A state is None before the first row of its key and holds JSON values only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.operators import calls as call_ops
from quireflow.operators import scan


# --- adaptive limits ------------------------------------------------------------------------

#: What a verdict does to the run of like verdicts, which is negative while overloaded.
_PULL = {"healthy": 1, "overload": -1}


def limits_step(state, verdict, hard_rps, start_rps, start_concurrency, max_concurrency):
    """One judged window. A run of like verdicts counts up from its first window; a verdict that
    says nothing leaves it as it is. Long runs move both limits once per window, within bounds."""
    if hard_rps is None:  # a model without constants has no limits
        return state, (None, None, None, None)
    rps, slots, run = state or (start_rps, start_concurrency, 0)
    pull = _PULL.get(verdict, 0)
    run = run + pull if run * pull >= 0 else pull
    if pull and pull * run >= (c.HEALTHY_WINDOWS if pull > 0 else c.OVERLOAD_WINDOWS):
        rise_rps, rise_slots = hard_rps * 0.1, max(1, round(max_concurrency * 0.1))
        rps, slots = (rps + rise_rps, slots + rise_slots) if pull > 0 else (rps / 2, slots // 2)
    _, rps, _ = sorted((c.MIN_RPS, rps, hard_rps))
    _, slots, _ = sorted((c.MIN_CONCURRENCY, slots, max_concurrency))
    state = [round(rps, 3), int(slots), run]
    return state, (*state[:2], max(0, -run), max(0, run))


LIMITS = scan.Fold(
    ("verdict", "hard_rps", "start_rps", "start_concurrency", "max_concurrency"),
    "rps double, concurrency int, overload_streak int, healthy_streak int", limits_step)


def replay_limits(judged: DataFrame, keys: Sequence[str] = ("model",), **route) -> DataFrame:
    """Limits after each judged window. Idle windows must be present (``with_idle_windows``):
    the controller is taken to run from a key's first window to its last."""
    known = call_ops.with_limits(judged, ["hard_rps", "start_rps", "start_concurrency", "max_concurrency"])
    return scan.replay(known, keys, ["win"], LIMITS, **route) \
        .drop("hard_rps", "start_rps", "start_concurrency", "max_concurrency")


# --- circuit breaker ------------------------------------------------------------------------

def breaker_step(window: int, threshold: float, open_s: float, probes: int):
    """Step of a breaker with the given limits. A call is first let through or denied, at its own
    time; a denied call changes nothing more. Answers from the cache, 429s and permanent errors
    say nothing about the model and hand an unused probe back."""

    closed = ("closed", 0.0, 0, 0, "")

    def step(state, at, outcome, replay):
        mode, since, used, good, recent = state or closed
        if mode == "open" and at - since >= open_s:
            mode, since = "half_open", at
        if mode == "half_open" and used >= probes and at - since >= open_s:
            since, used = at, 0
        permit = "allow" if mode == "closed" else "probe" if mode == "half_open" and used < probes else "deny"
        used += permit == "probe"
        silent = replay or outcome not in ("ok", "retry")
        tripped = permit != "deny" and outcome == "auth"
        if permit == "probe" and not tripped:
            used, good, tripped = used - silent, good + (outcome == "ok" and not silent), outcome == "retry" and not silent
        elif permit == "allow" and not silent:
            recent = ("0" if outcome == "retry" else "1") + recent[: window - 1]
            tripped = outcome == "retry" and len(recent) == window and recent.count("0") >= threshold * window
        if tripped:
            mode, since, used, good, recent = "open", at, 0, 0, ""
        elif good >= probes:
            mode, since, used, good, recent = closed
        return [mode, since, used, good, recent], (permit, mode, int(tripped))

    return step


def counting_trips(step):
    """``step`` with the trips so far in the state and in place of its last output, for live use: there no
    later pass can add them up."""

    def counted(state, *inputs):
        inner, trips = state or (None, 0)
        inner, (*out, tripped) = step(inner, *inputs)
        return [inner, trips + tripped], (*out, trips + tripped)

    return counted


def breaker_fold(window: int = c.BREAKER_WINDOW, threshold: float = c.BREAKER_THRESHOLD,
                 open_s: float = c.BREAKER_OPEN_S, probes: int = c.BREAKER_PROBES) -> scan.Fold:
    """``trips`` is 1 where a call trips the breaker: a count in the state would make it depend on
    everything before, and chunks of a replay could not run side by side."""
    return scan.Fold(("at_s", "outcome", "replay"), "permit string, breaker string, trips int",
                     breaker_step(window, threshold, open_s, probes))


def replay_breaker(calls: DataFrame, keys: Sequence[str] = ("model",), fold: scan.Fold | None = None,
                   **route) -> DataFrame:
    """Calls with the permit a breaker would have given, its state afterwards and its trips so far."""
    order = ["at_s", "call_id"]
    rows = call_ops.with_outcome(calls).withColumn("at_s", F.unix_micros("ts") / 1e6)
    out = scan.replay(rows, keys, order, fold or breaker_fold(), **route).withColumnRenamed("trips", "_trip")
    counted = scan.running(out, keys, order, {"trips": scan.Running("sum", F.col("_trip"))}, sizes=route.get("sizes"))
    return counted.withColumn("trips", F.col("trips").cast("int")).drop("_trip")


# --- retry grants ---------------------------------------------------------------------------

def retry_step(state, win, is_retry, replay):
    """Grant a retry while granted retries of this window and the one before stay under the
    larger of the minimum and a tenth of their first calls. A deferral uses nothing."""
    at, first, retries, first_before, retries_before = state or (win, 0, 0, 0, 0)
    if win != at:
        kept = win == at + 1
        at, first_before, retries_before = win, first if kept else 0, retries if kept else 0
        first, retries = 0, 0
    granted = None
    if is_retry:
        granted = retries + retries_before < max(c.RETRY_BUDGET_MIN, c.RETRY_BUDGET_RATIO * (first + first_before))
        retries += granted
    elif not replay:
        first += 1
    return [at, first, retries, first_before, retries_before], (granted,)


RETRIES = scan.Fold(("win", "is_retry", "replay"), "granted boolean", retry_step)


def replay_retries(calls: DataFrame, seconds: int = c.WINDOW_S, keys: Sequence[str] = ("model",), **route) -> DataFrame:
    """Calls with ``granted``: whether a retry was within the budget (null for first calls)."""
    rows = calls.withColumn("win", call_ops.window_id(F.col("ts"), seconds)).withColumn("at_us", F.unix_micros("ts"))
    return scan.replay(rows, keys, ["at_us", "call_id"], RETRIES, **route).drop("at_us")


# --- page states ----------------------------------------------------------------------------

def page_step(state, stage, delivery, outcome, within_budget):
    """One delivered message of a page, with the outcome its call had (or would have).

    Messages of another stage or of a finished page are duplicates. A page gives up after its
    third failed call (the last one is not counted as an attempt) or on its fourth delivery:
    the fast stage then goes on without a result, the slow stage falls back or fails."""
    status, at, fast_tries, slow_tries, has_fast, source, low = state or ("PENDING", "fast", 0, 0, False, None, False)
    if stage != at or status in c.TERMINAL_STATUSES:
        return [status, at, fast_tries, slow_tries, has_fast, source, low], \
            ("duplicate", status, at, fast_tries, slow_tries, has_fast, source, low)
    tries = fast_tries if stage == "fast" else slow_tries
    if delivery > c.MAX_DELIVERIES:
        action = "gave_up"
    elif tries > 0 and not within_budget:
        action = "budget_deferred"
    elif outcome in ("ok", "throttled", "auth"):
        action = outcome
    elif outcome == "retry":
        action = "gave_up" if tries + 1 >= c.MAX_ATTEMPTS else "failure"
    else:
        action = "failed" if stage == "fast" else "gave_up"

    if action == "ok" and stage == "slow":
        status, source = "COMPLETED", "vlm"
    elif action == "failed":
        status, source, low = "FAILED", "none", True
    elif action == "gave_up" and stage == "slow":
        if has_fast:
            action, status, source, low = "fallback", "COMPLETED", "layout_fallback", True
        else:
            action, status, source, low = "failed", "FAILED", "none", True
    elif action in ("ok", "gave_up"):
        status, at, has_fast = "FAST_COMPLETED", "slow", action == "ok"
    else:
        status = "RETRY_WAIT"
        if action == "failure":
            fast_tries, slow_tries = fast_tries + (stage == "fast"), slow_tries + (stage == "slow")
    new = [status, at, fast_tries, slow_tries, has_fast, source, low]
    return new, (action, *new)


PAGES = scan.Fold(
    ("stage", "delivery", "outcome", "within_budget"),
    "action string, status string, page_stage string, fast_attempts int, slow_attempts int, has_fast_result boolean, "
    "source string, low_confidence boolean", page_step)


def replay_pages(deliveries: DataFrame, order: Sequence[str], **route) -> DataFrame:
    """Deliveries with the action taken and the page's state afterwards."""
    return scan.replay(deliveries, ["job_id", "page_idx"], order, PAGES, **route)


# --- reassembly -----------------------------------------------------------------------------

def assembly_step(state, seq, page_idx, payload, total_pages):
    """One frame of a job's reorder buffer, in seq order: pages ready in document order, and
    whether the job has just become complete. Repeated frames are ignored."""
    last, following, done, complete, waiting = state or (0, 0, 0, False, {})
    if seq <= last:
        return [last, following, done, complete, waiting], ([], False)
    waiting = dict(waiting)
    ready = []
    if page_idx is not None and page_idx >= following and str(page_idx) not in waiting:
        waiting[str(page_idx)] = payload
        done += 1
        while str(following) in waiting:
            ready.append((following, waiting.pop(str(following))))
            following += 1
    finished = not complete and bool(total_pages) and done >= total_pages
    return [seq, following, done, complete or finished, waiting], (ready, finished)
