"""Queries over the call log: classes, windows, verdicts, budgets, limits, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.functions import calls as fx
from quireflow.operators import calls as ops
from quireflow.operators import folds, stats
from quireflow.plans import inputs as i
from quireflow.plans.registry import ORACLE, query

W = i.WINDOW_S


@query("p1_outcome_classes", i.with_inputs("outcomes", """
SELECT model, outcome, coalesce(status, -1) AS status, timed_out, count(*) AS n FROM outcomes GROUP BY ALL"""))
def outcome_classes(spark, sf):
    return ops.with_outcome(i.calls(spark, sf)).groupBy(
        "model", "outcome", F.coalesce("status", F.lit(-1)).alias("status"), "timed_out").agg(F.count("*").alias("n"))


@query("p8_admission_tiers", """
SELECT user_id, count(*) AS depth, CASE WHEN count(*) < 100 THEN 100.0 WHEN count(*) < 500 THEN 50.0 WHEN count(*) < 1000 THEN 20.0 ELSE 0.0 END AS admission_rps
FROM events GROUP BY 1""")
def admission_tiers(spark, sf):
    depth = i.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("depth"))
    return depth.withColumn("admission_rps", fx.admission_rps(F.col("depth")))


@query("p9_retry_delays", """
WITH d AS (SELECT event_id, event_id % 8 AS attempt, ('0x' || substr(md5('call-' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM events)
SELECT event_id, attempt, round(draw * least(60.0::DOUBLE, pow(2.0::DOUBLE, attempt)), 6) AS backoff_s, round(30.0::DOUBLE + draw * 30.0::DOUBLE, 6) AS deferral_s,
  least(900, greatest(0, trunc(draw * 1200.0::DOUBLE)::INT)) AS send_delay_s FROM d""")
def retry_delays(spark, sf):
    rows = i.table(spark, sf, "events").select("event_id", (F.col("event_id") % 8).alias("attempt"), fx.unit_draw(
        F.concat(F.lit("call-"), F.col("event_id").cast("string"))).alias("draw"))
    return rows.select("event_id", "attempt", F.round(fx.backoff_s(F.col("draw"), F.col("attempt")), 6).alias("backoff_s"),
                       F.round(fx.deferral_s(F.col("draw")), 6).alias("deferral_s"),
                       fx.send_delay_s(F.col("draw") * 1200.0).alias("send_delay_s"))


@query("p10_retry_after", """
WITH h AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN floor(value * 10)::BIGINT::VARCHAR END AS ms,
  CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT::VARCHAR WHEN event_type = 'error' THEN 'soon' END AS s FROM events)
SELECT event_id, CASE WHEN ms IS NOT NULL THEN greatest(0.05, ms::BIGINT / 1000.0::DOUBLE) WHEN s IS NULL THEN 1.0
  WHEN try_cast(s AS DOUBLE) IS NULL THEN 1.0 ELSE greatest(0.05, s::DOUBLE) END AS retry_after_s FROM (SELECT event_id, ms, try_cast(s AS DOUBLE)::VARCHAR AS s FROM h)""")
def retry_after(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    ms = F.when(kind == "purchase", F.floor(value * 10).cast("string"))
    s = F.when(kind == "signup", F.floor(value).cast("string")).when(kind == "error", "soon")
    return i.table(spark, sf, "events").select("event_id", fx.retry_after_s(ms, s).alias("retry_after_s"))


@query("d4_call_windows", i.with_inputs("windows", "SELECT * FROM windows"))
def call_windows(spark, sf):
    return ops.call_windows(i.calls(spark, sf), W, sizes=i.call_sizes(spark, sf))


@query("d5_window_p95", i.with_inputs("calls", """
SELECT user_id, coalesce(quantile_disc(latency_s, 0.95) FILTER (WHERE NOT timed_out), 0) AS p95 FROM calls GROUP BY 1"""))
def window_p95(spark, sf):
    rows = i.calls(spark, sf).withColumn("v", F.when(~F.col("timed_out"), F.col("latency_s")))
    return stats.quantiles(rows, ["user_id"], "v", {"p95": 0.95}, interpolate=False) \
        .withColumn("p95", F.coalesce("p95", F.lit(0.0)))


@query("f12_window_verdicts", i.with_inputs("judged", "SELECT model, win, calls, p95, verdict FROM judged"))
def window_verdicts(spark, sf):
    return ops.judged(ops.call_windows(i.calls(spark, sf), W, sizes=i.call_sizes(spark, sf))).select("model", "win", "calls", "p95", "verdict")


@query("c9_calls_over_timeout", """
WITH l AS (SELECT * FROM (VALUES (0, 2.0, 'fast'), (1, 10.0, 'slow')) t(m, timeout_s, stage))
SELECT event_id AS call_id, stage, value / 50 > timeout_s AS over_timeout FROM events JOIN l ON m = user_id % 2""")
def calls_over_timeout(spark, sf):
    return ops.with_limits(i.calls(spark, sf), ["stage", "timeout_s"]).select(
        "call_id", "stage", (F.col("latency_s") > F.col("timeout_s")).alias("over_timeout"))


_DEPTH_SQL = f"""
WITH ch AS (
  SELECT model, epoch_us(ts) AS at_us, 1 AS delta FROM calls
  UNION ALL SELECT model, epoch_us(ts) + round(retry_after_s * 1000000)::BIGINT * 20, -1 FROM calls),
d AS (SELECT model, at_us // {W * 1_000_000} AS win, sum(delta) AS s FROM ch GROUP BY ALL),
depth AS (SELECT model, win, sum(s) OVER (PARTITION BY model ORDER BY win) AS depth FROM d)"""


def _depths(spark, sf):
    call = i.calls(spark, sf)
    taken = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("retry_after_s") * 1e6).cast("long") * 20)
    changes = call.select(F.col("model").alias("queue"), F.explode(F.array(
        F.struct(F.col("ts"), F.lit(1).alias("delta")), F.struct(taken.alias("ts"), F.lit(-1).alias("delta")))).alias("c")) \
        .select("queue", "c.*")
    return ops.queue_depth(changes, W)


@query("e8_queue_depth", i.with_inputs("calls", _DEPTH_SQL + """
SELECT model AS queue, win, depth::BIGINT AS depth, CASE WHEN depth < 100 THEN 100.0 WHEN depth < 500 THEN 50.0 WHEN depth < 1000 THEN 20.0 ELSE 0.0 END AS admission_rps FROM depth"""))
def queue_depth(spark, sf):
    return _depths(spark, sf)


@query("d6_drain_time", i.with_inputs("windows", _DEPTH_SQL + f""",
r AS (SELECT model, win + 1 AS win, greatest(0, calls - throttled - timeouts - server_errors) / {W} AS rps FROM windows)
SELECT model, win, depth::BIGINT AS depth, round(coalesce(rps, 0), 6) AS success_rps, round(depth / greatest(coalesce(rps, 0), 0.1), 4) AS drain_s
FROM depth LEFT JOIN r USING (model, win)"""))
def drain_time(spark, sf):
    depths = _depths(spark, sf).select(F.col("queue").alias("model"), "win", "depth")
    out = ops.drain_time(ops.call_windows(i.calls(spark, sf), W, sizes=i.call_sizes(spark, sf)), depths, W)
    return out.select("model", "win", "depth", F.round("success_rps", 6).alias("success_rps"), F.round("drain_s", 4).alias("drain_s"))


@query("e6_retry_budget", i.with_inputs("calls", f"""
WITH w AS (SELECT model, epoch_us(ts) // {W * 1_000_000} AS win, count(*) FILTER (WHERE NOT is_retry) AS f, count(*) FILTER (WHERE is_retry) AS r FROM calls WHERE NOT replay GROUP BY ALL),
s AS (SELECT model, win, sum(f) OVER p AS first_calls, sum(r) OVER p AS retries FROM w WINDOW p AS (PARTITION BY model ORDER BY win RANGE BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT model, win, first_calls::BIGINT AS first_calls, retries::BIGINT AS retries, retries <= greatest(5.0, 0.1::DOUBLE * first_calls) AS within_budget FROM s"""))
def retry_budget(spark, sf):
    return ops.retry_budget(i.calls(spark, sf), W)


@query("e7_failure_ratio", i.with_inputs("outcomes", """
SELECT call_id, model, CASE WHEN count(*) OVER w = 20 THEN sum((outcome = 'retry')::INT) OVER w / 20 END AS failure_ratio
FROM outcomes WHERE NOT replay AND outcome IN ('ok', 'retry')
WINDOW w AS (PARTITION BY model ORDER BY ts, call_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def failure_ratio(spark, sf):
    return ops.failure_ratio(i.calls(spark, sf), sizes=i.call_sizes(spark, sf)).select("call_id", "model", "failure_ratio")


_FLIGHT = i.with_inputs("calls", """
WITH e AS (
  SELECT model, s AS at_us, 1 AS d FROM (SELECT model, epoch_us(ts) AS t, epoch_us(ts) - round(latency_s * 60000000)::BIGINT AS s FROM calls)
  UNION ALL SELECT model, least(t, s + 60000000), -1 FROM (SELECT model, epoch_us(ts) AS t, epoch_us(ts) - round(latency_s * 60000000)::BIGINT AS s FROM calls))
SELECT model, at_us, sum(sum(d)) OVER (PARTITION BY model ORDER BY at_us)::BIGINT AS in_flight FROM e GROUP BY model, at_us""")


@query("e9_calls_in_flight", _FLIGHT)
def calls_in_flight(spark, sf):
    # Latencies count as minutes here, so that calls of this sparse log overlap and slots expire.
    return ops.in_flight(i.calls(spark, sf).withColumn("latency_s", F.col("latency_s") * 60), sizes=i.call_sizes(spark, sf, 2))


@query("e11_call_spacing", i.with_inputs("calls", """
SELECT call_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0, 6) AS gap_s,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 < 1 / CASE model WHEN 'layout' THEN 0.01 ELSE 0.005 END, false) AS too_close
FROM calls WINDOW w AS (PARTITION BY model ORDER BY ts, call_id)"""))
def call_spacing(spark, sf):
    rates = spark.createDataFrame([("layout", 0.01), ("vlm", 0.005)], "model string, rps double")
    return ops.spacing_audit(i.calls(spark, sf), rates, sizes=i.call_sizes(spark, sf)).select("call_id", F.round("gap_s", 6).alias("gap_s"), "too_close")


@query("c6_calls_in_freeze", i.with_inputs("outcomes", """
SELECT call_id, coalesce(epoch_us(ts) < max(CASE WHEN outcome = 'throttled' THEN epoch_us(ts) + round(retry_after_s * 1000000)::BIGINT END)
  OVER (PARTITION BY model ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_freeze FROM outcomes"""))
def calls_in_freeze(spark, sf):
    return ops.freeze_audit(i.calls(spark, sf), sizes=i.call_sizes(spark, sf)).select("call_id", "in_freeze")


@query("e12_request_excess", """
WITH n AS (SELECT event_id, event_type, ts, row_number() OVER w - (epoch_us(ts) / 1000000.0::DOUBLE) * 0.0005::DOUBLE AS s FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
m AS (SELECT event_id, s - min(s) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS excess FROM n)
SELECT event_id, round(excess, 4) AS excess, excess > 20 AS over_burst FROM m""")
def request_excess(spark, sf):
    rows = i.table(spark, sf, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts")) \
        .withColumn("request_no", F.col("event_id"))
    return ops.request_excess(rows, "event_type", 0.0005, 20).select("event_id", F.round("excess", 4).alias("excess"), "over_burst")


# --- replays --------------------------------------------------------------------------------------

@query("x2_limit_replay", i.with_inputs("judged", """
WITH span AS (SELECT model, min(win) AS a, max(win) AS b FROM judged GROUP BY 1),
every AS (SELECT model, unnest(range(a, b + 1)) AS win FROM span),
v AS (SELECT e.model, e.win, coalesce(j.verdict, 'healthy') AS verdict, row_number() OVER (PARTITION BY e.model ORDER BY e.win) AS rn,
        hard_rps, start_rps, start_concurrency, max_concurrency
      FROM every e LEFT JOIN judged j USING (model, win) JOIN limits l ON l.model = e.model),
s AS (
  SELECT model, win, 0::BIGINT AS rn, start_rps AS rps, start_concurrency AS c, 0 AS o, 0 AS h FROM v WHERE rn = 1
  UNION ALL
  SELECT v.model, v.win, v.rn,
    round_even(least(hard_rps, greatest(1.0, CASE WHEN verdict = 'overload' AND o + 1 >= 2 THEN rps * 0.5
      WHEN verdict = 'healthy' AND h + 1 >= 3 THEN rps + 0.1::DOUBLE * hard_rps ELSE rps END)), 3),
    least(max_concurrency, greatest(1, CASE WHEN verdict = 'overload' AND o + 1 >= 2 THEN c // 2
      WHEN verdict = 'healthy' AND h + 1 >= 3 THEN c + greatest(1, round_even(0.1::DOUBLE * max_concurrency, 0)::INT) ELSE c END)),
    CASE verdict WHEN 'overload' THEN o + 1 WHEN 'healthy' THEN 0 ELSE o END,
    CASE verdict WHEN 'healthy' THEN h + 1 WHEN 'overload' THEN 0 ELSE h END
  FROM s JOIN v ON v.model = s.model AND v.rn = s.rn + 1)
SELECT s.model, s.win, verdict, round(rps, 3) AS rps, c AS concurrency, o AS overload_streak, h AS healthy_streak FROM s JOIN v USING (model, rn) WHERE rn > 0""",
                                           recursive=True))
def limit_replay(spark, sf):
    judged = ops.judged(ops.with_idle_windows(ops.call_windows(i.calls(spark, sf), W, sizes=i.call_sizes(spark, sf))))
    return folds.replay_limits(judged.select("model", "win", "verdict")).withColumn("rps", F.round("rps", 3))


@query("x4_breaker_replay", i.with_inputs("outcomes", """
WITH v AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS moment, row_number() OVER (PARTITION BY model ORDER BY ts, call_id) AS rn FROM outcomes),
s AS (
  SELECT model, 0::BIGINT AS rn, 'closed' AS mode, 0.0::DOUBLE AS since, 0 AS used, 0 AS good, '' AS recent, 0 AS trips, '' AS permit FROM v WHERE rn = 1
  UNION ALL
  SELECT model, rn, CASE WHEN trip THEN 'open' WHEN closes THEN 'closed' ELSE m END, CASE WHEN trip THEN moment ELSE sc END,
    CASE WHEN trip OR closes THEN 0 WHEN pm = 'probe' AND NOT counts AND outcome <> 'auth' THEN u ELSE u + (pm = 'probe')::INT END,
    CASE WHEN trip OR closes THEN 0 WHEN pm = 'probe' AND counts AND outcome = 'ok' THEN g + 1 ELSE g END,
    CASE WHEN closes THEN '' ELSE nr END, trips + trip::INT, pm
  FROM (SELECT *, pm <> 'deny' AND (outcome = 'auth' OR (counts AND outcome = 'retry' AND (m = 'half_open' OR
            (length(nr) >= 20 AND length(nr) - length(replace(nr, '0', '')) >= 10)))) AS trip,
          pm = 'probe' AND counts AND outcome = 'ok' AND g + 1 >= 3 AS closes
    FROM (SELECT *, CASE WHEN m = 'closed' AND counts THEN left(CASE WHEN outcome = 'ok' THEN '1' ELSE '0' END || recent, 20) ELSE recent END AS nr
      FROM (SELECT *, CASE WHEN m = 'open' THEN 'deny' WHEN m = 'closed' THEN 'allow' WHEN u < 3 THEN 'probe' ELSE 'deny' END AS pm
        FROM (SELECT *, CASE WHEN m = 'half_open' AND u0 >= 3 AND moment - s0 >= 3600 THEN 0 ELSE u0 END AS u, CASE WHEN m = 'half_open' AND u0 >= 3 AND moment - s0 >= 3600 THEN moment ELSE s0 END AS sc
          FROM (SELECT v.model, v.rn, v.moment, v.outcome, NOT v.replay AND v.outcome IN ('ok', 'retry') AS counts, s.recent, s.trips,
              CASE WHEN s.mode = 'open' AND v.moment - s.since >= 3600 THEN 'half_open' ELSE s.mode END AS m,
              CASE WHEN s.mode = 'open' AND v.moment - s.since >= 3600 THEN v.moment ELSE s.since END AS s0,
              CASE WHEN s.mode = 'open' AND v.moment - s.since >= 3600 THEN 0 ELSE s.used END AS u0,
              CASE WHEN s.mode = 'open' AND v.moment - s.since >= 3600 THEN 0 ELSE s.good END AS g
            FROM s JOIN v ON v.model = s.model AND v.rn = s.rn + 1))))))
SELECT v.call_id, v.model, s.permit, s.mode AS breaker, s.trips FROM s JOIN v USING (model, rn) WHERE rn > 0""", recursive=True))
def breaker_replay(spark, sf):
    # Open for an hour: calls of this log are minutes apart.
    out = folds.replay_breaker(i.calls(spark, sf), fold=folds.breaker_fold(open_s=3600.0), sizes=i.call_sizes(spark, sf))
    return out.select("call_id", "model", "permit", "breaker", "trips")


@query("x11_late_call_results", f"""
SELECT call_id, model, CASE breaker WHEN 'open' THEN 'breaker_open' ELSE 'probes_used' END AS reason FROM ({ORACLE["x4_breaker_replay"]}) r WHERE permit = 'deny'""")
def late_call_results(spark, sf):
    return ops.late_call_results(breaker_replay(spark, sf)).select("call_id", "model", "reason")


@query("d5_sketched_windows", i.with_inputs("outcomes", f"""
SELECT model, win, CASE WHEN p95 > 0 THEN round(2 * pow({stats.SLOT_RATIO}::DOUBLE, ceil(ln(p95) / ln({stats.SLOT_RATIO}::DOUBLE))) / ({stats.SLOT_RATIO}::DOUBLE + 1), 9) WHEN p95 <= 0 THEN 0 END AS p95
FROM (SELECT model, epoch_us(ts) // {W * 1_000_000} AS win, quantile_disc(latency_s, 0.95) FILTER (WHERE NOT timed_out) AS p95 FROM outcomes GROUP BY ALL)"""))
def sketched_windows(spark, sf):
    """Tail latency per window from counts per slot, within half a per cent."""
    calls = i.calls(spark, sf).select("model", ops.window_id(F.col("ts"), W).alias("win"), F.when(~F.col("timed_out"), F.col("latency_s")).alias("latency_s"))
    return stats.sketched_quantiles(calls, ["model", "win"], "latency_s", {"p95": 0.95}).withColumn("p95", F.round("p95", 9))


@query("x5_retry_grants", i.with_inputs("calls", f"""
WITH v AS (SELECT call_id, model, is_retry, replay, epoch_us(ts) // {W * 1_000_000} AS win, row_number() OVER (PARTITION BY model ORDER BY ts, call_id) AS rn FROM calls),
s AS (
  SELECT model, 0::BIGINT AS rn, win AS w, 0 AS f, 0 AS r, 0 AS pf, 0 AS pr, NULL::BOOLEAN AS granted FROM v WHERE rn = 1
  UNION ALL
  SELECT model, rn, win, f + (NOT is_retry AND NOT replay)::INT, r + (is_retry AND ok)::INT, pf, pr, CASE WHEN is_retry THEN ok END
  FROM (SELECT *, r + pr < greatest(5.0, 0.1::DOUBLE * (f + pf)) AS ok FROM (
    SELECT v.model, v.rn, v.win, v.is_retry, v.replay, CASE WHEN v.win = s.w THEN s.f ELSE 0 END AS f, CASE WHEN v.win = s.w THEN s.r ELSE 0 END AS r,
      CASE WHEN v.win = s.w THEN s.pf WHEN v.win = s.w + 1 THEN s.f ELSE 0 END AS pf, CASE WHEN v.win = s.w THEN s.pr WHEN v.win = s.w + 1 THEN s.r ELSE 0 END AS pr
    FROM s JOIN v ON v.model = s.model AND v.rn = s.rn + 1)))
SELECT v.call_id, v.model, s.granted FROM s JOIN v USING (model, rn) WHERE rn > 0""", recursive=True))
def retry_grants(spark, sf):
    return folds.replay_retries(i.calls(spark, sf), W, sizes=i.call_sizes(spark, sf)).select("call_id", "model", "granted")
