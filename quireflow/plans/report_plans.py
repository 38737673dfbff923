"""Reports: runs, loads, latencies, histograms, counters, trends; and page-result shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import shaping
from quireflow.operators import calls as call_ops
from quireflow.operators import ordered, reports, stats
from quireflow.plans import inputs as i
from quireflow.plans.registry import query

W = i.WINDOW_S


# --- runs and loads -------------------------------------------------------------------------------

@query("d10_run_summary", i.with_inputs("frames", """
SELECT job_id, count(*) AS frames, count(page_idx) AS pages, count(*) FILTER (WHERE source = 'vlm') AS vlm, count(*) FILTER (WHERE source = 'layout_fallback') AS layout_fallback,
  count(*) FILTER (WHERE source = 'none') AS "none", count(*) FILTER (WHERE low_confidence) AS low_confidence_pages, epoch_us(max(moment)) - epoch_us(min(moment)) AS elapsed_us FROM frames GROUP BY 1"""))
def run_summary(spark, sf):
    return reports.run_summary(i.frames(spark, sf).withColumn("received_at", F.col("at")))


@query("d10_page_lists", i.with_inputs("frames", """
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY arrival) - 1) // 100 AS part FROM frames WHERE page_idx IS NOT NULL)
SELECT job_id, part, string_agg(page_idx, ',' ORDER BY arrival) AS arrival_order, coalesce(string_agg(page_idx, ',' ORDER BY page_idx) FILTER (WHERE low_confidence), '') AS low_confidence_pages FROM p GROUP BY ALL"""))
def page_lists(spark, sf):
    out = reports.page_lists(i.frames(spark, sf), sizes=i.line_sizes(spark, sf, 6))
    return out.select("job_id", "part", F.array_join("arrival_order", ",").alias("arrival_order"), F.array_join("low_confidence_pages", ",").alias("low_confidence_pages"))


@query("d11_load_report", i.with_inputs("stream_events jobs", """
WITH done AS (SELECT *, coalesce(list(page_idx) FILTER (WHERE page_idx IS NOT NULL) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING), []) AS done FROM stream_events),
wm AS (SELECT *, coalesce((SELECT min(g) FROM (SELECT unnest(range(total_pages + 1)) AS g) x WHERE NOT list_contains(done, g::INT)), total_pages) AS w FROM done),
o AS (SELECT job_id, max(w) AS emitted, count(*) FILTER (WHERE page_idx <> prior) AS ooo FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY job_id ORDER BY seq), 0) AS prior FROM wm) GROUP BY 1)
SELECT count(*) AS jobs, coalesce(sum(emitted), 0)::BIGINT AS pages, coalesce(sum(ooo), 0)::BIGINT AS out_of_order_arrivals, bool_and(coalesce(emitted = j.total_pages, false)) AS all_in_order,
  (SELECT count(*) FROM stream_events s JOIN o USING (job_id) WHERE page_idx < emitted AND low_confidence) AS fallback_pages, round(coalesce(sum(emitted), 0) / 100.0::DOUBLE, 2) AS pages_per_s FROM jobs j LEFT JOIN o USING (job_id)"""))
def load_report(spark, sf):
    assembled = ordered.reassembly(i.frames(spark, sf), sizes=i.line_sizes(spark, sf, 6))
    results = i.stream_events(spark, sf).filter("page_idx is not null").select("job_id", "page_idx", "low_confidence")
    return reports.load_report(assembled, i.jobs(spark, sf), results, 100.0)


def _report_jobs(spark, sf):
    last = i.pages(spark, sf).groupBy("job_id").agg(F.max("completed_at").alias("_last"), F.count_if(F.col("completed_at").isNull()).alias("_open"))
    finished = F.when(F.col("_open") == 0, F.greatest("_last", "accepted_at"))
    accepted = i.jobs(spark, sf).select("job_id", F.col("created_at").alias("accepted_at"), (F.col("o_totalprice") / 100).alias("upload_ms"))
    return accepted.join(last, "job_id", "left").withColumn("finished_at", finished).drop("_last", "_open")


_REPORT = """
WITH l AS (SELECT job_id, max(completed_at) AS last, count(*) FILTER (WHERE completed_at IS NULL) AS open FROM page_state GROUP BY 1),
j AS (SELECT job_id, created_at AS accepted_at, o_totalprice / 100 AS upload_ms, CASE WHEN open = 0 THEN greatest(last, created_at) END AS finished_at FROM jobs LEFT JOIN l USING (job_id)),
p AS (SELECT job_id, completed_at AS received_at FROM page_state WHERE completed_at IS NOT NULL)"""


@query("d12_latency_report", i.with_inputs("page_state jobs", _REPORT + """,
m AS (SELECT 'page' AS measure, (epoch_ms(received_at) - epoch_ms(accepted_at))::DOUBLE AS ms FROM p JOIN j USING (job_id)
  UNION ALL SELECT 'first_page', min((epoch_ms(received_at) - epoch_ms(accepted_at))::DOUBLE) FROM p JOIN j USING (job_id) GROUP BY job_id
  UNION ALL SELECT 'job', (epoch_ms(finished_at) - epoch_ms(accepted_at))::DOUBLE FROM j WHERE finished_at IS NOT NULL
  UNION ALL SELECT 'upload', upload_ms FROM j)
SELECT measure, round(min(ms), 3) AS "min", round(quantile_cont(ms, 0.5), 3) AS med, round(quantile_cont(ms, 0.9), 3) AS p90, round(quantile_cont(ms, 0.95), 3) AS p95,
  round(quantile_cont(ms, 0.99), 3) AS p99, round(max(ms), 3) AS "max" FROM m GROUP BY 1"""))
def latency_report(spark, sf):
    arrived = i.pages(spark, sf).filter("completed_at is not null").select("job_id", F.col("completed_at").alias("received_at"))
    marks = reports.latency_marks(arrived, _report_jobs(spark, sf))
    rows = i.line_sizes(spark, sf)[0]
    out = reports.latency_report(marks, sizes=(4 * rows, 2 * rows))
    return out.select("measure", *[F.round(n, 3).alias(n) for n in ("min", "med", "p90", "p95", "p99", "max")])


@query("d12_throughput", i.with_inputs("page_state jobs", _REPORT + """,
a AS (SELECT epoch_ms(min(accepted_at)) AS f, epoch_ms(max(finished_at)) AS t, count(finished_at) AS jobs FROM j),
b AS (SELECT count(*) AS pages, quantile_cont(epoch_ms(received_at)::DOUBLE, 0.95) AS p95 FROM p)
SELECT jobs, pages, (t - f) / 1000 AS window_s, round(pages / ((t - f) / 1000), 9) AS pages_per_s, round(jobs / ((t - f) / 1000), 9) AS jobs_per_s, round((p95 - f) / 1000, 3) AS pages_95pct_s,
  round(0.95::DOUBLE * pages / ((p95 - f) / 1000), 9) AS pages_per_s_first_95pct, round((t - f) / 1000 - (p95 - f) / 1000, 3) AS tail_s FROM a, b"""))
def throughput(spark, sf):
    arrived = i.pages(spark, sf).filter("completed_at is not null").select("job_id", F.col("completed_at").alias("received_at"))
    rows = i.line_sizes(spark, sf)[0]
    out = reports.throughput(arrived, _report_jobs(spark, sf), sizes=(rows, rows))
    return out.withColumns({n: F.round(n, 9) for n in ("pages_per_s", "jobs_per_s", "pages_per_s_first_95pct")} | {
        n: F.round(n, 3) for n in ("pages_95pct_s", "tail_s")})


@query("d13_memory_trend", """
WITH s AS (SELECT user_id % 5 AS container, epoch_us(ts) / 60000000.0::DOUBLE - 28400000 AS minute, value AS mib, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, value) - 1 AS rn, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events)
SELECT container, max(mib) AS peak, count(*) AS samples, round(coalesce(regr_slope(mib, minute) FILTER (WHERE rn >= floor(n * 0.25)), 0), 9) AS slope FROM s GROUP BY 1""")
def memory_trend(spark, sf):
    rows = i.table(spark, sf, "events").select((F.col("user_id") % 5).alias("container"), (
        F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000.0 - 28_400_000).alias("minute"), F.col("value").alias("mib"))
    return stats.trend(rows, "container", "minute", "mib").withColumn("slope", F.round("slope", 9))


@query("d18_phase_report", i.with_inputs("calls", """
WITH s AS (SELECT call_id AS sample_no, epoch_us(ts) // 864000000000 % 4 AS phase, ts, latency_s AS rps, call_id % 30 + 1 AS concurrency, retry_after_s / 400 AS p95, (status = 429)::INT AS throttled, latency_s * 40 AS adm FROM calls)
SELECT phase, min(rps) AS min_rps, max(rps) AS max_rps, arg_min(rps, (ts, sample_no)) AS first_rps, arg_max(rps, (ts, sample_no)) AS last_rps, min(concurrency) AS min_concurrency, arg_min(concurrency, (ts, sample_no)) AS first_concurrency,
  max(p95) AS max_p95, sum(throttled)::BIGINT AS throttled, min(adm) AS min_admission_rps, max(rps) > arg_min(rps, (ts, sample_no)) AS rps_rose, sum(throttled) > 0 AS saw_throttling, min(rps) <= arg_min(rps, (ts, sample_no)) / 2 AS rps_halved,
  max(p95) > 6 AS p95_rose, min(concurrency) < arg_min(concurrency, (ts, sample_no)) AS concurrency_cut, arg_max(rps, (ts, sample_no)) > min(rps) AS rps_recovered, min(adm) < 100 AS admission_throttled FROM s GROUP BY 1"""))
def phase_report(spark, sf):
    call = i.calls(spark, sf)
    phase = F.floor(F.unix_micros("ts") / 864_000_000_000) % 4
    samples = call.select(F.col("call_id").alias("sample_no"), phase.alias("phase"), "ts", F.col("latency_s").alias("rps"), (F.col("call_id") % 30 + 1).alias("concurrency"),
                          (F.col("retry_after_s") / 400).alias("p95"), F.coalesce((F.col("status") == 429).cast("int"), F.lit(None)).alias("throttled"),
                          (F.col("latency_s") * 40).alias("admission_rps"))
    return reports.phase_report(samples)


# --- histograms, counters, gauges -------------------------------------------------------------------

_EDGES = ", ".join(str(e) for e in c.LATENCY_EDGES)
_HISTOGRAM = f"""
h AS (SELECT model, e.le, count(*) FILTER (WHERE le IS NULL OR latency_s <= le) AS cumulative FROM calls, (SELECT unnest([{_EDGES}, NULL]::DOUBLE[]) AS le) e WHERE NOT timed_out GROUP BY ALL)"""


def _latency_histogram(spark, sf):
    return stats.fixed_histogram(i.calls(spark, sf).filter("not timed_out"), ["model"], "latency_s", c.LATENCY_EDGES)


@query("d14_latency_histogram", i.with_inputs("calls", "WITH " + _HISTOGRAM.strip() + "\nSELECT * FROM h"))
def latency_histogram(spark, sf):
    return _latency_histogram(spark, sf)


@query("d14_evaluation_histogram", i.with_inputs("outcomes", f"""
SELECT outcome, e.le, count(*) FILTER (WHERE le IS NULL OR latency_s <= le) AS cumulative FROM outcomes, (SELECT unnest([{", ".join(str(e) for e in c.EVALUATION_EDGES)}, NULL]::DOUBLE[]) AS le) e WHERE NOT timed_out GROUP BY ALL"""))
def evaluation_histogram(spark, sf):
    """The finer edges of evaluation requests, here over calls by outcome."""
    return stats.fixed_histogram(call_ops.with_outcome(i.calls(spark, sf)).filter("not timed_out"), ["outcome"], "latency_s", c.EVALUATION_EDGES)


_WAITS = ", ".join(str(e) for e in c.PAGE_EDGES)


@query("d14_page_histogram", i.with_inputs("page_state", f"""
SELECT source, e.le, count(*) FILTER (WHERE le IS NULL OR s <= le) AS cumulative FROM (SELECT source, epoch_us(completed_at - created_at) / 1000000.0::DOUBLE AS s FROM page_state WHERE completed_at IS NOT NULL), (SELECT unnest([{_WAITS}, NULL]::DOUBLE[]) AS le) e GROUP BY ALL"""))
def page_histogram(spark, sf):
    done = i.pages(spark, sf).filter("completed_at is not null").withColumn("s", shaping.seconds_between(F.col("created_at"), F.col("completed_at")))
    return stats.fixed_histogram(done, ["source"], "s", c.PAGE_EDGES)


@query("d15_histogram_quantile", i.with_inputs("calls", "WITH " + _HISTOGRAM.strip() + """,
b AS (SELECT *, coalesce(le, 'inf'::DOUBLE) AS u, coalesce(lag(cumulative) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0) AS low, max(cumulative) OVER (PARTITION BY model) AS n, max(le) OVER (PARTITION BY model) AS top FROM h WINDOW w AS (PARTITION BY model ORDER BY coalesce(le, 'inf'::DOUBLE)))
SELECT model, round(CASE WHEN le IS NULL THEN top ELSE low + (le - low) * (0.95::DOUBLE * n - before) / (cumulative - before) END, 6) AS quantile FROM b WHERE cumulative >= 0.95::DOUBLE * n AND before < 0.95::DOUBLE * n"""))
def histogram_quantile(spark, sf):
    return stats.histogram_quantile(_latency_histogram(spark, sf), ["model"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("d16_counter_increase", i.with_inputs("samples", f"""
SELECT metric, epoch_us(ts) // {W * 1_000_000} * {W} AS window_start, sum(CASE WHEN last IS NULL THEN 0 WHEN counter < last THEN counter ELSE counter - last END)::DOUBLE AS increase,
  round(sum(CASE WHEN last IS NULL THEN 0 WHEN counter < last THEN counter ELSE counter - last END)::DOUBLE / {W}, 9) AS rate
FROM (SELECT *, lag(counter) OVER (PARTITION BY metric, instance ORDER BY ts, event_id) AS last FROM samples) GROUP BY 1, 2"""))
def counter_increase(spark, sf):
    samples = i.samples(spark, sf).withColumn("value", F.col("counter").cast("double"))
    return stats.counter_increase(samples, ["metric", "instance"], W, ["metric"], sizes=i.call_sizes(spark, sf)).withColumn("rate", F.round("rate", 9))


@query("d17_latest_gauge", i.with_inputs("samples", """
SELECT metric, max(v) AS value FROM (SELECT metric, instance, arg_max(gauge, (ts, gauge)) AS v FROM samples GROUP BY ALL) GROUP BY 1"""))
def latest_gauge(spark, sf):
    return stats.latest_gauge(i.samples(spark, sf).select("metric", "instance", "ts", F.col("gauge").alias("value")), ["instance"], ["metric"])


@query("s13_metric_samples", i.with_inputs("samples", """
SELECT metric, instance::VARCHAR AS instance, epoch_us(ts) AS at_us, counter::DOUBLE AS value FROM samples"""))
def metric_samples(spark, sf):
    """Samples through the metric table's own files."""
    from quireflow.session import scratch_path
    from quireflow.sources import logs

    path = scratch_path(spark, "metrics")
    i.samples(spark, sf).select("ts", F.col("instance").cast("string").alias("instance"), "metric", F.create_map(F.lit("source"), F.lit("events")).alias("labels"),
                                F.col("counter").cast("double").alias("value")).write.parquet(path)
    return logs.read_metrics(spark, path).select("metric", "instance", F.unix_micros("ts").alias("at_us"), "value")


# --- page results -----------------------------------------------------------------------------------

def _blocks(spark, sf):
    """Blocks of each order in parts of at most a hundred lines."""
    line = i.lines(spark, sf).join(i.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    bbox = F.struct((F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 7 * 20.0).alias("y"), (50.0 + F.col("l_quantity")).alias("w"), F.lit(15.0).alias("h"))
    block = F.struct(F.lit("paragraph").alias("type"), F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("text"), bbox.alias("bbox"),
                     F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("order"), F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice") / 120_000).alias("confidence"))
    listed = F.array_sort(F.collect_list(F.struct("page_idx", block.alias("b"))))
    return line.groupBy("job_id", F.floor(F.col("page_idx") / 100).cast("int").alias("part")).agg(F.transform(listed, lambda z: z["b"]).alias("blocks"))


_BLOCKS = """
b AS (SELECT job_id, page_idx // 100 AS part, page_idx, CASE WHEN l_returnflag <> 'R' THEN p_name END AS text, CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END AS o, (l_suppkey % 7 * 20)::DOUBLE AS y, (l_partkey % 100)::DOUBLE AS x,
  CASE WHEN l_tax < 0.07 THEN l_extendedprice / 120000 END AS confidence FROM lines LEFT JOIN part ON p_partkey = l_partkey)"""


@query("o2_block_order", i.with_inputs("lines", "WITH " + _BLOCKS.strip() + """
SELECT job_id, part, string_agg(x::INT || '/' || y::INT, ' ' ORDER BY o, y, x, page_idx) AS places FROM b GROUP BY ALL"""))
def block_order(spark, sf):
    at = lambda b: F.concat_ws("/", b["bbox"]["x"].cast("int").cast("string"), b["bbox"]["y"].cast("int").cast("string"))
    return _blocks(spark, sf).select("job_id", "part", F.array_join(F.transform(shaping.ordered_blocks(F.col("blocks")), at), " ").alias("places"))


@query("f5_page_text", i.with_inputs("lines", "WITH " + _BLOCKS.strip() + """
SELECT job_id, part, string_agg(coalesce(text, ''), chr(10) ORDER BY o, y, x, page_idx) AS text FROM b GROUP BY ALL"""))
def page_text(spark, sf):
    return _blocks(spark, sf).select("job_id", "part", shaping.page_text(shaping.ordered_blocks(F.col("blocks"))).alias("text"))


@query("f6_vlm_results", i.with_inputs("lines", "WITH " + _BLOCKS.strip() + """
SELECT job_id, part, 'vlm' AS source, CASE WHEN job_id % 3 = 0 THEN 0.5 ELSE 0.9 END AS confidence, false AS low_confidence, count(*) AS blocks, CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END AS tables, CASE WHEN job_id % 5 = 0 THEN 'job=' || job_id ELSE '' END AS pairs,
  md5(string_agg(coalesce(text, ''), chr(10) ORDER BY o, y, x, page_idx)) AS text_md5 FROM b GROUP BY ALL"""))
def vlm_results(spark, sf):
    job = F.col("job_id")
    tables = F.when(job % 2 == 0, F.array(F.lit("| a | b |")))
    pairs = F.from_json(F.when(job % 5 == 0, F.to_json(F.create_map(F.lit("job"), job.cast("string")))), "map<string,string>")
    r = _blocks(spark, sf).select("job_id", "part", shaping.vlm_result(F.col("part"), F.col("blocks"), F.when(job % 3 == 0, F.lit(0.5)), tables, pairs).alias("r"))
    shown = F.array_join(F.transform(F.map_entries("r.key_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select("job_id", "part", "r.source", "r.confidence", "r.low_confidence", F.size("r.blocks").alias("blocks"), F.size("r.tables_markdown").alias("tables"), shown.alias("pairs"), F.md5("r.text").alias("text_md5"))


@query("f6_result_trees", i.with_inputs("lines", "WITH " + _BLOCKS.strip() + """,
n AS (
  SELECT job_id, -1 AS part, -1 AS rank, 'document' AS type, NULL AS text, NULL::DOUBLE AS x, NULL::DOUBLE AS w, NULL::INT AS ord FROM b GROUP BY 1
  UNION ALL SELECT job_id, part, -1, 'page', NULL, 0, 0, part FROM b GROUP BY 1, 2
  UNION ALL SELECT job_id, part, row_number() OVER (PARTITION BY job_id, part ORDER BY o, y, x, page_idx) - 1, 'paragraph', text, x, NULL, NULLIF(o, 0) FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY part, rank) - 1 AS node_id FROM n)
SELECT job_id AS pair_id, node_id, CASE WHEN type = 'page' THEN 0 WHEN type = 'paragraph' THEN first_value(node_id) OVER (PARTITION BY job_id, part ORDER BY rank) END AS parent_id,
  CASE WHEN type = 'page' THEN part WHEN type = 'paragraph' THEN rank ELSE 0 END AS list_pos, type, text, x, ord FROM p"""))
def result_trees(spark, sf):
    """Page results as document trees, through JSON, back as the nodes that the evaluation takes."""
    from quireflow.sources import trees

    none = F.lit(None).cast("string")
    results = _blocks(spark, sf).select("job_id", F.col("part").alias("page_index"), shaping.fallback_result(F.col("part"), F.col("blocks"), none)["tree"].alias("tree"))
    documents = trees.document_trees(results).select(F.col("job_id").alias("pair_id"), F.lit("truth").alias("side"), "tree")
    return trees.nodes_of(documents).select("pair_id", "node_id", "parent_id", "list_pos", "type", "text", "x", "ord")


@query("f7_fallback_results", i.with_inputs("lines", "WITH " + _BLOCKS.strip() + """
SELECT job_id, part, 'layout_fallback' AS source, true AS low_confidence, round(CASE WHEN count(confidence) = 0 THEN 0.2 ELSE least(0.49, round_even(sum(confidence ORDER BY page_idx) / count(confidence) * 0.6::DOUBLE, 3)) END, 3) AS confidence FROM b GROUP BY ALL"""))
def fallback_results(spark, sf):
    r = _blocks(spark, sf).select("job_id", "part", shaping.fallback_result(F.col("part"), F.col("blocks"), F.lit("3 attempts failed")).alias("r"))
    return r.select("job_id", "part", "r.source", "r.low_confidence", F.round("r.confidence", 3).alias("confidence"))


@query("f8_failed_results", i.with_inputs("page_state", """
SELECT job_id, page_idx, 'none' AS source, 0.0 AS confidence, true AS low_confidence, 0 AS blocks, 'bad input' AS error FROM page_state WHERE source = 'none'"""))
def failed_results(spark, sf):
    failed = i.pages(spark, sf).filter("source = 'none'").select("job_id", "page_idx", shaping.failed_result(F.col("page_idx"), F.lit("bad input")).alias("r"))
    return failed.select("job_id", "page_idx", "r.source", "r.confidence", "r.low_confidence", F.size("r.blocks").alias("blocks"), "r.error")
