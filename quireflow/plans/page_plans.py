"""Queries over jobs, pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import intake, shaping
from quireflow.operators import folds, pages as ops, stats
from quireflow.plans import inputs as i
from quireflow.plans.registry import query
from quireflow.session import scratch_path
from quireflow.sources import stores, tables

_AS_OF = f"TIMESTAMP '{i.AS_OF}'"


# --- intake -----------------------------------------------------------------------------------

_UPLOADS = """
u AS (SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN NULL WHEN o_totalprice < 4000 THEN 'client ' || o_custkey ELSE 'client-' || o_custkey END AS client_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'application/pdf' WHEN '2-HIGH' THEN ' Image/PNG ; charset=utf-8' WHEN '3-MEDIUM' THEN 'image/tiff'
    WHEN '4-NOT SPECIFIED' THEN 'text/plain' ELSE 'IMAGE/JPEG' END AS raw_type,
  CASE WHEN o_totalprice < 10000 THEN 0 ELSE floor(o_totalprice * 250)::BIGINT END AS bytes,
  floor(o_totalprice / 3000)::INT - 4 AS pages FROM orders)"""


def _uploads(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_custkey").cast("string")
    kind = F.col("o_orderpriority")
    raw = F.when(kind == "1-URGENT", "application/pdf").when(kind == "2-HIGH", " Image/PNG ; charset=utf-8").when(kind == "3-MEDIUM", "image/tiff") \
        .when(kind == "4-NOT SPECIFIED", "text/plain").otherwise("IMAGE/JPEG")
    client = F.when(price < 2000, None).when(price < 4000, F.concat(F.lit("client "), key)).otherwise(F.concat(F.lit("client-"), key))
    return i.table(spark, sf, "orders").select(
        "o_orderkey", client.alias("client_id"), raw.alias("raw_type"),
        F.when(price < 10000, 0).otherwise(F.floor(price * 250)).alias("bytes"), (F.floor(price / 3000).cast("int") - 4).alias("pages"))


@query("p2_upload_admission", f"""
WITH {_UPLOADS}
SELECT o_orderkey, split_part(r, ' ', 1)::INT AS http_status, split_part(r, ' ', 2) AS reason FROM (SELECT *, CASE
  WHEN client_id IS NULL OR NOT regexp_full_match(client_id, '[A-Za-z0-9._-]{{1,64}}') THEN '400 missing_client'
  WHEN lower(trim(split_part(raw_type, ';', 1))) NOT IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff') THEN '415 bad_type'
  WHEN bytes > 104857600 THEN '413 too_large' WHEN bytes = 0 THEN '400 empty' WHEN pages < 1 THEN '422 no_pages'
  WHEN pages > 100 THEN '422 too_many_pages' ELSE '202 accepted' END AS r FROM u)""")
def upload_admission(spark, sf):
    rows = _uploads(spark, sf)
    return rows.withColumn("r", intake.admission(F.col("client_id"), F.col("raw_type"), F.col("bytes"), F.col("bytes"), F.col("pages"))) \
        .select("o_orderkey", "r.http_status", "r.reason")


@query("p3_content_types", f"""
WITH {_UPLOADS} SELECT lower(trim(split_part(raw_type, ';', 1))) AS content_type, count(*) AS n FROM u GROUP BY 1""")
def content_types(spark, sf):
    return _uploads(spark, sf).groupBy(intake.content_type(F.col("raw_type")).alias("content_type")).agg(F.count("*").alias("n"))


@query("p4_request_ids", f"""
WITH {_UPLOADS}, q AS (SELECT o_orderkey, client_id, replace(client_id, 'client', 'req:') AS given FROM u)
SELECT o_orderkey, coalesce(regexp_full_match(client_id, '[A-Za-z0-9._-]{{1,64}}'), false) AS valid_client,
  CASE WHEN given IS NOT NULL AND regexp_full_match(given, '[A-Za-z0-9._:-]{{1,128}}') THEN given ELSE md5('upload-' || o_orderkey) END AS request_id FROM q""")
def request_ids(spark, sf):
    given = F.replace(F.col("client_id"), F.lit("client"), F.lit("req:"))
    return _uploads(spark, sf).select(
        "o_orderkey", intake.valid_client(F.col("client_id")).alias("valid_client"),
        intake.request_id(given, F.concat(F.lit("upload-"), F.col("o_orderkey").cast("string"))).alias("request_id"))


@query("p5_visible_jobs", i.with_inputs("jobs", """
SELECT l.l_orderkey AS job_id, count(*) AS readers FROM lineitem l JOIN jobs j ON j.job_id = l.l_orderkey AND j.client_id = 'client-' || (l.l_suppkey * 10 + l.l_linenumber) GROUP BY 1"""))
def visible_jobs(spark, sf):
    callers = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(
        F.lit("client-"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string")).alias("client_id"))
    return ops.visible_to(i.jobs(spark, sf), callers).groupBy("job_id").agg(F.count("*").alias("readers"))


@query("p6_idempotency_keys", i.with_inputs("page_state", """
SELECT job_id, page_idx, sha256(job_id || ':' || page_idx || ':' || CASE stage WHEN 'fast' THEN 'layout' ELSE 'vlm' END || ':v1') AS idem_key FROM page_state"""))
def idempotency_keys(spark, sf):
    model = F.when(F.col("stage") == "fast", "layout").otherwise("vlm")
    return i.pages(spark, sf).select("job_id", "page_idx", intake.idempotency_key(F.col("job_id"), F.col("page_idx"), model).alias("idem_key"))


@query("p7_p11_result_kinds", i.with_inputs("page_state", """
SELECT kind, CASE kind WHEN 'page_failed' THEN 'FAILED' ELSE 'COMPLETED' END AS state, count(*) AS n
FROM (SELECT CASE source WHEN 'none' THEN 'page_failed' WHEN 'vlm' THEN 'page_result' ELSE 'page_fallback' END AS kind FROM page_state WHERE source IS NOT NULL) GROUP BY ALL"""))
def result_kinds(spark, sf):
    kinds = i.pages(spark, sf).filter("source is not null").select(intake.event_kind(F.col("source"), F.col("source") == "none").alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).withColumn("state", intake.result_state(F.col("kind")))


@query("p12_size_strings", """
SELECT p_partkey, p_retailprice * CASE p_size % 7 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1000 WHEN 5 THEN 1000000 ELSE 1000000000 END AS bytes FROM part""")
def size_strings(spark, sf):
    units = F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "kB", "MB", "GB")])
    text = F.concat(F.col("p_retailprice").cast("string"), F.element_at(units, F.col("p_size") % 7 + 1))
    return i.table(spark, sf, "part").select("p_partkey", intake.size_bytes(text).alias("bytes"))


@query("p13_unfinished_pages", i.with_inputs("page_state", """
SELECT job_id, page_idx, status FROM page_state WHERE status NOT IN ('COMPLETED', 'FAILED')"""))
def unfinished_pages(spark, sf):
    return i.pages(spark, sf).filter(intake.unfinished(F.col("status"))).select("job_id", "page_idx", "status")


@query("p14_messages", i.with_inputs("page_state jobs", """
SELECT p.job_id, page_idx, '{"job_id":"' || p.job_id || '","idx":' || page_idx || CASE WHEN request_id IS NULL THEN '' ELSE ',"request_id":"' || request_id || '"' END || '}' AS message
FROM page_state p JOIN jobs USING (job_id)"""))
def messages(spark, sf):
    rows = ops.with_request(i.pages(spark, sf).select("job_id", "page_idx"), i.jobs(spark, sf))
    return rows.select("job_id", "page_idx", intake.message(F.col("job_id"), F.col("page_idx"), F.col("request_id")).alias("message"))


@query("s12_split_documents", """
WITH d AS (SELECT doc_id, source, text, ceil(len(string_split(text, chr(10))) / 20)::INT AS n FROM documents),
p AS (SELECT doc_id, source, text, n, unnest(CASE WHEN text = '' OR n > 100 THEN [NULL] ELSE range(n) END)::INT AS page_idx FROM d)
SELECT doc_id AS job_id, source AS client_id, CASE WHEN text = '' THEN 0 ELSE n END AS total_pages, page_idx,
  CASE WHEN text = '' THEN 'no_pages' WHEN n > 100 THEN 'too_many_pages' END AS refused_reason,
  md5(array_to_string(string_split(text, chr(10))[page_idx * 20 + 1 : page_idx * 20 + 20], chr(10))) AS page_md5,
  CASE WHEN page_idx IS NOT NULL THEN printf('pages/%s/%04d.pdf', doc_id::VARCHAR, page_idx) END AS object_key,
  CASE WHEN page_idx IS NULL THEN 'REJECTED' ELSE 'PENDING' END AS status FROM p""")
def split_documents(spark, sf):
    documents = i.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("client_id"), "text")
    return tables.split_documents(documents).withColumn("page_md5", F.md5("page_text")).drop("page_text")


# --- joins ---------------------------------------------------------------------------------------

_SENT = f"""s AS (SELECT job_id, page_idx, stage, created_at + INTERVAL 1 HOUR AS sent_at FROM page_state WHERE l_tax < 0.05
  UNION ALL SELECT job_id, page_idx, 'fast', created_at + INTERVAL 2 HOUR FROM page_state WHERE l_tax < 0.02)"""


def _sent(page):
    hour = lambda n: F.timestamp_add("HOUR", F.lit(n), "created_at").alias("sent_at")
    return page.filter("l_tax < 0.05").select("job_id", "page_idx", F.col("stage").alias("queue"), hour(1)).unionByName(
        page.filter("l_tax < 0.02").select("job_id", "page_idx", F.lit("fast").alias("queue"), hour(2)))


@query("c1_apply_sent", i.with_inputs("page_state", f"""
WITH {_SENT}, once AS (SELECT job_id, page_idx, stage, max(sent_at) AS sent_at FROM s GROUP BY ALL)
SELECT p.job_id, p.page_idx, CASE WHEN moved THEN upper(stage) || '_QUEUED' ELSE status END AS status,
  epoch_us(CASE WHEN moved THEN sent_at ELSE status_at END) AS status_at_us
FROM (SELECT p.*, sent_at, sent_at IS NOT NULL AND status IN ('PENDING', 'FAST_COMPLETED', 'RETRY_WAIT') AS moved FROM page_state p LEFT JOIN once USING (job_id, page_idx, stage)) p"""))
def apply_sent(spark, sf):
    page = i.pages(spark, sf)
    return ops.apply_sent(page, _sent(page)).select("job_id", "page_idx", "status", F.unix_micros("status_at").alias("status_at_us"))


@query("c2_final_results", i.with_inputs("page_state", """
WITH f AS (SELECT job_id, page_idx, 'layout ' || l_partkey AS result FROM page_state WHERE l_tax < 0.06), v AS (SELECT job_id, page_idx, 'vlm ' || l_partkey AS result FROM page_state WHERE l_discount < 0.05)
SELECT p.job_id, p.page_idx, coalesce(v.result, f.result) AS result, CASE WHEN v.result IS NOT NULL THEN 'vlm' WHEN f.result IS NOT NULL THEN 'layout_fallback' ELSE 'none' END AS source,
  CASE WHEN v.result IS NOT NULL THEN 'page_result' WHEN f.result IS NOT NULL THEN 'page_fallback' ELSE 'page_failed' END AS kind, v.result IS NULL AS low_confidence
FROM page_state p LEFT JOIN f USING (job_id, page_idx) LEFT JOIN v USING (job_id, page_idx)"""))
def final_results(spark, sf):
    page = i.pages(spark, sf)
    part = F.col("l_partkey").cast("string")
    fast = page.filter("l_tax < 0.06").select("job_id", "page_idx", F.concat(F.lit("layout "), part).alias("result"))
    slow = page.filter("l_discount < 0.05").select("job_id", "page_idx", F.concat(F.lit("vlm "), part).alias("result"))
    return ops.final_results(page.select("job_id", "page_idx"), fast, slow)


@query("c3_stale_messages", i.with_inputs("page_state", f"""
WITH {_SENT}, live AS (SELECT job_id, page_idx, stage FROM page_state WHERE status NOT IN ('COMPLETED', 'FAILED'))
SELECT stage, live.job_id IS NOT NULL AS live, count(*) AS n FROM s LEFT JOIN live USING (job_id, page_idx, stage) GROUP BY ALL"""))
def stale_messages(spark, sf):
    page = i.pages(spark, sf)
    kept, dropped = ops.split_messages(_sent(page).withColumnRenamed("queue", "stage"), page)
    both = kept.withColumn("live", F.lit(True)).unionByName(dropped.withColumn("live", F.lit(False)))
    return both.groupBy("stage", "live").agg(F.count("*").alias("n"))


@query("c7_missing_pages", i.with_inputs("jobs page_state", """
SELECT job_id, page_idx FROM (SELECT job_id, unnest(range(total_pages))::INT AS page_idx FROM jobs) ANTI JOIN (SELECT job_id, page_idx FROM page_state WHERE source IS NOT NULL) USING (job_id, page_idx)"""))
def missing_pages(spark, sf):
    return ops.missing_pages(i.jobs(spark, sf), i.pages(spark, sf).filter("source is not null"))


@query("c8_request_audit", i.with_inputs("outbox jobs", """
SELECT queue, count(*) AS n, count(request_id) AS with_request, count(DISTINCT request_id) AS requests FROM outbox JOIN jobs USING (job_id) GROUP BY 1"""))
def request_audit(spark, sf):
    rows = ops.with_request(i.outbox(spark, sf).select("job_id", "queue"), i.jobs(spark, sf))
    return rows.groupBy("queue").agg(F.count("*").alias("n"), F.count("request_id").alias("with_request"),
                                     F.countDistinct("request_id").alias("requests"))


# --- aggregates ------------------------------------------------------------------------------------

@query("d1_status_counts", i.with_inputs("page_state", "SELECT job_id, status, count(*) AS n FROM page_state GROUP BY ALL"))
def status_counts(spark, sf):
    return ops.status_counts(i.pages(spark, sf))


@query("d1_status_maps", i.with_inputs("page_state", """
SELECT job_id, string_agg(status || '=' || n, ',' ORDER BY status) AS states FROM (SELECT job_id, status, count(*) AS n FROM page_state GROUP BY ALL) GROUP BY 1"""))
def status_maps(spark, sf):
    entries = F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return ops.status_maps(i.pages(spark, sf)).select("job_id", F.array_join(entries, ",").alias("states"))


@query("d2_unfinished_ages", i.with_inputs("page_state", f"""
SELECT status, count(*) AS n, epoch_us({_AS_OF} - min(status_at)) / 1000000.0 AS oldest_s FROM page_state WHERE status NOT IN ('COMPLETED', 'FAILED') GROUP BY 1"""))
def unfinished_ages(spark, sf):
    return ops.unfinished_ages(i.pages(spark, sf), i.as_of())


@query("d3_send_backlog", i.with_inputs("outbox", f"""
SELECT count(*) FILTER (WHERE sent_at IS NULL) AS unsent, coalesce(epoch_us({_AS_OF} - min(created_at) FILTER (WHERE sent_at IS NULL)) / 1000000.0, 0) AS oldest_s FROM outbox"""))
def send_backlog(spark, sf):
    return ops.send_backlog(i.outbox(spark, sf), i.as_of())


@query("d3_send_lags", i.with_inputs("outbox", """
SELECT queue, round(quantile_cont(lag, 0.5), 6) AS p50, round(quantile_cont(lag, 0.95), 6) AS p95, round(quantile_cont(lag, 0.99), 6) AS p99
FROM (SELECT queue, epoch_us(sent_at - created_at) / 1000000.0::DOUBLE AS lag FROM outbox WHERE sent_at IS NOT NULL) GROUP BY 1"""))
def send_lags(spark, sf):
    return ops.send_lags(i.outbox(spark, sf)).select("queue", *[F.round(q, 6).alias(q) for q in ("p50", "p95", "p99")])


_LAG_EDGES = ", ".join(str(e) for e in c.SEND_LAG_EDGES)


@query("d14_send_lag_histogram", i.with_inputs("outbox", f"""
SELECT queue, e.le, count(*) FILTER (WHERE le IS NULL OR s <= le) AS cumulative FROM (SELECT queue, epoch_us(sent_at - created_at) / 1000000.0::DOUBLE AS s FROM outbox WHERE sent_at IS NOT NULL), (SELECT unnest([{_LAG_EDGES}, NULL]::DOUBLE[]) AS le) e GROUP BY ALL"""))
def send_lag_histogram(spark, sf):
    sent = i.outbox(spark, sf).filter("sent_at is not null").withColumn("s", shaping.seconds_between(F.col("created_at"), F.col("sent_at")))
    return stats.fixed_histogram(sent, ["queue"], "s", c.SEND_LAG_EDGES)


@query("d7_repeated_lines", """
SELECT l_orderkey AS job_id, l_linenumber AS page_idx, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_lines(spark, sf):
    rows = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_idx"))
    return ops.repeated(rows, ["job_id", "page_idx"])


@query("d8_loss_audit", i.with_inputs("page_state", """
SELECT count(*) AS pages, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status NOT IN ('COMPLETED', 'FAILED')) AS unfinished, count(*) FILTER (WHERE status NOT IN ('COMPLETED', 'FAILED')) = 0 AS all_finished FROM page_state"""))
def loss_audit(spark, sf):
    return ops.loss_audit(i.pages(spark, sf))


@query("d9_job_completion", i.with_inputs("jobs page_state", """
WITH d AS (SELECT job_id, count(*) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS finished, count(*) FILTER (WHERE status = 'FAILED') AS failed_pages, count(*) FILTER (WHERE status = 'COMPLETED') AS completed_pages FROM page_state GROUP BY 1),
e AS (SELECT job_id, string_agg(status || '=' || n, ',' ORDER BY status) AS states FROM (SELECT job_id, status, count(*) AS n FROM page_state GROUP BY ALL) GROUP BY 1)
SELECT job_id, total_pages, coalesce(finished, 0) AS finished, coalesce(failed_pages, 0) AS failed_pages, coalesce(completed_pages, 0) AS completed_pages,
  total_pages > 0 AND coalesce(finished, 0) = total_pages AS complete, total_pages > 0 AND coalesce(finished, 0) = total_pages AND coalesce(failed_pages, 0) > 0 AS partial, states
FROM jobs LEFT JOIN d USING (job_id) LEFT JOIN e USING (job_id)"""))
def job_completion(spark, sf):
    shown = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return ops.completion(i.jobs(spark, sf), i.pages(spark, sf)).withColumn("states", shown)


_SPANS = """
SELECT l.job_id, l.page_idx, l.step, l.status, l.previous, epoch_us(l.moment - l.since) / 1000000.0::DOUBLE AS waited_s, t.b IS NOT NULL AS allowed
FROM (SELECT *, lag(status) OVER w AS previous, lag(moment) OVER w AS since FROM status_log WINDOW w AS (PARTITION BY job_id, page_idx ORDER BY moment, step)) l
LEFT JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in ops.TRANSITIONS) + """) t(a, b) ON t.a = coalesce(l.previous, '') AND t.b = l.status"""


@query("e10_status_spans", i.with_inputs("status_log", _SPANS))
def status_spans(spark, sf):
    return ops.status_spans(i.status_log(spark, sf), sizes=i.line_sizes(spark, sf, 7)).select("job_id", "page_idx", "step", "status", "previous", "waited_s", "allowed")


@query("d19_queue_waits", i.with_inputs("status_log", f"""
SELECT CASE status WHEN 'FAST_PROCESSING' THEN 'fast' ELSE 'slow' END AS stage, round(quantile_cont(waited_s, 0.5), 6) AS p50, round(quantile_cont(waited_s, 0.95), 6) AS p95, max(waited_s) AS longest
FROM ({_SPANS}) WHERE status IN ('FAST_PROCESSING', 'SLOW_PROCESSING') AND waited_s IS NOT NULL GROUP BY 1"""))
def queue_waits(spark, sf):
    return ops.queue_waits(ops.status_spans(i.status_log(spark, sf), sizes=i.line_sizes(spark, sf, 7))).select("stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "longest")


_WAIT_EDGES = ", ".join(str(e) for e in c.WAIT_EDGES)


@query("d14_wait_histogram", i.with_inputs("status_log", f"""
SELECT stage, e.le, count(*) FILTER (WHERE le IS NULL OR s <= le) AS cumulative FROM (
  SELECT CASE status WHEN 'FAST_PROCESSING' THEN 'fast' ELSE 'slow' END AS stage, waited_s AS s FROM ({_SPANS}) WHERE status IN ('FAST_PROCESSING', 'SLOW_PROCESSING') AND waited_s IS NOT NULL),
  (SELECT unnest([{_WAIT_EDGES}, NULL]::DOUBLE[]) AS le) e GROUP BY ALL"""))
def wait_histogram(spark, sf):
    spans = ops.status_spans(i.status_log(spark, sf), sizes=i.line_sizes(spark, sf, 7)).filter("status in ('FAST_PROCESSING', 'SLOW_PROCESSING') and waited_s is not null")
    stage = F.when(F.col("status") == "FAST_PROCESSING", "fast").otherwise("slow")
    return stats.fixed_histogram(spans.withColumn("stage", stage), ["stage"], "waited_s", c.WAIT_EDGES)


@query("d19_page_latencies", i.with_inputs("page_state", """
SELECT source, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, max(s) AS longest
FROM (SELECT source, epoch_us(completed_at - created_at) / 1000000.0::DOUBLE AS s FROM page_state WHERE completed_at IS NOT NULL) GROUP BY 1"""))
def page_latencies(spark, sf):
    return ops.page_latencies(i.pages(spark, sf)).select("source", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "longest")


_PAGE_STEPS = """
WITH s AS (
  SELECT job_id, page_idx, -1 AS step, ''::VARCHAR AS action, 'PENDING' AS status, 'fast' AS st, 0 AS fa, 0 AS sa, false AS has_fast, NULL::VARCHAR AS source, false AS low, 0::BIGINT AS call_id, ''::VARCHAR AS stage FROM deliveries WHERE step = 0
  UNION ALL
  SELECT job_id, page_idx, step, action,
    CASE WHEN action = 'duplicate' THEN status WHEN action = 'fallback' OR (action = 'ok' AND stage = 'slow') THEN 'COMPLETED' WHEN action = 'failed' THEN 'FAILED'
         WHEN action IN ('ok', 'gave_up') THEN 'FAST_COMPLETED' ELSE 'RETRY_WAIT' END,
    CASE WHEN action IN ('ok', 'gave_up') THEN 'slow' ELSE st END, fa + (action = 'failure' AND stage = 'fast')::INT, sa + (action = 'failure' AND stage = 'slow')::INT,
    CASE WHEN stage = 'fast' AND action IN ('ok', 'gave_up') THEN action = 'ok' ELSE has_fast END,
    CASE WHEN action = 'ok' AND stage = 'slow' THEN 'vlm' WHEN action = 'fallback' THEN 'layout_fallback' WHEN action = 'failed' THEN 'none' ELSE source END,
    low OR action IN ('fallback', 'failed'), call_id, stage
  FROM (SELECT *, CASE WHEN a = 'gave_up' AND stage = 'slow' THEN CASE WHEN has_fast THEN 'fallback' ELSE 'failed' END ELSE a END AS action
    FROM (SELECT d.job_id, d.page_idx, d.step, d.stage, d.call_id, s.status, s.st, s.fa, s.sa, s.has_fast, s.source, s.low,
        CASE WHEN d.stage <> s.st OR s.status IN ('COMPLETED', 'FAILED') THEN 'duplicate' WHEN d.delivery > 3 THEN 'gave_up'
          WHEN (CASE d.stage WHEN 'fast' THEN s.fa ELSE s.sa END) > 0 AND NOT d.within_budget THEN 'budget_deferred'
          WHEN d.outcome IN ('ok', 'throttled', 'auth') THEN d.outcome
          WHEN d.outcome = 'retry' THEN CASE WHEN (CASE d.stage WHEN 'fast' THEN s.fa ELSE s.sa END) + 1 >= 3 THEN 'gave_up' ELSE 'failure' END
          WHEN d.stage = 'fast' THEN 'failed' ELSE 'gave_up' END AS a
      FROM s JOIN deliveries d ON d.job_id = s.job_id AND d.page_idx = s.page_idx AND d.step = s.step + 1)))"""


@query("x3_page_replay", i.with_inputs("deliveries", _PAGE_STEPS + """
SELECT job_id, page_idx, step, action, status, st AS page_stage, fa AS fast_attempts, sa AS slow_attempts, has_fast AS has_fast_result, source, low AS low_confidence
FROM s WHERE step >= 0""", recursive=True))
def page_replay(spark, sf):
    return folds.replay_pages(i.deliveries(spark, sf), ["step"]).select(
        "job_id", "page_idx", "step", "action", "status", "page_stage", "fast_attempts", "slow_attempts", "has_fast_result", "source", "low_confidence")


@query("d20_outcome_counts", i.with_inputs("deliveries", _PAGE_STEPS + """
SELECT stage, action, count(*) AS n FROM s WHERE step >= 0 GROUP BY ALL""", recursive=True))
def outcome_counts(spark, sf):
    return ops.outcome_counts(folds.replay_pages(i.deliveries(spark, sf), ["step"]))


@query("x11_late_stage_results", i.with_inputs("deliveries", _PAGE_STEPS + """
SELECT job_id, page_idx, call_id, stage, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN 'page_finished' ELSE 'stage_passed' END AS reason FROM s WHERE action = 'duplicate'""", recursive=True))
def late_stage_results(spark, sf):
    return ops.late_stage_results(folds.replay_pages(i.deliveries(spark, sf), ["step"])).select("job_id", "page_idx", "call_id", "stage", "reason")


# --- message export and documents --------------------------------------------------------------------

@query("s8_send_batches", i.with_inputs("outbox", """
SELECT id, queue, batch, (row_number() OVER (PARTITION BY batch, queue ORDER BY id) - 1) // 10 AS chunk
FROM (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM outbox WHERE sent_at IS NULL)"""))
def send_batches(spark, sf):
    return stores.send_batches(i.outbox(spark, sf)).select("id", "queue", "batch", "chunk")


@query("s8_mark_sent", i.with_inputs("outbox", f"""
WITH next AS (SELECT id FROM outbox WHERE sent_at IS NULL ORDER BY id LIMIT 100)
SELECT o.id, epoch_us(CASE WHEN next.id IS NOT NULL THEN {_AS_OF} ELSE sent_at END) AS sent_us FROM outbox o LEFT JOIN next ON next.id = o.id"""))
def mark_sent(spark, sf):
    rows = i.outbox(spark, sf)
    return stores.mark_sent(rows, stores.oldest_batch(rows), i.as_of()).select("id", F.unix_micros("sent_at").alias("sent_us"))


@query("o3_oldest_batch", i.with_inputs("outbox", "SELECT id, queue FROM outbox WHERE sent_at IS NULL ORDER BY id LIMIT 100"))
def oldest_batch(spark, sf):
    return stores.oldest_batch(i.outbox(spark, sf)).select("id", "queue")


@query("o4_listed_duplicates", """
SELECT l_orderkey AS job_id, l_linenumber AS page_idx, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def listed_duplicates(spark, sf):
    return repeated_lines(spark, sf).orderBy(F.desc("n"), "job_id", "page_idx").limit(c.DUPLICATES_LISTED)


@query("s7_assembled_documents", i.with_inputs("jobs page_state", """
WITH r AS (SELECT job_id, page_idx, 'page ' || l_partkey AS result FROM page_state WHERE source IS NOT NULL),
p AS (SELECT job_id, page_idx // 100 AS part, string_agg(page_idx || ':' || result, '|' ORDER BY page_idx) AS pages FROM r GROUP BY ALL),
m AS (SELECT job_id, any_value(total_pages) AS total_pages, any_value(status) AS status, any_value(total_pages) - count(r.page_idx) AS missing_pages FROM jobs LEFT JOIN r USING (job_id) GROUP BY job_id)
SELECT job_id, total_pages, status, part, pages, missing_pages, status = 'COMPLETE' AND missing_pages = 0 AS complete FROM m LEFT JOIN p USING (job_id)"""))
def assembled_documents(spark, sf):
    results = i.pages(spark, sf).filter("source is not null").select("job_id", "page_idx", F.concat(F.lit("page "), F.col("l_partkey").cast("string")).alias("result"))
    joined = F.array_join(F.transform("pages", lambda p: F.concat(p["page_idx"].cast("string"), F.lit(":"), p["result"])), "|")
    return stores.assembled_documents(i.jobs(spark, sf), results).withColumn("pages", joined)


@query("s6_result_keys", i.with_inputs("page_state", """
SELECT job_id, page_idx, printf('results/%s/pages/%04d/%s.json', job_id::VARCHAR, page_idx, CASE WHEN source IS NULL THEN 'fast' ELSE 'final' END) AS key FROM page_state"""))
def result_keys(spark, sf):
    rows = i.pages(spark, sf).withColumn("name", F.when(F.col("source").isNull(), "fast").otherwise("final"))
    return stores.keyed_results(rows).select("job_id", "page_idx", "key")


@query("s6_result_store", i.with_inputs("page_state", "SELECT job_id, page_idx, source, year(created_at)::INT AS year FROM page_state WHERE source IS NOT NULL"))
def result_store(spark, sf):
    """Results written twice by year: the second time replaces the first."""
    rows = i.pages(spark, sf).filter("source is not null").select("job_id", "page_idx", "source", F.year("created_at").alias("year"))
    path = scratch_path(spark, "results")
    for _ in range(2):
        stores.write_results(rows, path, "year")
    return spark.read.schema(rows.schema).parquet(path).select("job_id", "page_idx", "source", "year")


@query("o1_document_order", i.with_inputs("page_state", """
SELECT job_id, page_idx, source, row_number() OVER (ORDER BY job_id, page_idx) AS place FROM page_state WHERE source IS NOT NULL"""))
def document_order(spark, sf):
    from quireflow.operators import scan

    rows = i.pages(spark, sf).filter("source is not null").select("job_id", "page_idx", "source", F.lit(0).alias("_all"))
    return scan.numbered(rows, ["_all"], ["job_id", "page_idx"], "place").drop("_all").orderBy("job_id", "page_idx")


@query("f11_iso_times", i.with_inputs("page_state", """
SELECT job_id, page_idx, strftime(status_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS status_iso, epoch_us(status_at - created_at) / 1000000.0::DOUBLE AS age_s FROM page_state"""))
def iso_times(spark, sf):
    return i.pages(spark, sf).select("job_id", "page_idx", shaping.iso_utc(F.col("status_at")).alias("status_iso"),
                                     shaping.seconds_between(F.col("created_at"), F.col("status_at")).alias("age_s"))
