"""Queries over the ordered event stream of every job."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.functions import shaping
from quireflow.operators import ordered, scan
from quireflow.plans import inputs as i
from quireflow.plans.registry import query
from quireflow.session import scratch_path, written
from quireflow.sources import event_log, logs, stores


@query("e1_job_sequence", i.with_inputs("stream_events", "SELECT job_id, seq, kind, page_idx FROM stream_events"))
def job_sequence(spark, sf):
    return i.stream_events(spark, sf).select("job_id", "seq", "kind", "page_idx")


@query("e2_gaps_and_duplicates", i.with_inputs("frames", """
SELECT job_id, arrival, seq, seq <= coalesce(last, 0) AS duplicate, seq > coalesce(last, 0) + 1 AS gap FROM (
  SELECT *, max(seq) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM frames WHERE NOT (copy = 0 AND coalesce(l_quantity, 0) > 48))"""))
def gaps_and_duplicates(spark, sf):
    # The first copy of the largest pages got lost on the way.
    frames = i.frames(spark, sf).filter(~((F.col("copy") == 0) & (F.coalesce("l_quantity", F.lit(0.0)) > 48)))
    return ordered.audit_arrivals(frames, sizes=i.line_sizes(spark, sf, 6)).select("job_id", "arrival", "seq", "duplicate", "gap")


# For every event: how many leading pages have been emitted by then, counted directly.
_WATERMARK = """
wm AS (SELECT e.job_id, e.seq, e.kind, e.page_idx, e.total_pages, e.moment, coalesce((
    SELECT min(g) FROM (SELECT unnest(range(e.total_pages + 1)) AS g) x
    WHERE NOT list_contains(e.done, g::INT)), e.total_pages) AS page_watermark, e.done
  FROM (SELECT *, coalesce(list(page_idx) FILTER (WHERE page_idx IS NOT NULL) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING), []) AS done FROM stream_events) e)"""
_BITS = _WATERMARK + """,
bits AS (SELECT *, list_sum(list_transform(list_filter(list_distinct(done), lambda p: p >= page_watermark AND p < page_watermark + 64),
    lambda p: (1::HUGEINT << (p - page_watermark)))) AS b FROM wm)"""
# Eight bytes, lowest first.
_BITMAP = """to_base64(unhex(array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda k: substr(lpad(printf('%x', coalesce(b, 0)::UBIGINT), 16, '0'), k * 2 + 1, 2)), '')))"""


@query("e3_page_watermark", i.with_inputs("stream_events", "WITH " + _WATERMARK.strip() + "\nSELECT job_id, seq, page_watermark FROM wm"))
def page_watermark(spark, sf):
    sizes = i.line_sizes(spark, sf, 3)
    return ordered.with_watermark(i.stream_events(spark, sf), sizes=sizes).select("job_id", "seq", "page_watermark")


@query("e4_window_bitmap", i.with_inputs("stream_events", "WITH " + _BITS.strip() + f"\nSELECT job_id, seq, {_BITMAP} AS bitmap FROM bits"))
def window_bitmap(spark, sf):
    sizes = i.line_sizes(spark, sf, 3)
    full = ordered.with_window_bits(ordered.with_watermark(i.stream_events(spark, sf), sizes=sizes), sizes=sizes)
    return full.select("job_id", "seq", shaping.bits_to_base64(F.col("window_bits")).alias("bitmap"))


@query("e4_decoded_bitmap", i.with_inputs("stream_events", "WITH " + _WATERMARK.strip() + """
SELECT job_id, seq, array_to_string(list_sort(list_filter(list_distinct(done), lambda p: p >= page_watermark AND p < page_watermark + 64)), ',') AS pages FROM wm"""))
def decoded_bitmap(spark, sf):
    sizes = i.line_sizes(spark, sf, 3)
    full = ordered.with_window_bits(ordered.with_watermark(i.stream_events(spark, sf), sizes=sizes), sizes=sizes)
    pages = shaping.base64_to_pages(shaping.bits_to_base64(F.col("window_bits")), F.col("page_watermark"))
    return full.select("job_id", "seq", F.array_join(pages, ",").alias("pages"))


@query("f9_frame_headers", i.with_inputs("stream_events jobs", "WITH " + _BITS.strip() + f"""
SELECT e.job_id, e.seq, '{{"job_id":"' || e.job_id || '","client_id":"' || client_id || '",' || CASE WHEN request_id IS NULL THEN '' ELSE '"request_id":"' || request_id || '",' END
  || '"seq":' || e.seq || CASE WHEN page_idx IS NULL THEN '' ELSE ',"page_index":' || page_idx END || ',"total_pages":' || e.total_pages || ',"watermark":' || page_watermark
  || ',"window":{{"base":' || page_watermark || ',"size":64,"bitmap":"' || {_BITMAP} || '"}},"emitted_at":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '"}}' AS header
FROM bits e JOIN jobs USING (job_id)"""))
def frame_headers(spark, sf):
    full = ordered.framed(i.stream_events(spark, sf), i.jobs(spark, sf), F.col("at"), sizes=i.line_sizes(spark, sf, 3))
    return full.select("job_id", "seq", F.to_json("header").alias("header"))


# A literal reorder buffer: what has arrived and what has been emitted, per unique frame.
_ASSEMBLY = _WATERMARK + """,
before AS (SELECT *, coalesce(lag(page_watermark) OVER (PARTITION BY job_id ORDER BY seq), 0) AS prior FROM wm)
"""


@query("e5_reassembly", i.with_inputs("frames", "WITH " + _ASSEMBLY.strip() + """
SELECT job_id, count(page_idx) AS pages, count(*) FILTER (WHERE page_idx <> prior) AS out_of_order, coalesce(max(CASE WHEN page_idx IS NOT NULL THEN len(done) - prior END), 0) AS max_buffered,
  max(page_watermark) AS emitted, bool_or(kind = 'job_complete') AS complete, bool_or(kind = 'job_failed') AS failed, any_value(d) AS duplicates
FROM before JOIN (SELECT job_id, count(*) FILTER (WHERE dup) AS d FROM (
  SELECT job_id, seq <= coalesce(max(seq) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dup FROM frames) GROUP BY 1) USING (job_id) GROUP BY 1"""))
def reassembly(spark, sf):
    return ordered.reassembly(i.frames(spark, sf), sizes=i.line_sizes(spark, sf, 6))


@query("e5_flush_points", i.with_inputs("stream_events", """
WITH p AS (SELECT job_id, page_idx, seq AS first_seq FROM stream_events WHERE page_idx IS NOT NULL),
r AS (SELECT *, max(first_seq) OVER w AS flush_seq, row_number() OVER w - 1 AS rn FROM p WINDOW w AS (PARTITION BY job_id ORDER BY page_idx ROWS UNBOUNDED PRECEDING))
SELECT job_id, page_idx, first_seq, flush_seq FROM r WHERE rn = page_idx"""))
def flush_points(spark, sf):
    return ordered.flush_points(i.stream_events(spark, sf), sizes=i.line_sizes(spark, sf, 3))


# --- reading and rendering ---------------------------------------------------------------------------

def _requests(spark, sf):
    price = F.col("o_totalprice")
    header = F.when(price < 100_000, F.concat(F.lit(" "), (F.col("o_custkey") % 4).cast("string"), F.lit(" "))).when(price < 150_000, "latest")
    return i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), header.alias("header"),
                                               F.when(price > 120_000, F.col("o_custkey") % 3).alias("query"))


_CURSORS = """c AS (SELECT o_orderkey AS job_id, coalesce(CASE WHEN o_totalprice < 100000 THEN o_custkey % 4 END, CASE WHEN o_totalprice > 120000 THEN o_custkey % 3 END, 0) AS after_seq FROM orders)"""


@query("s3_resume_cursors", f"WITH {_CURSORS} SELECT job_id, after_seq FROM c")
def resume_cursors(spark, sf):
    return event_log.resume_cursors(_requests(spark, sf)).select("job_id", "after_seq")


@query("s2_events_after", i.with_inputs("stream_events", f"""
WITH {_CURSORS} SELECT job_id, seq, kind FROM (SELECT e.*, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM stream_events e JOIN c USING (job_id) WHERE seq > after_seq) WHERE rn <= 64"""))
def events_after(spark, sf):
    cursors = event_log.resume_cursors(_requests(spark, sf)).select("job_id", "after_seq")
    return event_log.events_after_cursors(i.stream_events(spark, sf), cursors, sizes=i.line_sizes(spark, sf, 3)).select("job_id", "seq", "kind")


_AFTER_END = """tail AS (SELECT job_id, seq, kind FROM stream_events UNION ALL SELECT job_id, total_pages + 10, 'page_result' FROM stream_events WHERE kind = 'job_split')"""


@query("s4_until_final", i.with_inputs("stream_events", f"""
WITH {_AFTER_END}, f AS (SELECT job_id, min(seq) AS final FROM tail WHERE kind IN ('job_complete', 'job_failed') GROUP BY 1)
SELECT job_id, seq, kind FROM tail LEFT JOIN f USING (job_id) WHERE final IS NULL OR seq <= final"""))
def until_final(spark, sf):
    events = i.stream_events(spark, sf)
    # One stray event per job that may come after its end.
    stray = events.filter("kind = 'job_split'").select("job_id", (F.col("total_pages") + 10).cast("long").alias("seq"), F.lit("page_result").alias("kind"))
    return event_log.until_final(events.select("job_id", "seq", "kind").unionByName(stray))


_SSE = """'id: ' || seq || chr(10) || 'event: ' || kind || chr(10) || 'data: {"seq":' || seq || CASE WHEN page_idx IS NULL THEN '' ELSE ',"page_index":' || page_idx END || '}' || chr(10) || chr(10)"""


@query("s10_event_text", i.with_inputs("stream_events", f"SELECT job_id, seq, {_SSE} AS sse FROM stream_events"))
def event_text(spark, sf):
    envelope = F.to_json(F.struct("seq", F.col("page_idx").alias("page_index")))
    return event_log.as_sse(i.stream_events(spark, sf), envelope)


@query("s11_parsed_event_text", i.with_inputs("stream_events", """
SELECT job_id, seq::VARCHAR AS id, kind AS event, '{"seq":' || seq || CASE WHEN page_idx IS NULL THEN '' ELSE ',"page_index":' || page_idx END || '}' || chr(10) || 'end' AS data FROM stream_events"""))
def parsed_event_text(spark, sf):
    # Captured records start with a comment and end with a second data line.
    captured = event_text(spark, sf).withColumn("record", F.concat(F.lit(": ping\n"), F.regexp_replace("sse", "\n\n$", "\ndata:end")))
    return event_log.parse_sse(captured, "record").select("job_id", "id", "event", "data")


@query("s11_captured_files", i.with_inputs("stream_events", """
SELECT seq::VARCHAR AS id, kind AS event, '{"seq":' || seq || CASE WHEN page_idx IS NULL THEN '' ELSE ',"page_index":' || page_idx END || '}' AS data FROM stream_events"""))
def captured_files(spark, sf):
    """Captures as files, those of odd jobs with CRLF, read back as records."""
    text = written(event_text(spark, sf).select("job_id", F.regexp_replace("sse", "\n\n$", "").alias("value")))  # read for each form
    out = None
    for name, odd, end in (("lf", 0, "\n"), ("crlf", 1, "\r\n")):
        path = scratch_path(spark, f"captures-{name}")
        text.filter(F.col("job_id") % 2 == odd).select(F.replace("value", F.lit("\n"), F.lit(end)).alias("value")).write.option("lineSep", end * 2).text(path)
        found = event_log.read_sse(spark, path)
        out = found if out is None else out.unionByName(found)
    return out


@query("s5_frame_archive", i.with_inputs("frames", """
SELECT job_id, arrival, '{"received_at":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '","id":' || seq || ',"event":"' || kind || '"}' AS line FROM frames"""))
def frame_archive(spark, sf):
    frames = i.frames(spark, sf)
    path = scratch_path(spark, "archive")
    stores.write_archive(frames.select(shaping.iso_utc(F.col("at")).alias("received_at"), F.col("seq").alias("id"), F.col("kind").alias("event"), "job_id", "arrival"), path)
    parsed = spark.read.text(path).select("value", F.from_json("value", "job_id bigint, arrival bigint").alias("k"))
    return parsed.select("k.job_id", "k.arrival", F.concat(F.substring_index("value", ',"job_id"', 1), F.lit("}")).alias("line"))


@query("f10_envelope_fields", """
SELECT event_id, (props->>'k')::INT AS k, '{"source":"' || event_type || '"}' AS payload, event_type AS source FROM events""")
def envelope_fields(spark, sf):
    event = i.table(spark, sf, "events")
    envelope = F.to_json(F.struct(F.struct(F.col("event_type").alias("source")).alias("payload")))
    raw = event.select("event_id", "props", envelope.alias("envelope"))
    return raw.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                      F.get_json_object("envelope", "$.payload").alias("payload"),
                      F.get_json_object("envelope", "$.payload.source").alias("source"))


@query("f10_variant_fields", """
SELECT event_id, event_type AS kind, CASE WHEN event_type IN ('view', 'click') THEN value END AS seconds, CASE WHEN event_type = 'purchase' THEN (props->>'k')::BIGINT END AS items,
  CASE WHEN event_type IN ('signup', 'error') THEN props END AS detail, CASE WHEN event_type IN ('view', 'click') THEN user_id END AS page FROM events""")
def variant_fields(spark, sf):
    """Envelopes whose payloads differ by kind, kept as VARIANT in a file and given a schema on reading."""
    event = i.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    of = lambda *fields: F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(*fields).alias("payload")))
    text = F.when(F.col("event_type").isin("view", "click"), of(F.col("value").alias("took"), F.struct(F.col("user_id").alias("page")).alias("at"))) \
        .when(F.col("event_type") == "purchase", of(F.col("k").alias("took"), F.array("k", "user_id").alias("at"))).otherwise(of(F.col("props").alias("took")))
    path = scratch_path(spark, "envelopes")
    event.select("event_id", F.parse_json(text).alias("envelope")).write.parquet(path)
    read = spark.read.parquet(path)
    field = lambda where, kind: shaping.envelope_field(F.col("envelope"), where, kind)
    kind = field("$.kind", "string")
    return read.select("event_id", kind.alias("kind"), F.when(kind.isin("view", "click"), field("$.payload.took", "double")).alias("seconds"),
                       F.when(kind == "purchase", field("$.payload.took", "bigint")).alias("items"), F.when(kind.isin("signup", "error"), field("$.payload.took", "string")).alias("detail"),
                       field("$.payload.at.page", "bigint").alias("page"))


@query("s9_document_trace", """
SELECT conv_id AS request_id, turn AS place, role AS logger, md5(text) AS msg_md5, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations""")
def document_trace(spark, sf):
    turn = i.table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.lpad(F.col("turn").cast("string"), 8, "0").alias("ts"), F.lit("INFO").alias("level"), F.col("role").alias("logger"),
                              F.col("text").alias("msg"), F.col("conv_id").cast("string").alias("request_id")))
    path = scratch_path(spark, "logs")
    turn.select(line.alias("value")).write.text(path)
    trace = scan.numbered(logs.document_trace(logs.read_logs(spark, path)), ["request_id"], ["ts"], "rn")
    return trace.select(F.col("request_id").cast("bigint").alias("request_id"), F.col("ts").cast("bigint").alias("place"), "logger", F.md5("msg").alias("msg_md5"), "rn")
