"""Inputs of the registered queries, derived from the given tables, and the same in SQL.

``SQL`` holds one common table expression per input for the oracle; ``with_inputs`` puts those a
query needs (and what they need in turn) in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import intake
from quireflow.operators import ordered, scan

WINDOW_S = 21_600  # call windows of six hours: the call log covers thirty days
AS_OF = "2002-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


SQL: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def _sql(name: str, body: str, *needs: str) -> None:
    SQL[name], _NEEDS[name] = body, needs


def with_inputs(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the common table expressions it needs."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in chosen:
            chosen.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    joined = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in chosen)
    more = body[5:] if body[:5].upper() == "WITH " else None
    if more is not None:
        return f"WITH {'RECURSIVE ' if recursive else ''}{joined},\n{more}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}\n{body}"


# --- model calls ------------------------------------------------------------------------------

def calls_of(events: DataFrame) -> DataFrame:
    """Model calls told from user events (works on a stream as well)."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.when(kind == "purchase", 429).when(kind == "signup", 503) \
        .when((kind == "click") & (value > 200), 401).when((kind == "view") & (value > 200), 400) \
        .when(kind.isin("view", "click"), 200)
    return events.select(
        F.col("event_id").alias("call_id"), F.when(F.col("user_id") % 2 == 0, "layout").otherwise("vlm").alias("model"),
        F.col("ts").cast("timestamp").alias("ts"), status.alias("status"),
        ((kind == "error") & (value >= 5)).alias("timed_out"), (value / 50).alias("latency_s"),
        (F.col("event_id") % 5 == 0).alias("is_retry"), ((kind == "view") & (value < 2)).alias("replay"),
        (value * 10).alias("retry_after_s"), F.col("user_id").alias("user_id"))


def calls(spark, sf_dir) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


_sql("calls", """
SELECT event_id AS call_id, CASE WHEN user_id % 2 = 0 THEN 'layout' ELSE 'vlm' END AS model, ts::TIMESTAMP AS ts,
  CASE WHEN event_type = 'purchase' THEN 429 WHEN event_type = 'signup' THEN 503
       WHEN event_type = 'click' AND value > 200 THEN 401 WHEN event_type = 'view' AND value > 200 THEN 400
       WHEN event_type IN ('view', 'click') THEN 200 END AS status,
  event_type = 'error' AND value >= 5 AS timed_out, value / 50 AS latency_s, event_id % 5 = 0 AS is_retry,
  event_type = 'view' AND value < 2 AS replay, value * 10 AS retry_after_s, user_id
FROM events""")

_sql("outcomes", """
SELECT *, CASE WHEN timed_out OR status IS NULL OR status = 408 OR status >= 500 THEN 'retry' WHEN status < 300 THEN 'ok'
  WHEN status = 429 THEN 'throttled' WHEN status IN (401, 403) THEN 'auth' ELSE 'permanent' END AS outcome
FROM calls""", "calls")

_sql("limits", """
SELECT * FROM (VALUES ('layout', 'fast', 100.0::DOUBLE, 80.0::DOUBLE, 5, 10, 0.05::DOUBLE, 0.02::DOUBLE),
                      ('vlm', 'slow', 10.0::DOUBLE, 8.0::DOUBLE, 20, 30, 3.0::DOUBLE, 0.05::DOUBLE))
  AS t(model, stage, hard_rps, start_rps, start_concurrency, max_concurrency, nominal_latency_s, normal_error_rate)""")

_sql("windows", f"""
SELECT model, epoch_us(ts) // {WINDOW_S * 1_000_000} AS win, count(*) AS calls,
  count(*) FILTER (WHERE NOT is_retry) AS first_calls, count(*) FILTER (WHERE outcome = 'throttled') AS throttled,
  count(*) FILTER (WHERE timed_out) AS timeouts, count(*) FILTER (WHERE NOT timed_out AND status >= 500) AS server_errors,
  count(*) FILTER (WHERE NOT timed_out) AS latencies,
  coalesce(quantile_disc(latency_s, 0.95) FILTER (WHERE NOT timed_out), 0) AS p95
FROM outcomes WHERE NOT replay GROUP BY ALL""", "outcomes")

_sql("judged", """
SELECT w.*, CASE
    WHEN calls < 10 AND throttled > 0 THEN 'overload'
    WHEN calls < 10 AND timeouts = 0 AND server_errors = 0 AND NOT slow THEN 'healthy'
    WHEN calls < 10 THEN 'unknown'
    WHEN slow OR throttled / calls >= 0.01 OR timeouts / calls >= 0.05 OR server_errors / calls > 2 * normal_error_rate THEN 'overload'
    ELSE 'healthy' END AS verdict
FROM (SELECT w.*, l.normal_error_rate, latencies > 0 AND p95 > 2 * l.nominal_latency_s AS slow FROM windows w JOIN limits l USING (model)) w""",
     "windows", "limits")


# --- jobs, pages, messages ---------------------------------------------------------------------

_PAGE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
               "l_tax", "l_returnflag", "l_linestatus"]


def line_sizes(spark, sf_dir, times: int = 1) -> tuple[int, int]:
    """(rows, rows of the largest order), from one column of the raw table; an upper bound for
    everything with at most ``times`` rows per line."""
    rows, largest = _measured(spark, sf_dir, "lineitem", F.col("l_orderkey"))
    return rows * times, largest * times


def _measured(spark, sf_dir, name: str, key) -> tuple[int, int]:
    """Rows and rows of the largest key of a raw table, measured once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _SIZES:
        _SIZES[at] = scan.group_stats(table(spark, sf_dir, name).select(key.alias("key")), ["key"])
    return _SIZES[at]


_SIZES: dict[tuple, tuple[int, int]] = {}


def call_sizes(spark, sf_dir, times: int = 1) -> tuple[int, int]:
    """(rows, rows of the larger model) of the call log."""
    rows, largest = _measured(spark, sf_dir, "events", F.col("user_id") % 2)
    return rows * times, largest * times


def lines(spark, sf_dir, looked_up: DataFrame | None = None, group: Column | None = None, most_jobs: int = 1) -> DataFrame:
    """Order lines as the pages of a job, numbered from 0; ``looked_up`` adds columns to the lines of a part (a row per part). ``group``, an
    expression of ``job_id`` with at most ``most_jobs`` of them to a value, comes out as ``group_id``, the lines of a group side by side (``groups_together``)."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job_id") \
        .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    if looked_up is not None:  # ahead of the numbering, which leaves the lines of a job side by side
        items = items.join(looked_up, "l_partkey", "left")
    sizes, keys = line_sizes(spark, sf_dir), ["job_id"]
    if group is not None:
        items, keys = items.withColumn("group_id", group), ["group_id", "job_id"]
    placed = scan.together(items, keys[:1], (sizes[0], sizes[1] * most_jobs))
    return scan.numbered(placed, keys, _PAGE_ORDER, "page_idx", 0, sizes=sizes).withColumn("page_idx", F.col("page_idx").cast("int"))


def groups_together(spark, sf_dir, most_jobs: int) -> bool:
    """Whether ``lines`` leaves the lines of a group side by side in one partition: unless it is too large for a task."""
    return line_sizes(spark, sf_dir)[1] * most_jobs <= scan.MAX_GROUP_ROWS


_sql("lines", f"""
SELECT *, l_orderkey AS job_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_PAGE_ORDER)}) - 1)::INT AS page_idx
FROM lineitem""")


def pages(spark, sf_dir) -> DataFrame:
    """Current state of every page."""
    open_ = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    source = F.when(F.col("l_returnflag") == "N", "vlm").when(F.col("l_returnflag") == "A", "layout_fallback").otherwise("none")
    names = ["PENDING", "FAST_QUEUED", "FAST_PROCESSING", "FAST_COMPLETED", "SLOW_QUEUED", "SLOW_PROCESSING", "RETRY_WAIT"]
    waiting = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    status = F.when(open_, waiting).when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")
    fast = F.col("status").isin("PENDING", "FAST_QUEUED", "FAST_PROCESSING") | (
        (F.col("status") == "RETRY_WAIT") & (F.col("l_quantity") <= 25))
    return lines(spark, sf_dir).withColumn("status", status).select(
        "job_id", "page_idx", "status", F.when(fast, "fast").otherwise("slow").alias("stage"),
        F.when(~open_, source).alias("source"), (~open_ & (source != "vlm")).alias("low_confidence"),
        F.col("l_shipdate").alias("created_at"),
        F.timestamp_add("SECOND", F.col("l_quantity").cast("int"), "l_shipdate").alias("status_at"),
        F.when(~open_, F.timestamp_add("SECOND", F.floor(F.col("l_extendedprice") / 100).cast("int"), "l_shipdate")).alias("completed_at"),
        "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey")


_sql("page_state", """
SELECT *, CASE WHEN status IN ('PENDING', 'FAST_QUEUED', 'FAST_PROCESSING') OR (status = 'RETRY_WAIT' AND l_quantity <= 25)
               THEN 'fast' ELSE 'slow' END AS stage
FROM (SELECT job_id, page_idx, l_shipdate AS created_at, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_partkey, l_suppkey,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN ['PENDING', 'FAST_QUEUED', 'FAST_PROCESSING', 'FAST_COMPLETED',
       'SLOW_QUEUED', 'SLOW_PROCESSING', 'RETRY_WAIT'][l_linenumber] WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'N' THEN 'vlm'
       WHEN l_returnflag = 'A' THEN 'layout_fallback' ELSE 'none' END AS source,
  NOT (l_linestatus = 'O' AND l_returnflag = 'R') AND l_returnflag <> 'N' AS low_confidence,
  l_shipdate + to_seconds(l_quantity::INT) AS status_at,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN NULL
       ELSE l_shipdate + to_seconds(floor(l_extendedprice / 100)::INT) END AS completed_at
  FROM lines)""", "lines")


def jobs(spark, sf_dir, page_rows: DataFrame | None = None) -> DataFrame:
    """Jobs with their page counts."""
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "SPLIT").otherwise("UPLOADED")
    request = F.when(F.col("o_totalprice") >= 5000, F.md5(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string"))))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("client-"), F.col("o_custkey").cast("string")).alias("client_id"),
        state.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), request.alias("request_id"),
        "o_totalprice")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").cast("int").alias("total_pages"))
    return orders.join(counts, "job_id", "left").withColumn("total_pages", F.coalesce("total_pages", F.lit(0)))


_sql("jobs", """
SELECT o_orderkey AS job_id, 'client-' || o_custkey AS client_id, o_orderdate::TIMESTAMP AS created_at, o_totalprice,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'SPLIT' ELSE 'UPLOADED' END AS status,
  CASE WHEN o_totalprice >= 5000 THEN md5('job-' || o_orderkey) END AS request_id, coalesce(n, 0)::INT AS total_pages
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")


def outbox(spark, sf_dir) -> DataFrame:
    """One message per page, sent once the page has left its first status."""
    page = pages(spark, sf_dir)
    sent = F.when(~F.col("status").isin("PENDING", "FAST_COMPLETED", "RETRY_WAIT"),
                  F.timestamp_add("MILLISECOND", F.floor(F.col("l_quantity") * 100).cast("int"), "created_at"))
    return page.select((F.col("job_id") * 100_000 + F.col("page_idx")).alias("id"), F.col("stage").alias("queue"), "job_id", "page_idx",
                       "created_at", sent.alias("sent_at"))


_sql("outbox", """
SELECT job_id * 100000 + page_idx AS id, stage AS queue, job_id, page_idx, created_at,
  CASE WHEN status NOT IN ('PENDING', 'FAST_COMPLETED', 'RETRY_WAIT') THEN created_at + to_milliseconds(floor(l_quantity * 100)::INT) END AS sent_at
FROM page_state""", "page_state")


# --- event stream ------------------------------------------------------------------------------

def stream_events(spark, sf_dir) -> DataFrame:
    """Events of every job: split, one per finished page in order of time, complete at the end."""
    finished = F.col("source").isNotNull()
    counted = scan.totals(pages(spark, sf_dir), ["job_id"], {
        "total_pages": F.count("*"), "_done": F.count_if(finished), "_last": F.max(F.when(finished, F.col("completed_at")))}, sizes=line_sizes(spark, sf_dir))
    job = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("_split_at"))

    def event(phase, at, kind, **of_page):
        nothing = {"page_idx": "int", "source": "string", "low_confidence": "boolean", "l_quantity": "double"}
        return F.struct(F.lit(phase).alias("phase"), F.col(at).alias("at"), kind.alias("kind"),
                        *[of_page.get(n, F.lit(None)).cast(t).alias(n) for n, t in nothing.items()])

    # A page's row carries its own event, that of the first page those of the job as well: pages and jobs meet in one join.
    first = F.col("page_idx") == 0
    own = event(1, "created_at", intake.event_kind(F.col("source"), F.col("source") == "none"),
                **{n: F.col(n) for n in ("page_idx", "source", "low_confidence", "l_quantity")})
    of_row = F.array(F.when(finished, own), F.when(first, event(0, "_split_at", F.lit("job_split"))),
                     F.when(first & (F.col("_done") == F.col("total_pages")), event(2, "_last", F.lit("job_complete"))))
    every = counted.join(job, "job_id").select("job_id", F.col("total_pages").cast("int").alias("total_pages"), F.inline(F.filter(of_row, lambda e: e.isNotNull()))) \
        .select("job_id", "phase", "at", "page_idx", "kind", "total_pages", "source", "low_confidence", "l_quantity")
    # At most a split and a completion more than lines.
    return ordered.allocate_seq(every, ["phase", "at", "page_idx"], sizes=line_sizes(spark, sf_dir, 3))


_sql("stream_events", """
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY phase, moment, page_idx) AS seq FROM (
  SELECT p.job_id, 1 AS phase, p.created_at AS moment, page_idx, CASE source WHEN 'none' THEN 'page_failed' WHEN 'vlm' THEN 'page_result'
    ELSE 'page_fallback' END AS kind, j.total_pages, source, low_confidence, l_quantity
  FROM page_state p JOIN jobs j USING (job_id) WHERE source IS NOT NULL
  UNION ALL SELECT job_id, 0, created_at, NULL, 'job_split', total_pages, NULL, NULL, NULL FROM jobs WHERE total_pages > 0
  UNION ALL SELECT j.job_id, 2, max(completed_at), NULL, 'job_complete', any_value(j.total_pages), NULL, NULL, NULL
    FROM page_state p JOIN jobs j USING (job_id) WHERE source IS NOT NULL GROUP BY j.job_id HAVING count(*) = any_value(j.total_pages))""",
     "page_state", "jobs")


def frames(spark, sf_dir) -> DataFrame:
    """Frames in order of arrival; frames of large pages arrive a second time, two places later."""
    event = stream_events(spark, sf_dir)
    copies = F.when(F.col("l_quantity") > 45, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = event.withColumn("copy", F.explode(copies)).withColumn("_place", F.col("seq") + 2 * F.col("copy"))
    return scan.numbered(sent, ["job_id"], ["_place", "copy", "seq"], "arrival", sizes=line_sizes(spark, sf_dir, 6)).drop("_place")


_sql("frames", """
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq + 2 * copy, copy, seq) AS arrival FROM (
  SELECT *, unnest(CASE WHEN l_quantity > 45 THEN [0, 1] ELSE [0] END) AS copy FROM stream_events)""", "stream_events")


#: Days of calls of two users that make up a page of the delivery log.
PAGE_DAYS = 3


def deliveries_of(calls: DataFrame) -> DataFrame:
    """The call log as deliveries: what two users call within three days is a page, the calls of one of them its fast stage and of the
    other its slow stage. A call that timed out leaves its message to be delivered again."""
    from quireflow.functions.calls import classify

    return calls.select(
        F.col("call_id"), F.floor(F.col("user_id") / 2).alias("job_id"), F.floor((F.dayofmonth("ts") - 1) / PAGE_DAYS).cast("int").alias("page_idx"), "ts",
        F.when(F.col("user_id") % 2 == 0, "fast").otherwise("slow").alias("stage"), "timed_out", classify(F.col("status"), F.col("timed_out")).alias("outcome"),
        (~F.col("is_retry")).alias("within_budget"))


def deliveries(spark, sf_dir) -> DataFrame:
    """Deliveries of every page in the order of their calls."""
    found = deliveries_of(calls(spark, sf_dir))
    placed = scan.numbered(found, ["job_id", "page_idx"], ["ts", "call_id"], "step", 0)
    again = scan.running(placed, ["job_id", "page_idx", "stage"], ["step"], {"_timeouts": scan.Running("sum", F.col("timed_out").cast("long"))})
    return again.withColumn("delivery", (1 + F.col("_timeouts") - F.col("timed_out").cast("long")).cast("int")).drop("_timeouts")


_sql("deliveries", f"""
SELECT *, 1 + count(*) FILTER (WHERE timed_out) OVER (PARTITION BY job_id, page_idx, stage ORDER BY step) - timed_out::INT AS delivery FROM (
  SELECT call_id, user_id // 2 AS job_id, ((day(ts) - 1) // {PAGE_DAYS})::INT AS page_idx, ts, timed_out, outcome, NOT is_retry AS within_budget,
    CASE WHEN user_id % 2 = 0 THEN 'fast' ELSE 'slow' END AS stage,
    row_number() OVER (PARTITION BY user_id // 2, day(ts) - 1 - (day(ts) - 1) % {PAGE_DAYS} ORDER BY ts, call_id) - 1 AS step FROM outcomes)""", "outcomes")


def status_log(spark, sf_dir) -> DataFrame:
    """Status changes of every page; pages with line number 7 skip a status they must not skip."""
    names = ["PENDING", "FAST_QUEUED", "FAST_PROCESSING", "FAST_COMPLETED", "SLOW_QUEUED", "SLOW_PROCESSING"]
    path = F.array(*[F.lit(n) for n in names], F.coalesce(F.when(F.col("source") == "none", "FAILED"), F.lit("COMPLETED")))
    exploded = pages(spark, sf_dir).select("job_id", "page_idx", "source", "created_at", "l_quantity", "l_linenumber", F.posexplode(path).alias("step", "status"))
    kept = exploded.filter(~((F.col("l_linenumber") == 7) & (F.col("step") == 2)) & (F.col("source").isNotNull() | (F.col("step") < F.col("l_linenumber"))))
    return kept.select("job_id", "page_idx", "step", "status", F.timestamp_add(
        "SECOND", (F.col("step") * (F.col("l_quantity") + F.col("step"))).cast("int"), "created_at").alias("at"))


_sql("status_log", """
SELECT job_id, page_idx, step, status, created_at + to_seconds((step * (l_quantity + step))::INT) AS moment FROM (
  SELECT *, s - 1 AS step, ['PENDING', 'FAST_QUEUED', 'FAST_PROCESSING', 'FAST_COMPLETED', 'SLOW_QUEUED', 'SLOW_PROCESSING',
    CASE WHEN source = 'none' THEN 'FAILED' ELSE 'COMPLETED' END][s] AS status
  FROM (SELECT * EXCLUDE (status) FROM page_state), range(1, 8) r(s))
WHERE NOT (l_linenumber = 7 AND step = 2) AND (source IS NOT NULL OR step < l_linenumber)""", "page_state")


# --- text pairs and trees -------------------------------------------------------------------------

def _slipped(text: Column, key: Column) -> Column:
    """Text with e read as c in every seventh word, starting at a word that depends on the key."""
    words = F.transform(F.split(text, " "), lambda w, i: F.when(i % 7 == key % 7, F.translate(w, "e", "c")).otherwise(w))
    return F.array_join(words, " ")


def text_pairs(spark, sf_dir, name: str, key: str) -> DataFrame:
    from quireflow.functions.text import collapse_spaces

    raw = scan.at_least_parallel(table(spark, sf_dir, name).select(F.col(key).alias("pair_id"), "text"))
    return raw.select("pair_id", collapse_spaces(F.col("text")).alias("ref"),
                      collapse_spaces(_slipped(F.col("text"), F.col("pair_id"))).alias("hyp"))


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapse_sql(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{_SPACE}', ' ', 'g'))"


def text_pairs_sql(name: str, key: str) -> str:
    slipped = (f"array_to_string(list_transform(string_split(text, ' '), lambda w, i: "
               f"CASE WHEN (i - 1) % 7 = {key} % 7 THEN translate(w, 'e', 'c') ELSE w END), ' ')")
    return f"SELECT {key} AS pair_id, {collapse_sql('text')} AS ref, {collapse_sql(slipped)} AS hyp FROM {name}"


_sql("benchmark_pairs", text_pairs_sql("benchmark", "item_id"))
_sql("document_pairs", text_pairs_sql("documents", "doc_id"))


def tree_nodes(spark, sf_dir) -> DataFrame:
    """Truth and predicted trees of every order: document > page per line > title, paragraph,
    key-value. Predictions have slipped text, moved boxes, relabelled, lost and added nodes."""
    named = ["p_name", "p_brand", "p_type"]
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.count("*").alias("_n"), *[F.collect_list(F.struct(c)).alias(f"_{c}") for c in named])
    copies = lines(spark, sf_dir, parts).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n").cast("int"), F.lit(1)) - 1)))
    line = copies.withColumns({c: F.col(f"_{c}")[F.col("_copy")][c] for c in named})
    number, page = (F.col("page_idx") + 1) * 10, F.col("page_idx")
    x, width = (F.col("l_partkey") % 100).cast("double"), F.lit(50.0) + F.col("l_quantity")
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def node(side, node_id, parent, pos, kind, text, at_x=None, at_y=None, w=None, order=None):
        boxed = at_x is not None
        return F.struct(
            F.lit(side).alias("side"), node_id.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"),
            pos.cast("int").alias("list_pos"), kind.alias("type"), text.alias("text"),
            (at_x if boxed else none_d).alias("x"), (F.lit(float(at_y)) if boxed else none_d).alias("y"),
            (w if boxed else none_d).alias("w"), (F.lit(15.0) if boxed else none_d).alias("h"),
            (order if order is not None else F.lit(None)).cast("int").alias("ord"), none_d.alias("confidence"))

    zero, lit = F.lit(0), F.lit
    truth = [
        node("truth", number, zero, page, lit("page"), none_s, order=page),
        node("truth", number + 1, number, lit(0), lit("title"), F.col("p_name"), x, 0, width, lit(0)),
        node("truth", number + 2, number, lit(1), lit("paragraph"), F.concat_ws(" ", "p_brand", "p_type"), x, 20, width, lit(1)),
        node("truth", number + 3, number, lit(2), lit("kv"), F.concat(lit("line "), F.col("l_linenumber").cast("string")), x, 40, width)]
    moved = x + F.col("l_suppkey") % 9
    slipped = F.when(F.col("l_suppkey") % 3 == 0, F.translate("p_name", "e", "c")).otherwise(F.col("p_name"))
    pred = [
        node("pred", number, zero, page, lit("page"), none_s, order=page),
        node("pred", number + 1, number, lit(1), lit("title"), slipped, moved, 0, width, lit(0)),
        node("pred", number + 2, number, lit(0), F.when(F.col("l_returnflag") == "A", "list").otherwise("paragraph"),
             F.concat_ws(" ", "p_brand", "p_type"), moved, 20, width, lit(1))]
    kv = F.when(F.col("l_returnflag") != "R", node("pred", number + 3, number, lit(2), lit("kv"), truth[3]["text"], moved, 40, width))
    cell = F.when(F.col("l_discount") >= 0.09, node("pred", number + 4, number + 2, lit(0), lit("cell"), none_s))
    first = (page == 0) & (F.col("_copy") == 0)
    roots = [F.when(first, node(s, zero, lit(None), zero, lit("document"), none_s)) for s in ("truth", "pred")]
    return line.select(F.col("job_id").alias("pair_id"), F.explode(F.array(*roots, *truth, *pred, kv, cell)).alias("n")) \
        .filter("n is not null").select("pair_id", "n.*")


def trees_together(spark, sf_dir) -> bool:
    """Whether the nodes of a pair come one after another in one partition of ``tree_nodes``: unless an order is too large for a task."""
    return line_sizes(spark, sf_dir)[1] <= scan.MAX_GROUP_ROWS


_sql("tree_nodes", """
SELECT job_id AS pair_id, u.side, u.node_id, u.parent_id, u.list_pos, u.type, u.text, u.x, u.y, u.w, u.h, u.ord FROM (
  SELECT job_id, unnest(list_filter([
    {'side': 'truth', 'node_id': n, 'parent_id': 0, 'list_pos': page_idx, 'type': 'page', 'text': NULL, 'x': NULL::DOUBLE, 'y': NULL::DOUBLE, 'w': NULL::DOUBLE, 'h': NULL::DOUBLE, 'ord': page_idx},
    {'side': 'truth', 'node_id': n + 1, 'parent_id': n, 'list_pos': 0, 'type': 'title', 'text': p_name, 'x': x, 'y': 0.0, 'w': w, 'h': 15.0, 'ord': 0},
    {'side': 'truth', 'node_id': n + 2, 'parent_id': n, 'list_pos': 1, 'type': 'paragraph', 'text': concat_ws(' ', p_brand, p_type), 'x': x, 'y': 20.0, 'w': w, 'h': 15.0, 'ord': 1},
    {'side': 'truth', 'node_id': n + 3, 'parent_id': n, 'list_pos': 2, 'type': 'kv', 'text': 'line ' || l_linenumber, 'x': x, 'y': 40.0, 'w': w, 'h': 15.0, 'ord': NULL},
    {'side': 'pred', 'node_id': n, 'parent_id': 0, 'list_pos': page_idx, 'type': 'page', 'text': NULL, 'x': NULL, 'y': NULL, 'w': NULL, 'h': NULL, 'ord': page_idx},
    {'side': 'pred', 'node_id': n + 1, 'parent_id': n, 'list_pos': 1, 'type': 'title', 'text': CASE WHEN l_suppkey % 3 = 0 THEN translate(p_name, 'e', 'c') ELSE p_name END, 'x': mx, 'y': 0.0, 'w': w, 'h': 15.0, 'ord': 0},
    {'side': 'pred', 'node_id': n + 2, 'parent_id': n, 'list_pos': 0, 'type': CASE WHEN l_returnflag = 'A' THEN 'list' ELSE 'paragraph' END, 'text': concat_ws(' ', p_brand, p_type), 'x': mx, 'y': 20.0, 'w': w, 'h': 15.0, 'ord': 1},
    CASE WHEN l_returnflag <> 'R' THEN {'side': 'pred', 'node_id': n + 3, 'parent_id': n, 'list_pos': 2, 'type': 'kv', 'text': 'line ' || l_linenumber, 'x': mx, 'y': 40.0, 'w': w, 'h': 15.0, 'ord': NULL} END,
    CASE WHEN l_discount >= 0.09 THEN {'side': 'pred', 'node_id': n + 4, 'parent_id': n + 2, 'list_pos': 0, 'type': 'cell', 'text': NULL, 'x': NULL, 'y': NULL, 'w': NULL, 'h': NULL, 'ord': NULL} END
  ], lambda v: v IS NOT NULL)) AS u
  FROM (SELECT *, (page_idx + 1)::BIGINT * 10 AS n, (l_partkey % 100)::DOUBLE AS x, 50.0::DOUBLE + l_quantity AS w,
               (l_partkey % 100)::DOUBLE + l_suppkey % 9 AS mx FROM lines LEFT JOIN part ON p_partkey = l_partkey))
UNION ALL
SELECT DISTINCT l_orderkey, side, 0, NULL, 0, 'document', NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::INT
FROM lineitem, (VALUES ('truth'), ('pred')) s(side)""", "lines")

# Sibling rank, path, reading order, page and post-order of every node.
_sql("ranked_nodes", """
SELECT *, row_number() OVER (PARTITION BY pair_id, side, parent_id ORDER BY ord IS NULL, coalesce(ord, 0), list_pos)::INT AS rank FROM tree_nodes""",
     "tree_nodes")
_sql("node_paths", """
SELECT r.pair_id, r.side, r.node_id, []::INT[] AS path FROM ranked_nodes r WHERE parent_id IS NULL
UNION ALL
SELECT r.pair_id, r.side, r.node_id, list_append(p.path, r.rank) FROM node_paths p
JOIN ranked_nodes r ON r.pair_id = p.pair_id AND r.side = p.side AND r.parent_id = p.node_id""", "ranked_nodes")
_sql("layout", """
SELECT n.*, p.path, len(p.path) AS depth,
  (row_number() OVER (PARTITION BY pair_id, side ORDER BY p.path) - 1)::INT AS pre,
  (row_number() OVER (PARTITION BY pair_id, side ORDER BY list_append(p.path, 2147483647)) - 1)::INT AS post
FROM tree_nodes n JOIN node_paths p USING (pair_id, side, node_id)""", "node_paths")
_sql("sized", "SELECT *, post - pre + depth + 1 AS size, post - (post - pre + depth + 1) + 1 AS lmld FROM layout", "layout")
_sql("paged", """
SELECT n.*, CASE WHEN depth >= 1 THEN page END AS page FROM layout n LEFT JOIN (
  SELECT pair_id, side, path AS ppath, (row_number() OVER (PARTITION BY pair_id, side ORDER BY path) - 1)::INT AS page
  FROM layout WHERE type = 'page') g ON g.pair_id = n.pair_id AND g.side = n.side AND n.path[1:1] = g.ppath""", "layout")


def boxes(spark, sf_dir) -> DataFrame:
    """Boxes of every order on one page: truth per line, prediction moved, relabelled or lost."""
    line = lines(spark, sf_dir)
    x, y, w = (F.col("l_partkey") % 100).cast("double"), F.col("page_idx") * 20.0, 50.0 + F.col("l_quantity")
    box = lambda at: F.struct(at.alias("x"), y.alias("y"), w.alias("w"), F.lit(15.0).alias("h"))
    truth = F.struct(F.lit("truth").alias("side"), F.col("l_returnflag").alias("type"), box(x).alias("box"))
    pred = F.struct(F.lit("pred").alias("side"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("type"),
                    box(x + F.col("l_suppkey") % 9).alias("box"))
    lost = F.col("l_discount") >= 0.1
    return line.select(F.col("job_id").alias("pair_id"), F.lit(0).alias("page"), F.col("page_idx").alias("idx"),
                       F.explode(F.when(lost, F.array(truth)).otherwise(F.array(truth, pred))).alias("b")) \
        .select("pair_id", "page", "idx", "b.*")


_sql("boxes", """
SELECT job_id AS pair_id, page_idx AS idx, 'truth' AS side, l_returnflag AS type, (l_partkey % 100)::DOUBLE AS x, page_idx * 20.0::DOUBLE AS y, 50.0::DOUBLE + l_quantity AS w, 15.0::DOUBLE AS h FROM lines
UNION ALL
SELECT job_id, page_idx, 'pred', CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE l_linestatus END, (l_partkey % 100)::DOUBLE + l_suppkey % 9, page_idx * 20.0::DOUBLE, 50.0::DOUBLE + l_quantity, 15.0::DOUBLE
FROM lines WHERE l_discount < 0.1""", "lines")

_sql("candidates", """
SELECT * FROM (
  SELECT p.pair_id, p.idx AS pred_idx, t.idx AS truth_idx, p.type AS pred_type, t.type AS truth_type,
    CASE WHEN p.w * p.h + t.w * t.h - i > 0 THEN i / (p.w * p.h + t.w * t.h - i) ELSE 0 END AS iou
  FROM (SELECT p, t, greatest(0.0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0.0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y)) AS i
        FROM boxes p JOIN boxes t ON p.pair_id = t.pair_id AND p.side = 'pred' AND t.side = 'truth'))
WHERE iou > 0""", "boxes")


# --- metric samples -----------------------------------------------------------------------------

def samples(spark, sf_dir) -> DataFrame:
    """Counter and gauge samples: the counter of a series restarts whenever a value above 300 is seen."""
    event = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("instance"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id", F.col("value").alias("gauge"))
    counted = scan.running(event, ["metric", "instance"], ["ts", "event_id"], {
        "_era": scan.Running("sum", (F.col("gauge") > 300).cast("long"))})
    return scan.numbered(counted, ["metric", "instance", "_era"], ["ts", "event_id"], "counter").drop("_era")


_sql("samples", """
SELECT metric, instance, ts, event_id, gauge, row_number() OVER (PARTITION BY metric, instance, era ORDER BY ts, event_id) AS counter FROM (
  SELECT event_type AS metric, user_id % 5 AS instance, ts, event_id, value AS gauge,
    sum((value > 300)::INT) OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events)""")
