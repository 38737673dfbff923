"""Fixed values and table schemas of the document-extraction data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -------------------------------------------------------------------------
MAX_TREE_NODES = 1000
MAX_TREE_CELLS = 20_000_000
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_PAGES = 100
ACCEPTED_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/tiff")
CLIENT_ID_PATTERN = "^[A-Za-z0-9._-]{1,64}\\n?\\z"
REQUEST_ID_PATTERN = "^[A-Za-z0-9._:-]{1,128}\\n?\\z"
MODEL_VERSION = "v1"

TERMINAL_STATUSES = ("COMPLETED", "FAILED")
SENDABLE_STATUSES = ("PENDING", "FAST_COMPLETED", "RETRY_WAIT")
PAGE_KINDS = ("page_result", "page_fallback", "page_failed")
FINAL_KINDS = ("job_complete", "job_failed")

MAX_ATTEMPTS = 3
MAX_DELIVERIES = 3
BASE_DELAY_S = 1.0
MAX_DELAY_S = 60.0
MAX_SEND_DELAY_S = 900

WINDOW_S = 10
MIN_SAMPLES = 10
OVERLOAD_WINDOWS = 2
HEALTHY_WINDOWS = 3
MIN_RPS = 1.0
MIN_CONCURRENCY = 1
RETRY_BUDGET_RATIO = 0.10
RETRY_BUDGET_MIN = 5
SLOT_TTL_S = 60

BREAKER_WINDOW = 20
BREAKER_THRESHOLD = 0.5
BREAKER_OPEN_S = 10.0
BREAKER_PROBES = 3

FALLBACK_CONFIDENCE_CAP = 0.49
FALLBACK_CONFIDENCE_RATIO = 0.6
FALLBACK_CONFIDENCE_NONE = 0.2
VLM_CONFIDENCE = 0.9

FETCH_LIMIT = 64
SEND_BATCH = 100
SEND_CHUNK = 10
DUPLICATES_LISTED = 50
WINDOW_SIZE = 64

# Histogram edges in seconds.
LATENCY_EDGES = (0.025, 0.05, 0.1, 0.25, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 7.5, 10)
WAIT_EDGES = (0.1, 0.5, 1, 2, 5, 10, 20, 30, 60, 120, 300, 600)
PAGE_EDGES = (1, 2, 5, 10, 20, 30, 60, 120, 300, 600, 1800)
SEND_LAG_EDGES = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10)
EVALUATION_EDGES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 1, 2.5)

# Bytes per unit of a size such as "12.5MiB".
SIZE_UNITS = {"B": 1, "KiB": 1024, "MiB": 1024**2, "GiB": 1024**3, "kB": 1000, "MB": 1000**2, "GB": 1000**3}

# model, stage, hard rps, start rps, start concurrency, max concurrency, nominal latency s, normal error rate, timeout s
MODEL_LIMITS = (
    ("layout", "fast", 100.0, 80.0, 5, 10, 0.05, 0.02, 2.0),
    ("vlm", "slow", 10.0, 8.0, 20, 30, 3.0, 0.05, 10.0),
)
MODEL_LIMITS_SCHEMA = (
    "model string, stage string, hard_rps double, start_rps double, start_concurrency int, max_concurrency int, "
    "nominal_latency_s double, normal_error_rate double, timeout_s double"
)

# --- table schemas ------------------------------------------------------------------------
SCHEMAS = {
    "clients": "client_id string, created_at timestamp",
    "jobs": "job_id string, client_id string, status string, content_type string, object_key string, "
            "size_bytes bigint, total_pages int, next_seq bigint, error string, created_at timestamp, "
            "completed_at timestamp, request_id string",
    "pages": "job_id string, page_idx int, client_id string, status string, stage string, object_key string, "
             "fast_attempts int, slow_attempts int, has_fast_result boolean, source string, low_confidence boolean, "
             "last_error string, created_at timestamp, status_at timestamp, completed_at timestamp",
    "outbox": "id bigint, queue string, job_id string, page_idx int, request_id string, delay_s int, "
              "created_at timestamp, sent_at timestamp",
    "model_attempts": "id bigint, job_id string, page_idx int, stage string, idem_key string, outcome string, "
                      "http_status int, latency_ms int, created_at timestamp",
    "events": "job_id string, seq bigint, kind string, page_idx int, created_at timestamp, "
              "envelope struct<header:struct<job_id:string,client_id:string,request_id:string,seq:bigint,"
              "page_index:int,total_pages:int,watermark:int,"
              "window:struct<base:int,size:int,bitmap:string>,emitted_at:string>,payload:string>",
    "logs": "ts string, level string, logger string, msg string, request_id string, job_id string, page int",
    "metrics": "ts timestamp, instance string, metric string, labels map<string,string>, value double",
}

KEYS = {
    "clients": ["client_id"], "jobs": ["job_id"], "pages": ["job_id", "page_idx"], "outbox": ["id"],
    "model_attempts": ["id"], "events": ["job_id", "seq"],
}


def model_limits(spark: SparkSession) -> DataFrame:
    """The per-model constants, one row per model (two rows, always fit to broadcast)."""
    return spark.createDataFrame(list(MODEL_LIMITS), MODEL_LIMITS_SCHEMA)
