"""Upload admission, identifiers, messages and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow import contracts as c


def content_type(raw: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(raw, F.lit("")), ";", 1)))


def valid_client(client_id: Column) -> Column:
    return F.coalesce(client_id.rlike(c.CLIENT_ID_PATTERN), F.lit(False))


def request_id(incoming: Column, key: Column) -> Column:
    """The incoming id if well formed, otherwise 32 hex digits derived from ``key``."""
    return F.when(F.coalesce(incoming.rlike(c.REQUEST_ID_PATTERN), F.lit(False)), incoming).otherwise(F.md5(key))


def admission(client_id: Column, raw_type: Column, declared_bytes: Column, size_bytes: Column, pages: Column) -> Column:
    """struct<http_status, reason> of an upload; the first failing rule decides."""

    def result(status: int, reason: str) -> Column:
        return F.struct(F.lit(status).alias("http_status"), F.lit(reason).alias("reason"))

    return (
        F.when(~valid_client(client_id), result(400, "missing_client"))
        .when(~content_type(raw_type).isin(*c.ACCEPTED_TYPES), result(415, "bad_type"))
        .when((F.coalesce(declared_bytes, F.lit(0)) > c.MAX_UPLOAD_BYTES) | (size_bytes > c.MAX_UPLOAD_BYTES),
              result(413, "too_large"))
        .when(size_bytes == 0, result(400, "empty"))
        .when(F.coalesce(pages, F.lit(0)) < 1, result(422, "no_pages"))
        .when(pages > c.MAX_PAGES, result(422, "too_many_pages"))
        .otherwise(result(202, "accepted"))
    )


def idempotency_key(job_id: Column, page_idx: Column, model: Column, version: str = c.MODEL_VERSION) -> Column:
    return F.sha2(F.concat_ws(":", job_id.cast("string"), page_idx.cast("string"), model, F.lit(version)), 256)


def result_state(kind: Column) -> Column:
    return F.when(kind == "page_failed", "FAILED").otherwise("COMPLETED")


def event_kind(source: Column, failed: Column) -> Column:
    return F.when(failed, "page_failed").when(source == "vlm", "page_result").otherwise("page_fallback")


def unfinished(status: Column) -> Column:
    return ~status.isin(*c.TERMINAL_STATUSES)


def message(job_id: Column, page_idx: Column, request: Column) -> Column:
    """JSON message of a page; fields without a value are left out."""
    return F.to_json(F.struct(job_id.cast("string").alias("job_id"), page_idx.alias("idx"), request.alias("request_id")))


def resume_seq(header: Column, query: Column) -> Column:
    """Where a reader resumes: the header if it is digits, else the query value, else 0."""
    digits = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("bigint"))
    return F.coalesce(digits, query, F.lit(0)).cast("bigint")


def size_bytes(text: Column) -> Column:
    """Bytes of a size with a unit; units are tried longest first, a bare number is bytes."""
    number = F.regexp_extract(text, r"^\s*([0-9.eE+-]+?)\s*([A-Za-z]*)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([A-Za-z]*)\s*$", 1)
    factor = F.when(unit == "", 1.0)
    for name in sorted(c.SIZE_UNITS, key=len, reverse=True):
        factor = factor.when(unit == name, float(c.SIZE_UNITS[name]))
    return number * factor


def page_key(job_id: Column, page_idx: Column) -> Column:
    return F.format_string("pages/%s/%04d.pdf", job_id.cast("string"), page_idx.cast("int"))


def result_key(job_id: Column, page_idx: Column, name: Column) -> Column:
    return F.format_string("results/%s/pages/%04d/%s.json", job_id.cast("string"), page_idx.cast("int"), name)
