"""Page results, boxes, frame headers and event text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow import contracts as c


# --- boxes --------------------------------------------------------------------------------

def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct<x,y,w,h>; 0 when the union is empty."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = wide * high
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def ordered_blocks(blocks: Column) -> Column:
    """Blocks by (order, y, x), a missing order counting as 0, ties in input order."""
    keyed = F.transform(blocks, lambda b, i: F.struct(
        F.coalesce(b["order"], F.lit(0)).alias("o"), b["bbox"]["y"].alias("y"), b["bbox"]["x"].alias("x"),
        i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda k: k["b"])


def page_text(blocks: Column) -> Column:
    """Block texts by line; a block without text stays as an empty line."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def page_tree(page_idx: Column, blocks: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The tree of a page: a page node with the page's box (0 where its size is not known) over its
    blocks in order."""
    size = lambda v: F.coalesce(v, F.lit(0.0)).cast("double") if v is not None else F.lit(0.0)
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), size(width).alias("w"), size(height).alias("h"))
    return F.struct(F.lit("page").alias("type"), page_idx.cast("int").alias("order"), box.alias("bbox"), ordered_blocks(blocks).alias("children"))


# --- page results --------------------------------------------------------------------------

def fallback_confidence(blocks: Column) -> Column:
    """Capped share of the mean block confidence, rounded half to even; a fixed value without any."""
    known = F.filter(F.transform(blocks, lambda b: b["confidence"]), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
    scaled = F.bround(total / F.size(known) * c.FALLBACK_CONFIDENCE_RATIO, 3)
    return F.when(F.size(known) > 0, F.least(F.lit(c.FALLBACK_CONFIDENCE_CAP), scaled)) \
        .otherwise(F.lit(c.FALLBACK_CONFIDENCE_NONE))


def _page_result(page_idx, source, confidence, low, blocks, text, tables, pairs, error) -> Column:
    return F.struct(
        page_idx.cast("int").alias("page_index"), F.lit(source).alias("source"), confidence.alias("confidence"),
        F.lit(low).alias("low_confidence"), blocks.alias("blocks"), text.alias("text"),
        tables.alias("tables_markdown"), pairs.alias("key_values"), error.alias("error"),
        page_tree(page_idx, blocks).alias("tree"))


_BLOCKS = "array<struct<type:string,text:string,bbox:struct<x:double,y:double,w:double,h:double>,order:int,confidence:double>>"


def vlm_result(page_idx: Column, blocks: Column, confidence: Column, tables: Column, pairs: Column) -> Column:
    ordered = ordered_blocks(blocks)
    return _page_result(
        page_idx, "vlm", F.coalesce(confidence, F.lit(c.VLM_CONFIDENCE)), False, ordered, page_text(ordered),
        F.coalesce(tables, F.array().cast("array<string>")),
        F.coalesce(pairs, F.create_map().cast("map<string,string>")), F.lit(None).cast("string"))


def fallback_result(page_idx: Column, blocks: Column, reason: Column) -> Column:
    ordered = ordered_blocks(blocks)
    return _page_result(
        page_idx, "layout_fallback", fallback_confidence(blocks), True, ordered, page_text(ordered),
        F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), reason)


def failed_result(page_idx: Column, reason: Column) -> Column:
    return _page_result(
        page_idx, "none", F.lit(0.0), True, F.array().cast(_BLOCKS), F.lit(""),
        F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), reason)


# --- frames ----------------------------------------------------------------------------------

def bits_to_base64(bits: Column) -> Column:
    """Base64 of a LONG's eight bytes, lowest byte first."""
    hexed = F.lpad(F.hex(bits), 16, "0")
    turned = F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])
    return F.base64(F.unhex(turned))


def base64_to_pages(bitmap: Column, base: Column) -> Column:
    """Page indexes whose bit is set in a window bitmap starting at ``base``."""
    # Lowest byte last again, then one number; held in one-element arrays so that bitmap and number are read once a row.
    number = lambda hexed: F.conv(F.concat(*[F.substring(hexed, k, 2) for k in range(15, 0, -2)]), 16, -10).cast("bigint")
    words = F.transform(F.array(F.hex(F.unbase64(bitmap))), number)

    def pages_of(bits: Column) -> Column:
        is_set = lambda k: F.call_function("getbit", bits, k) == 1
        return F.filter(F.sequence(F.lit(0), F.lit(c.WINDOW_SIZE - 1)), is_set)

    offsets = F.flatten(F.transform(words, pages_of))
    return F.transform(offsets, lambda k: k + base.cast("int"))


def frame_header(job_id, client_id, request, seq, page_idx, total_pages, watermark, bits, emitted_at) -> Column:
    return F.struct(
        job_id.cast("string").alias("job_id"), client_id.alias("client_id"), request.alias("request_id"),
        seq.cast("bigint").alias("seq"), page_idx.cast("int").alias("page_index"),
        total_pages.cast("int").alias("total_pages"), watermark.cast("int").alias("watermark"),
        F.struct(watermark.cast("int").alias("base"), F.lit(c.WINDOW_SIZE).alias("size"),
                 bits_to_base64(bits).alias("bitmap")).alias("window"),
        iso_utc(emitted_at).alias("emitted_at"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def sse_text(seq: Column, kind: Column, envelope: Column) -> Column:
    """One server-sent event; ``envelope`` is a struct (compact JSON) or a JSON string."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), envelope, F.lit("\n\n"))


def envelope_field(envelope: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT envelope, read as ``kind``; null where it is absent or of another kind, so payloads of any schema may be mixed."""
    return F.try_variant_get(envelope, path, kind)
