"""WARC archives with a two-level capture index.

Writing. Each page is one record: ``response`` with its HTTP message, or ``revisit`` (headers only) if an earlier page id has the same
payload. A record is a gzip member of its own. Spark's text writer lays the members end to end: a member's last byte is zero (the
high byte of the length; a record of 16 MiB or more is followed by an empty member), and that byte is the writer's line separator,
so the files are ordinary ``.warc.gz`` content in whatever store Spark writes to. A file holds ``PER_ARCHIVE`` records at most, and a page of more
than ``LARGE`` bytes is a file of its own, so no file comes near the two gigabytes that Spark's reader takes.

Index. The archives are read back and walked member by member. Captures are sorted by reversed-host key over the whole corpus,
cut into compressed blocks of ``PER_BLOCK`` lines, and a sparse directory keeps the first key of each block. ``lookup`` searches
the directory, then the blocks, and loads only the archives it needs; ``read_all`` goes through every block. Both load whole archives and cut
the ranges of the records out: tasks of Python have no way to seek in the stores that only Spark's readers reach.

Edge cases. Null html: empty payload. Null url: no target URI, empty key. CR and LF in a url are percent-encoded. Pages of one payload with the same
id are all the response if that id is the least. Payloads of fewer than ``min_bytes`` bytes are all responses. A null page id is
never the least unless all ids of the payload are null; then all are responses. Extra columns are ignored. Empty table: no records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import scratch_path, written

PER_ARCHIVE, PER_BLOCK, BROADCAST_ROWS = 1000, 3000, 20_000
#: Bytes of a page that gets an archive of its own; archives a lookup names one by one.
LARGE, LISTED = 1_000_000, 1000
DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
CAPTURE = "capture_key string, page_id long, path string, position long, size long, payload_digest string, record_type string"


@dataclass
class Store:
    archives: str
    blocks: str
    directory: str


def capture_key(url: str | None) -> str:
    """Reversed host, then port, path and query; the scheme, the user and the fragment play no part."""
    if url is None:
        return ""
    url = url.replace("\r", "%0D").replace("\n", "%0A").replace("\t", "%09")  # as records and index lines hold it
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    port_part = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + port_part + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a WARC record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(position, size, record) of every member that is not empty; an empty one belongs to the record before it."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, out, fed = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if fed >= len(view):
                raise ValueError(f"archive ends inside the member at byte {at}")
            part = view[fed : fed + 65536]
            out.append(unpacker.decompress(part))
            fed += len(part)
        end = fed - len(unpacker.unused_data)
        if raw := b"".join(out):
            yield at, end - at, raw
        at = end


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _id(field: str | None) -> int | None:
    digits = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def page_of(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    fields, block = parsed(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it names")
        return _id(fields["WARC-Record-ID"]), size, digest, "response", None, payload
    return _id(fields["WARC-Record-ID"]), size, digest, "revisit", _id(fields["WARC-Refers-To"]), None


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of (page_id, url, html) under ``path``."""
    body = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", "html", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("bytes"))
    firsts = hashed.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts)
    if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    marked = hashed.join(firsts, "digest", "left")
    later = F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = marked.select("page_id", "url", "html", later.alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [member(record(p, u, (h or "").encode(), r))[:-1] for p, u, h, r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    large = F.coalesce(F.octet_length("html"), F.lit(0)) > LARGE
    for kind, chosen, most in (("pages", ~large, PER_ARCHIVE), ("large", large, 1)):
        out = rows.where(chosen).mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
        out.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/{kind}")


def captures(spark: SparkSession, archives: str) -> DataFrame:
    """One row per record of the archives, found by walking them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, size, raw in members(data.as_buffer()):
                    fields, _ = parsed(raw)
                    rows.append((capture_key(fields.get("WARC-Target-URI")), _id(fields["WARC-Record-ID"]), path, at, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CAPTURE.split(", ")])

    return binary_files(spark, archives).mapInArrow(run, CAPTURE)


def binary_files(spark: SparkSession, archives: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(archives).select("path", "content")


def write_index(found: DataFrame, blocks: str, directory: str) -> None:
    """Compressed blocks of sorted captures, and the first key of each block."""
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def block(rows: list[tuple]) -> tuple[str, int, bytes]:
        text = "\n".join("\t".join("" if v is None else str(v).replace("\t", "%09").replace("\n", "%0A") for v in r) for r in rows)
        return rows[0][0], len(rows), zlib.compress(text.encode("utf-8", "surrogatepass"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            first, n, data = block(rows)
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["first_key", "n", "lines"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            while len(held) >= PER_BLOCK:
                yield out(held[:PER_BLOCK])
                held = held[PER_BLOCK:]
        if held:
            yield out(held)

    laid = found.repartitionByRange("capture_key", "page_id").sortWithinPartitions("capture_key", "page_id", "path", "position")
    laid.mapInArrow(run, "first_key string, n long, lines binary").withColumn("block", F.monotonically_increasing_id()).write.parquet(blocks)
    found.sparkSession.read.parquet(blocks).select("first_key", "block", "n").repartitionByRange("first_key").sortWithinPartitions("first_key", "block").write.parquet(directory)


def write_store(pages: DataFrame, min_bytes: int = 0) -> Store:
    """Archives and index of (page_id, url, html) in the shared folder."""
    spark = pages.sparkSession
    store = Store(*(scratch_path(spark, f"warc_{kind}") for kind in ("archives", "blocks", "directory")))
    write_archives(pages.select("page_id", "url", "html"), store.archives, min_bytes)
    write_index(captures(spark, store.archives), store.blocks, store.directory)
    return store


def lines_of(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of (content, ranges): each range is cut out of the archive and parsed."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content, ranges in zip(batch.column("content"), batch.column("ranges").to_pylist(), strict=True):
            data = content.as_buffer()
            rows = [page_of(zlib.decompress(data[r["position"] : r["position"] + r["size"]], 31)) for r in ranges]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PAGE.split(", ")])


def _fetched(spark: SparkSession, archives: str | list[str], wanted: DataFrame) -> DataFrame:
    ranges = wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("position", "size"))).alias("ranges"))
    return binary_files(spark, archives).join(ranges, "path").select("content", "ranges").mapInArrow(_ranges, PAGE)


def read_all(spark: SparkSession, store: Store) -> DataFrame:
    """Every page of the store, through all blocks of its index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("lines").to_pylist():
                rows = lines_of(data)
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64())], names=["path", "position", "size"])

    return _fetched(spark, store.archives, spark.read.parquet(store.blocks).select("lines").mapInArrow(run, "path string, position long, size long"))


def lookup(spark: SparkSession, store: Store, url: str) -> DataFrame:
    """All captures of a url. Of the directory and the blocks only those that can hold its key are read."""
    key = capture_key(url)
    directory = spark.read.parquet(store.directory)
    before = directory.where(F.col("first_key") < key).agg(F.max("first_key")).first()[0]
    near = directory.where(F.col("first_key") <= key)
    if before is not None:
        near = near.where(F.col("first_key") >= before)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("lines").to_pylist():
                rows = lines_of(data)
                low = bisect.bisect_left(rows, key, key=lambda x: x[0])
                found = [(x[2], int(x[3]), int(x[4])) for x in rows[low : bisect.bisect_right(rows, key, key=lambda x: x[0])]]
                kinds = (pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in enumerate(kinds)], names=["path", "position", "size"])

    blocks = spark.read.parquet(store.blocks).join(near.select("block"), "block", "left_semi").select("lines")
    found = written(blocks.mapInArrow(run, "path string, position long, size long"))
    paths = [r["path"] for r in found.select("path").distinct().limit(LISTED + 1).collect()]
    return _fetched(spark, paths if 0 < len(paths) <= LISTED else store.archives, found)
