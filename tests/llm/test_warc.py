"""WARC archives: an exact round trip, and lookups through the index."""

import base64
import gzip
import hashlib

from quireflow.llm import warc
from quireflow.llm.queries import op10_warc

SCHEMA = "page_id long, url string, html string, path string"


def want(rows, min_bytes=0):
    first, out = {}, []
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None:
            first[raw] = min(first.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= min_bytes and raw in first and i != first[raw]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op10_warc(spark, folder)) == want(rows)


def test_edge_cases_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_BLOCK", 4)
    monkeypatch.setattr(warc, "PER_ARCHIVE", 3)
    big = "".join(f"{i:x}é\r\n\r\n\0" for i in range(1_700_000))  # more than 16 MiB
    rows = [(5, "http://a.example.org/x?y=1#z", "same"), (3, "https://A.example.org:443/x?y=1", "same"), (9, None, None), (8, "http://b.example.org", ""), (7, "http://b.example.org/", "no\x00 end\r\n\r\nWARC/1.1\r\n"), (1, "not a url\r\nX: y", "<p>ü</p>"), (2, "http://a.example.org/x?y=1", big)]
    rows += [(3, "https://A.example.org:443/x?y=1", "same"), (None, "http://n.example.org/", "null id")]
    rows += [(20 + i, f"http://h{i % 3}.example.com:8080/p/{i % 5}", f"page {i % 7}") for i in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    store = warc.write_store(df)
    assert got(warc.read_all(spark, store)) == want(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in warc.read_all(spark, store).collect() if r["record_type"] == "response")
    archives = b"".join(gzip.decompress(bytes(r["content"])) for r in warc.binary_files(spark, store.archives).collect())
    assert archives.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    for url in ("http://a.example.org/x?y=1", "http://h1.example.com:8080/p/2", "http://nowhere.example.org/"):
        ids = sorted(i for i, u, _ in rows if u is not None and warc.capture_key(u) == warc.capture_key(url))
        assert sorted(r["page_id"] for r in warc.lookup(spark, store, url).collect()) == ids
    assert got(warc.read_all(spark, warc.write_store(df, min_bytes=5))) == want(rows, 5)


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(warc.read_all(spark, warc.write_store(empty))) == []


def test_capture_keys():
    assert warc.capture_key("https://www.Example.com:443/a/b?q=1#f") == "com,example,www)/a/b?q=1"
    assert warc.capture_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.capture_key("mailto:x") == "mailto:x" and warc.capture_key(None) == "" and warc.capture_key("http://[x") == "http://[x"


def test_odd_urls_and_large_pages(spark, monkeypatch):
    urls = ["nohost\tq", "http://a.example/x\ty", "http://a.example/x\r\ny", "plain\nline", None, "http://a.example/"]
    rows = [(i, u, f"page {i} " * (2000 if i % 2 else 1)) for i, u in enumerate(urls)] + [(10 + i, "http://hot.example/", f"hot {i}") for i in range(30)]
    monkeypatch.setattr(warc, "LARGE", 10_000)
    store = warc.write_store(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for i, u in enumerate(urls):
        if u is not None:
            assert [(r.page_id, bytes(r.payload).decode()) for r in warc.lookup(spark, store, u).collect()] == [(i, rows[i][2])]
    assert warc.lookup(spark, store, "http://hot.example/").count() == 30 and warc.lookup(spark, store, "http://none.example/").count() == 0
    large = spark.read.format("binaryFile").load(f"{store.archives}/large/part-*").where("length > 0")
    assert large.count() == 3 and warc.read_all(spark, store).count() == len(rows)
