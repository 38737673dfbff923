"""Expressions on worked examples."""

import base64

import pytest
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import calls, intake, shaping
from quireflow.sources import event_log


@pytest.mark.parametrize("status,timed_out,outcome", [
    (200, False, "ok"), (204, False, "ok"), (429, False, "throttled"), (408, False, "retry"), (500, False, "retry"), (503, False, "retry"),
    (None, False, "retry"), (200, True, "retry"), (401, False, "auth"), (403, False, "auth"), (400, False, "permanent"), (404, False, "permanent")])
def test_outcome_classes(spark, status, timed_out, outcome):
    df = spark.createDataFrame([(status, timed_out)], "s int, t boolean")
    assert df.select(calls.classify(F.col("s"), F.col("t")).alias("o")).first().o == outcome


def test_verdicts(spark):
    cases = [((100, 0, 0, 0, 2.0), "healthy"), ((100, 0, 0, 0, 6.5), "overload"), ((100, 1, 0, 0, 2.0), "overload"), ((100, 0, 5, 0, 2.0), "overload"),
             ((100, 0, 0, 11, 2.0), "overload"), ((100, 0, 0, 9, 2.0), "healthy"), ((0, 0, 0, 0, None), "healthy"), ((3, 0, 0, 0, 2.0), "healthy"),
             ((3, 1, 0, 0, 2.0), "overload"), ((3, 0, 0, 1, 2.0), "unknown")]
    df = spark.createDataFrame([(*v, k) for k, (v, _) in enumerate(cases)], "c int, t int, o int, e int, p double, k int")
    got = df.select("k", calls.verdict(*[F.col(x) for x in "ctoep"], F.lit(3.0), F.lit(0.05)).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == [v for _, v in cases]


def test_bitmap_round_trip(spark):
    done, mark = {3, 9, 65}, 2
    bits = sum(1 << (p - mark) for p in done)
    signed = bits - (1 << 64) if bits >> 63 else bits
    row = spark.createDataFrame([(signed, mark)], "b long, m int").select(shaping.bits_to_base64(F.col("b")).alias("s"), "m") \
        .select("s", shaping.base64_to_pages(F.col("s"), F.col("m")).alias("p")).first()
    assert base64.b64decode(row.s) == bits.to_bytes(8, "little") and set(row.p) == done


def test_retry_after_headers(spark):
    cases = [("250", None, 0.25), ("1", "9", 0.05), (None, "2", 2.0), (None, None, 1.0), (None, "soon", 1.0), ("", "3", 3.0)]
    df = spark.createDataFrame([(m, s, k) for k, (m, s, _) in enumerate(cases)], "m string, s string, k int")
    got = df.select(calls.retry_after_s(F.col("m"), F.col("s")).alias("v"), "k").orderBy("k").collect()
    assert [r.v for r in got] == [v for *_, v in cases]


def test_sizes_and_ids(spark):
    sizes = [("12.5MiB", 12.5 * 2**20), ("3kB", 3000.0), ("7B", 7.0), ("1GiB", 2.0**30), ("42", 42.0)]
    df = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(sizes)], "s string, k int")
    assert [r.v for r in df.select(intake.size_bytes(F.col("s")).alias("v"), "k").orderBy("k").collect()] == [v for _, v in sizes]
    ids = spark.createDataFrame([("ok-1",), ("with newline\n",), ("fine\n",), ("ä",), ("x" * 65,)], "i string")
    assert [r.v for r in ids.select(intake.valid_client(F.col("i")).alias("v")).collect()] == [True, False, True, False, False]


def test_captured_event_text_is_read_back(spark, tmp_path):
    text = ": ping\n\nid: 3\nevent: page_result\ndata: {\"a\":\ndata: 1}\n\nretry: 1000\n\nid:4\ndata:x: y\n\n"
    (tmp_path / "capture.txt").write_text(text)
    got = event_log.read_sse(spark, str(tmp_path / "capture.txt")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("3", "page_result", '{"a":\n1}'), ("4", "message", "x: y")]


def test_captures_are_read_record_by_record_whatever_ends_their_lines(spark, tmp_path):
    one = "id: {}{e}event: page_result{e}data: {{}}{e}data:{e}{e}"
    for name, end, n in (("lf", "\n", 400), ("crlf [1]", "\r\n", 300), ("c%20r*", "\r", 200)):
        (tmp_path / name).write_bytes("".join(one.format(k, e=end) for k in range(n)).encode())
    (tmp_path / "mixed").write_bytes(b"data: a\n\r\ndata: b\n\ndata: c\r\r\n\r\ndata: d\r\n\r\n\ndata: e\r\rdata: f\n\n")
    (tmp_path / "empty").write_bytes(b"")
    forms = event_log._by_separator(spark, str(tmp_path))
    assert {k: sorted(f.rsplit("/", 1)[1] for f in v) for k, v in forms.items()} == {"\n\n": ["empty", "lf", "mixed"], "\r\n\r\n": ["crlf%20%5B1%5D"], "\r\r": ["c%2520r*"]}
    for separator, files in forms.items():  # no row holds a file
        assert event_log._captures(spark, [event_log._as_path(f) for f in files], separator).agg(F.max(F.length("value"))).first()[0] < 60
    got = event_log.read_sse(spark, str(tmp_path))
    assert got.filter("id != ''").groupBy("event", "data").count().collect() == [("page_result", "{}\n", 900)]
    assert sorted(r.data for r in got.filter("id = ''").collect()) == ["a\nb", "c", "d", "e", "f"]


def test_schemas_parse(spark):
    from quireflow.sources import tables

    for name in c.SCHEMAS:
        assert tables.schema(name).fields


def test_nested_json_trees_become_nodes_and_are_scored(spark):
    import json

    import pytest

    from quireflow.operators import evaluation as ev
    from quireflow.sources import trees

    truth = {"type": "page", "children": [{"type": "title", "text": "Größe", "bbox": {"x": 0, "y": 0, "w": 10, "h": 2}, "order": 0},
                                          {"type": "list", "children": [{"type": "item", "text": "one"}, {"type": "item", "text": "two", "confidence": 0.5}]}]}
    pred = {"type": "page", "text": None, "children": [{"type": "title", "text": "Grösse", "bbox": {"x": 0, "y": 0, "w": 10, "h": 2}}]}
    deep = {"type": "a"}
    for _ in range(400):
        deep = {"type": "a", "children": [deep]}
    rows = [(7, "truth", json.dumps(truth)), (7, "pred", json.dumps(pred)), (8, "truth", json.dumps(deep)), (8, "pred", None)]
    nodes = trees.nodes_of(spark.createDataFrame(rows, "pair_id int, side string, tree string"))
    got = [tuple(r) for r in nodes.filter("pair_id = 7 and side = 'truth'").orderBy("node_id").select("node_id", "parent_id", "list_pos", "type", "text", "w", "confidence").collect()]
    assert got == [(0, None, 0, "page", None, None, None), (1, 0, 0, "title", "Größe", 10.0, None), (2, 0, 1, "list", None, None, None),
                   (3, 2, 0, "item", "one", None, None), (4, 2, 1, "item", "two", None, 0.5)]
    assert nodes.filter("pair_id = 8").count() == 401
    row = {r.pair_id: r for r in ev.evaluate(nodes).collect()}
    assert (row[7].char_edits, row[7].ref_chars, row[7].ted, row[7].f1) == (9, 13, 3, 1.0) and row[8].refused_reason == "unpaired"
    with pytest.raises(Exception, match="pair 9"):
        trees.nodes_of(spark.createDataFrame([(9, "pred", "[1")], "pair_id int, side string, tree string")).collect()


def test_a_bitmap_is_decoded_once_a_row(spark):
    pages = str(shaping.base64_to_pages(F.col("bitmap"), F.col("base")))
    assert pages.lower().count("unbase64") == 1
