"""Nested document trees: JSON in, node rows out; page results to document trees."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = ("pair_id", "side", "node_id", "parent_id", "list_pos", "type", "text", "x", "y", "w", "h", "ord", "confidence")
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.float64())
NODE_SCHEMA = (
    "pair_id bigint, side string, node_id bigint, parent_id bigint, list_pos int, type string, text string, "
    "x double, y double, w double, h double, ord int, confidence double"
)
BATCH_NODES = 20_000


def nodes_of(documents: DataFrame) -> DataFrame:
    """Nodes of (pair_id, side, tree), where ``tree`` is the JSON of a node: type, and as far as given text,
    bbox {x, y, w, h}, order, confidence and children, to any depth.

    Nodes are numbered from 0 in document order as the lists stand. A null tree has no nodes; a tree that is no JSON
    object fails with its pair named, so no document vanishes."""

    def rows(pair_id: int, side: str, tree: str) -> Iterator[tuple]:
        try:
            root = json.loads(tree)
            stack, number = [(root, None, 0)], 0
            while stack:
                node, parent, place = stack.pop()
                box = node.get("bbox") or {}
                yield (pair_id, side, number, parent, place, node["type"], node.get("text"), *(None if box.get(k) is None else float(box[k]) for k in "xywh"), node.get("order"), node.get("confidence"))
                stack.extend((child, number, k) for k, child in reversed(list(enumerate(node.get("children") or []))))
                number += 1
        except (ValueError, KeyError, AttributeError, TypeError) as error:
            raise ValueError(f"the {side} tree of pair {pair_id} cannot be read: {error!r}") from error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names=list(_FIELDS))

        for batch in batches:
            for pair_id, side, tree in zip(*(batch.column(n).to_pylist() for n in ("pair_id", "side", "tree"))):
                if tree is not None:
                    held += rows(pair_id, side, tree)
                if len(held) >= BATCH_NODES:
                    yield made()
                    held.clear()
        if held:
            yield made()

    return documents.select(F.col("pair_id").cast("bigint"), "side", "tree").mapInArrow(run, NODE_SCHEMA)


def document_trees(results: DataFrame) -> DataFrame:
    """(job_id, tree): the page trees of results (job_id, page_index, tree) as children of one document node, in page
    order. A document has at most ``contracts.MAX_PAGES`` pages, so the list is short."""
    listed = F.array_sort(F.collect_list(F.struct("page_index", "tree")))
    document = F.struct(F.lit("document").alias("type"), F.transform(listed, lambda p: p["tree"]).alias("children"))
    return results.groupBy("job_id").agg(F.to_json(document).alias("tree"))
