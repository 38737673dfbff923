"""The layout of many trees at once against the walk of single trees, the stream of whole pairs, and the dealing by cost."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import boxes as boxes_fx
from quireflow.functions import trees
from quireflow.functions.layout import lay_out
from quireflow.operators import evaluation as ev

NODES = st.lists(st.tuples(st.integers(-3, 12), st.one_of(st.none(), st.integers(-3, 12)), st.booleans()), min_size=1, max_size=12)


@given(st.lists(NODES, min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_all_trees_as_one_by_one(forest):
    rows = [(t, *node) for t, tree in enumerate(forest) for node in tree]
    tree, ids, parents, pages = zip(*rows, strict=True)
    laid = lay_out(np.array(tree), np.array(ids), np.array([p or 0 for p in parents]), np.array([p is None for p in parents]), np.array(pages))
    for t, nodes in enumerate(forest):
        visited, numbers, misplaced = trees.layout(*(list(c) for c in zip(*nodes, strict=True)))
        for name, values in numbers.items():
            assert getattr(laid, name)[laid.first[t] + np.array(visited)].tolist() == [-1 if v is None else v for v in values]
        assert laid.misplaced[t] == misplaced
        assert laid.cost[t] == trees.keyroot_cost(numbers["post"], numbers["lmld"])
        assert laid.mirrored_cost[t] == trees.keyroot_cost(numbers["mpost"], numbers["mlmld"])


def test_pairs_stay_whole_however_batches_are_cut(monkeypatch):
    monkeypatch.setattr(ev, "CHUNK_NODES", 10)
    pairs = np.repeat([3, 5, 6, None, 9, 12], [1, 30, 2, 4, 11, 25])
    table = pa.table({"pair_id": pa.array(pairs.tolist(), pa.int64()), "is_truth": pa.array([i % 7 > 3 for i in range(len(pairs))])})
    for size in (1, 3, 10, 100):
        seen = []
        for chunk, _ in ev._whole_pairs(iter(table.to_batches(max_chunksize=size))):
            seen.append(chunk["pair_id"].to_pylist())
        assert [p for chunk in seen for p in chunk] == pairs.tolist()
        assert all(a[-1] != b[0] for a, b in zip(seen, seen[1:], strict=False))
        assert size > 30 or len(seen) > 2


@given(st.lists(st.tuples(st.integers(0, 3), *[st.integers(0, 9)] * 4, st.integers(0, 1), st.booleans()), max_size=40))
@settings(max_examples=200, deadline=None)
def test_groups_of_boxes_as_one_by_one(rows):
    def side(which):
        mine = sorted((r for r in rows if r[6] == which), key=lambda r: r[0])
        return np.array([r[0] for r in mine], int), np.array([r[1:5] for r in mine], float).reshape(-1, 4).T, np.array([r[5] for r in mine], int)

    one, two = side(False), side(True)
    group, iou, same = boxes_fx.match_groups(*one, *two)
    for g in range(4):
        a, b = np.flatnonzero(one[0] == g), np.flatnonzero(two[0] == g)
        ious, kinds = boxes_fx.match_boxes(np.zeros(len(a)), *one[1][:, a], one[2][a], np.zeros(len(b)), *two[1][:, b], two[2][b]) if len(a) and len(b) else ([], [])
        assert sorted(zip(iou[group == g].tolist(), same[group == g].tolist(), strict=True)) == sorted(zip(ious, map(bool, kinds), strict=True))


def test_a_page_of_very_many_boxes(monkeypatch):
    draw = np.random.default_rng(1)
    box = [np.concatenate([draw.integers(0, 50, (2, 60)), draw.integers(1, 20, (2, 60))]).astype(float) for _ in range(2)]
    group, kind = np.repeat([0, 1], [10, 50]), draw.integers(0, 2, 60)
    want = sorted(zip(*(v.tolist() for v in boxes_fx.match_groups(group, box[0], kind, group, box[1], kind)), strict=True))
    monkeypatch.setattr(boxes_fx, "MOST_COMBINATIONS", 400)
    assert sorted(zip(*(v.tolist() for v in boxes_fx.match_groups(group, box[0], kind, group, box[1], kind)), strict=True)) == want


def _flat(spark, sizes):
    """A pair per size: a root with so many leaves on both sides."""
    pairs = spark.createDataFrame(list(enumerate(sizes)), "pair_id long, n int").repartition(4)
    nodes = pairs.select("pair_id", F.explode(F.array(*[F.lit(s) for s in ev.SIDES])).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    none = F.lit(None).cast("double")
    return nodes.select("pair_id", "side", F.col("k").cast("long").alias("node_id"), F.when(F.col("k") > 0, F.lit(0)).cast("long").alias("parent_id"), F.col("k").alias("list_pos"),
                        F.concat(F.lit("t"), F.when(F.col("side") == "pred", F.col("k") % 5).otherwise(F.col("k") % 7)).alias("type"), F.lit(None).cast("string").alias("text"),
                        *[none.alias(c) for c in "xywh"], F.lit(None).cast("int").alias("ord"), none.alias("confidence"))


def test_partitions_of_equal_cost(spark):
    # few costly pairs among many cheap ones
    pairs = ev.written(ev.pair_rows(_flat(spark, [300 if k % 40 == 0 else 5 + k % 9 for k in range(800)]), with_trees=True))
    dealt = ev.dealt_by_cost(pairs, cells_per_task=200_000)
    cells = [r.cells for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("cells").alias("cells")).collect()]
    assert dealt.count() == 800 and len(cells) >= 8
    assert max(cells) <= 2 * sorted(cells)[len(cells) // 2]


def test_a_very_large_tree_is_scored_beside_small_ones(spark):
    out = {r.pair_id: r for r in ev.evaluate(_flat(spark, [400_000, 3, 4])).collect()}
    assert out[0].refused_reason == "nodes" and out[0].pred_nodes == 400_001 and out[0].cer == 0
    assert [out[k].ted for k in (1, 2)] == [0, 0]
    assert ev.reading_order(_flat(spark, [400_000, 3]), []).filter("pre = 400000 and node_id = 400000").count() == 2


def test_sides_that_are_hashed_by_the_pair_already(spark):
    """A union of two such sides must not leave the parts of a pair apart."""
    rows = _flat(spark, [3] * 50)
    roots = rows.filter("node_id = 0").dropDuplicates(["pair_id", "side"])
    nodes = rows.filter("node_id > 0").repartition(4, "pair_id").unionByName(roots.repartition(4, "pair_id"))
    assert ev.admission_report(nodes).filter("pred_nodes = 4 and truth_nodes = 4").count() == 50
