"""Kernels that work on many pairs at once, and inputs that come without a further shuffle."""

import dataclasses
import json
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireflow.functions import text, trees
from quireflow.operators import evaluation as ev
from quireflow.operators.scan import Fold
from quireflow.plans import evaluation_plans
from quireflow.plans import inputs as i
from quireflow.session import CLEAN_SHUFFLES, written
from quireflow.streaming import live, processors
from quireflow.streaming.processors import OrderedReplay, SharedReplay


def test_edit_distances_of_many_pairs_are_those_of_each():
    rng = random.Random(7)
    a = [[rng.randrange(3) for _ in range(rng.randrange(90))] for _ in range(400)]
    b = [[rng.randrange(3) for _ in range(rng.randrange(90))] if k % 2 else [v if rng.random() < 0.95 else 9 for v in x] for k, x in enumerate(a)]
    b[0] = [5] * 900  # further apart than is tried
    flat = lambda lists: (np.array([v for x in lists for v in x], np.int32), np.array([len(x) for x in lists]))
    assert text.edit_distances(*flat(a), *flat(b)).tolist() == [text.bit_distance(x, y) for x, y in zip(a, b, strict=True)]


def test_edits_of_null_empty_and_foreign_texts():
    found = text._edits.func(pd.Series(["", None, "é𝄞 x", "a b"]), pd.Series(["a b", "a", "e𝄞 x", ""]))
    assert found.char_edits.tolist()[::2] == [3, 1] and found.word_edits.tolist()[::2] == [2, 1]
    assert pd.isna(found.char_edits[1]) and (found.char_edits[3], found.word_edits[3]) == (3, 2)


def _tree(rng, nodes):
    parents = [None] + [rng.randrange(max(0, k - 3), k) for k in range(1, nodes)]
    visited, numbers, _ = trees.layout(list(range(nodes)), parents, [False] * nodes)
    post = np.array(numbers["post"])
    labels, leaf = np.empty(nodes, int), np.empty(nodes, int)
    labels[post], leaf[post] = np.array([rng.randrange(2) for _ in range(nodes)])[visited], numbers["lmld"]
    return labels, leaf


def test_alignments_settle_only_what_the_tables_give():
    rng = random.Random(3)
    pairs = [(*_tree(rng, rng.randrange(1, 12)), *_tree(rng, rng.randrange(1, 12))) for _ in range(1500)]
    settled, exact = trees.aligned_distances(pairs), trees.tree_distances(pairs)
    assert 0.2 < (settled >= 0).mean() < 1 and not ((settled >= 0) & (settled != exact)).any()
    assert trees._distances(list(pairs)) == exact.tolist()


def test_large_trees_are_as_far_apart_as_their_tables_say(monkeypatch):
    rng = random.Random(5)
    pairs = [(*_tree(rng, rng.randrange(1, 25)), *_tree(rng, rng.randrange(1, 25))) for _ in range(300)]
    exact = trees.tree_distances(pairs).tolist()
    assert [trees.large_distance(*p) for p in pairs] == exact
    monkeypatch.setattr(trees, "LARGE_CELLS", 0)  # all in files, all one by one
    assert trees._distances([None, *pairs]) == [None, *exact]


def test_tables_of_wide_trees_do_not_run_into_each_other():
    """A few nodes against very many, which all tables of a level hold side by side."""
    lab, leaf = np.zeros(40_000, int), np.arange(40_000) - np.arange(40_000) % 2  # pairs of a node and its child
    leaf[-1] = 0
    few = np.array([1, 0, 1, 0, 0]), np.array([0, 0, 2, 2, 0])
    pair = (*few, lab, leaf)
    assert trees.tree_distances([pair])[0] == trees.large_distance(*pair) == 40_000 - 3  # two of the five nodes are relabelled or lost


@pytest.fixture(scope="module")
def large_order(spark, tmp_path_factory):
    """An order of 1,100 lines (4,401 nodes a tree) and one of two."""
    at = str(tmp_path_factory.mktemp("large"))
    rows = [(order, n % 7, n, float(n)) for order, lines in ((1, 1100), (2, 2)) for n in range(1, lines + 1)]
    item = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double")
    item.select("*", F.lit(7).cast("bigint").alias("l_suppkey"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"), F.lit(10.0).alias("l_extendedprice"),
                F.lit(0.05).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, f"part {k}", "b", "t") for k in range(7)], "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{at}/part.parquet")
    return at


def test_tree_distances_of_every_size(spark, large_order):
    """A paragraph of every line is seen as a list, and the leaves of all but 40 lines as another."""
    assert {r.pair_id: (r.pred_nodes, r.refused_reason, r.ted) for r in evaluation_plans.tree_distance(spark, large_order).collect()} == {1: (4401, None, 1100), 2: (9, None, 2)}
    assert {r.pair_id: r.ted for r in evaluation_plans.flat_trees(spark, large_order).collect()} == {1: 1060, 2: 0}


def test_a_full_evaluation_has_the_distance_of_every_size(spark, large_order):
    out = {r.pair_id: r for r in evaluation_plans.evaluate(spark, large_order).collect()}
    assert {k: (r.pred_nodes, r.refused_reason, r.ted, r.truth_boxes, r.char_edits) for k, r in out.items()} == {1: (4401, None, 1100, 3300, 0), 2: (9, None, 2, 6, 0)}


def test_texts_are_not_carried_on(spark, large_order, monkeypatch):
    """What is written and dealt has the counts of the texts, not the texts."""
    written = []
    monkeypatch.setattr(ev, "written", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(ev, "dealt_by_cost", lambda df: df)
    assert ev.evaluate(i.tree_nodes(spark, large_order), together=True, **ev.UNLIMITED).count() == 2
    assert "char_edits" in written[0] and not {"ref", "hyp"} & set(written[0])


@pytest.mark.parametrize("first_order", [0, -3, None])
def test_flat_trees_are_scored_the_same_shuffled_or_in_place(spark, tmp_path, monkeypatch, first_order):
    """Without a negative or a null order flat trees are made of lines that lie side by side; otherwise their numbers may be those of orders."""
    rows = [(order, part, n, float(40 + n), None if n == 2 else "F") for order in (first_order, 11, 13, 399, 400, 801, 2000) for n, part in enumerate((1, 2, 3, 1), 1)]
    item = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_linestatus string")
    item.select("*", F.lit(7).cast("bigint").alias("l_suppkey"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"), F.lit(10.0).alias("l_extendedprice"),
                (F.col("l_linenumber") * 0.03).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.lit("A").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "one", "b", "t"), (2, "two", "b", None)], "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    routes, evaluate = [], ev.evaluate
    monkeypatch.setattr(ev, "evaluate", lambda nodes, together=False, **rest: routes.append(together) or evaluate(nodes, together=together, **rest))
    found = sorted(map(str, evaluation_plans.unpaired_and_large(spark, str(tmp_path)).collect()))
    assert routes == ([True, True] if first_order == 0 else [False])
    monkeypatch.setattr(evaluation_plans, "_apart", lambda *_: False)
    assert found == sorted(map(str, evaluation_plans.unpaired_and_large(spark, str(tmp_path)).collect())) and len(found) >= 10


def test_the_shuffle_of_a_written_table_is_removed(spark):
    before, kept = spark.conf.get(CLEAN_SHUFFLES), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = kept.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    known = files()
    table = written(spark.range(1000).repartition(3, "id"))
    for _ in range(50):  # they go in the background
        if files() <= known:
            break
        time.sleep(0.2)
    assert files() <= known and table.count() == 1000 and spark.conf.get(CLEAN_SHUFFLES) == before


def test_cells_of_large_pairs_are_counted_exactly(monkeypatch):
    table = pa.table({"pair_id": [1, 1], "is_truth": [False, True], "node_id": [0, 0], "parent_id": pa.array([None, None], pa.int64()), "type": ["a", "a"]})
    pairs = ev._Pairs(table, np.array([0, 1]), None, None)
    assert pairs.cells.tolist() == [1] and pairs.admitted.all()
    laid = dataclasses.replace(ev._laid(table, np.array([0, 1])), cost=np.array([2**40, 2**40 + 1]), mirrored_cost=np.array([2**26 + 1, 2**30 + 1]))
    monkeypatch.setattr(ev, "_laid", lambda *_: laid)
    pairs = ev._Pairs(table, np.array([0, 1]), None, None)
    assert pairs.cells.tolist() == [(2**26 + 1) * (2**30 + 1)] and pairs.mirrored.tolist() == [True]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of a few orders, one of them null; part 1 is there twice, part 3 is missing."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(order, part, n, float(n)) for order in (None, 1, 2, 3, 9) for n, part in enumerate((1, 2, 3, 1), 1)]
    item = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double")
    item.select("*", F.lit(7).cast("bigint").alias("l_suppkey"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"), F.lit(10.0).alias("l_extendedprice"),
                (F.col("l_linenumber") * 0.03).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(1, "one", "b", "t"), (1, None, "b2", "t2"), (2, "two", "b", None), (None, "none", "b", "t")], "p_partkey bigint, p_name string, p_brand string, p_type string") \
        .write.parquet(f"{at}/part.parquet")
    return at


def test_nodes_of_a_pair_come_together(spark, tables):
    nodes = i.tree_nodes(spark, tables)
    assert i.trees_together(spark, tables)
    placed = nodes.withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for row in placed:
        runs = tasks.setdefault(row.task, [])
        if not runs or runs[-1] != row.pair_id:
            runs.append(row.pair_id)
    seen = [pair for runs in tasks.values() for pair in runs]
    assert sorted(seen, key=str) == sorted({r.pair_id for r in placed}, key=str)
    # an order has one root a side and the nodes of six looked-up lines: part 1 twice, part 3 with null texts
    truth = [r for r in placed if r.pair_id == 1 and r.side == "truth"]
    assert len(truth) == 1 + 6 * 4 and sum(r.parent_id is None for r in truth) == 1
    assert sorted(str(r.text) for r in truth if r.type == "title") == ["None", "None", "None", "one", "one", "two"]


def test_pairs_score_the_same_shuffled_or_together(spark, tables):
    nodes = i.tree_nodes(spark, tables)
    rows = [sorted(map(str, ev.evaluate(nodes, together=t).collect())) for t in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) == 5


class _State:
    def __init__(self):
        self.values = {}

    def get(self):
        return self.values.get(None)

    def update(self, value):
        self.values[None] = value

    def getValue(self, key):  # noqa: N802
        return self.values[key]

    def updateValue(self, key, value):  # noqa: N802
        self.values[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.values[key]


def test_a_batch_is_folded_slice_by_slice(spark, monkeypatch):
    """All rows come out in order, in frames of bounded size, and no more than a slice is unpacked."""
    schema = spark.createDataFrame([], "model string, id bigint, total bigint, late boolean").schema
    replay = OrderedReplay(Fold(("id",), "total bigint", lambda s, v: ((s or 0) + 1, ((s or 0) + 1,))), ["at_ms", "id"], ["id"], schema, 3200)
    replay.OUT_ROWS, replay.state, replay.held = 500, _State(), _State()
    unpacked, loads = [], processors.pickle.loads
    monkeypatch.setattr(processors.pickle, "loads", lambda packed: unpacked.append(len(loads(packed))) or loads(packed))
    ids = random.Random(1).sample(range(20_000), 20_000)
    frames = [pd.DataFrame({"at_ms": ids[k : k + 1000], "ends": False, "id": ids[k : k + 1000]}) for k in range(0, 20_000, 1000)]
    out = list(replay.handleInputRows(("m",), iter(frames), None))
    done = pd.concat(out)
    assert done.id.tolist() == list(range(20_000 - 3200)) and done.total.tolist() == list(range(1, 20_000 - 3200 + 1)) and not done.late.any()
    assert max(map(len, out)) < 1000 and max(unpacked) < 100
    last = list(replay.handleInputRows(("m",), iter([pd.DataFrame({"at_ms": [5.0, None], "ends": [False, True], "id": [5.0, None]})]), None))
    assert pd.concat(last).id.tolist()[1:] == list(range(20_000 - 3200, 20_000)) and pd.concat(last).late.tolist()[0]


def test_keys_of_a_share_are_replayed_like_keys_of_their_own(spark):
    """Late rows, rows without a time, ended and hot keys (whose slices lie in the map): one state row gives what a row per key gives."""
    fold = Fold(("v",), "total bigint", lambda s, v: ((s or 0) + (v or 0), ((s or 0) + (v or 0),)))
    schema = spark.createDataFrame([], "j bigint, p string, v bigint, total bigint, late boolean").schema
    parts = (fold, ["at_ms", "v"], ["v"], schema, 640)
    rng, names = random.Random(2), [(2**60 + 1, "a"), (2**60 + 2, "a"), (None, "b"), (7, None), (8, "hot")]
    batches = []
    for b in range(4):
        rows = []
        for k in range(4000):
            at = b * 800 + rng.randrange(1200)
            rows.append((rng.choice(names) if k < 400 else names[-1], None if k % 97 == 0 else float(at), False, b * 4000 + k))
        batches.append(rows + ([(name, None, True, None) for name in names[:3]] if b == 2 else []))

    def frame(rows):
        told = [json.dumps({n: v for n, v in zip("jp", name, strict=True) if v is not None}) for name, *_ in rows]
        return pd.DataFrame({"key": told, "at_ms": [r[1] for r in rows], "ends": [r[2] for r in rows], "v": pd.Series([r[3] for r in rows], dtype=float)})

    shared = SharedReplay(["j", "p"], *parts)
    shared.NEAR_ROWS, shared.PACK_ROWS, shared.OUT_ROWS, shared.state, shared.held = 8, 1000, 500, _State(), _State()
    alone = {}
    for name in names:
        alone[name] = OrderedReplay(*parts)
        alone[name].state, alone[name].held = _State(), _State()
    some = 0
    for rows in batches:
        pieces = [frame(rows[k : k + 700]) for k in range(0, len(rows), 700)]
        got = pd.concat(list(shared.handleInputRows((0,), iter(pieces), None)))
        want = []
        for name in names:
            mine = [r for r in rows if r[0] == name]
            want += list(alone[name].handleInputRows(name, iter([frame(mine).drop(columns="key")]), None)) if mine else []
        as_rows = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
        assert as_rows(got) == as_rows(pd.concat(want))
        some += len(shared.held.values)
    assert some and all(json.loads(owner)["p"] == "hot" for owner, _ in shared.held.values)


def test_pages_are_dealt_to_shares(spark, monkeypatch):
    """A state row per share, not per page."""
    dealt = []
    monkeypatch.setattr(live, "SharedReplay", lambda *a: dealt.append(a) or SharedReplay(*a))
    rows = spark.readStream.format("rate").load().selectExpr("value as job_id", "0 as page_idx", "timestamp as at", "value as step", "'fast' as stage", "1 as delivery", "'ok' as outcome", "true as within_budget")
    assert live.page_states(rows, 60).columns[:3] == ["job_id", "page_idx", "step"] and dealt[0][0] == ["job_id", "page_idx"]
