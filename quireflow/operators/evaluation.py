"""Scoring predicted documents against the truth: text, boxes and tree structure.

Every pair gets a row: text and boxes are scored whatever its size, also if one side is missing; only the
tree distance is refused, with a reason: of a missing side, of misplaced nodes, and of trees above the limits, if there are any. Nodes are rows (pair_id, side, node_id, parent_id, list_pos, type, text, x, y, w, h, ord,
confidence); ``side`` is 'pred' or 'truth'. Nodes are shuffled once by pair, unless the caller says that those of a pair come ``together`` already; tasks then read them as a stream
and work on whole pairs, as many as fit some ten thousand nodes, or one larger pair. Only pairs whose tree distance is computed
carry arrays further, dealt to tasks by what their distances cost; texts are compared before that and not carried at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import boxes as boxes_fx
from quireflow.functions import shaping, text, trees
from quireflow.functions.boxes import match_groups  # by name: what runs in tasks must not reach for a module that holds UDFs
from quireflow.functions.layout import Laid, lay_out
from quireflow.operators import scan
from quireflow.session import written

NODE_SCHEMA = (
    "pair_id bigint, side string, node_id bigint, parent_id bigint, list_pos int, type string, text string, "
    "x double, y double, w double, h double, ord int, confidence double"
)
SIDES = ("pred", "truth")

# Box candidates up to this many are matched in the JVM; more go to the Arrow kernel.
BUILT_IN_CANDIDATES = 200
# Candidates of one page that may be collected into a row.
MAX_PAGE_CANDIDATES = 100_000
# Boxes of one page that are matched in one row; pages with more go through the grid.
MAX_PAGE_BOXES = 2000


# --- trees ------------------------------------------------------------------------------------

CHUNK_NODES = 65_536  # nodes worked on together; a larger pair is a chunk of its own
CELLS_PER_TASK = 100_000_000  # about ten seconds of tree distances
UNLIMITED = {"max_nodes": None, "max_cells": None}  # limits of a job that computes every distance there is


def _in_order(nodes: DataFrame, columns: Sequence[str], together: bool) -> DataFrame:
    """Nodes of a pair one after another. ``together``: they are so already, each pair in one partition, and are neither shuffled nor sorted."""
    rows = nodes.select("pair_id", (F.col("side") == SIDES[1]).alias("is_truth"), "node_id", "parent_id", "list_pos", F.col("ord").alias("_ord"), *columns)
    if together:
        return rows
    # A given number of partitions: the rows are few bytes but much work, so they must not be merged by size.
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Not by the key itself: a union below whose sides are hashed by it would do away with the shuffle, and then sides that are coalesced
    # differently leave a pair in two tasks.
    return rows.repartition(parts, F.xxhash64("pair_id")).sortWithinPartitions("pair_id")


def _siblings_in_order(table: pa.Table) -> pa.Table:
    """Whole pairs, each pred before truth, siblings in their order: those with ``ord`` by it, the others behind, then by list position and id."""
    least = np.iinfo(np.int64).min
    number = lambda name, none: pc.fill_null(table[name].cast(pa.int64()), none).to_numpy()
    late = pc.is_null(table["_ord"]).to_numpy().astype(np.int64)
    tree = 2 * (np.cumsum(_changes(table["pair_id"])) - 1) + table["is_truth"].to_numpy().astype(np.int64)
    order = np.lexsort((number("node_id", least), number("list_pos", least), number("_ord", 0), 2 * tree + late))
    return table.drop_columns(["list_pos", "_ord"]).take(pa.array(order))


def _whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Node rows, pair after pair, as tables of whole pairs (siblings in their order, if rows have what that goes by) with the number of each row's tree."""
    held: list[pa.RecordBatch] = []
    rows, cut, last = 0, None, None  # cut: (batches, rows of the next one) before the last pair

    def numbered(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if "_ord" in table.column_names:
            table = _siblings_in_order(table).combine_chunks()
        pair, truth = _changes(table["pair_id"]), table["is_truth"].to_numpy().astype(np.int8)
        fresh = pair | np.append(False, truth[1:] != truth[:-1])
        return table, np.cumsum(fresh) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch.column("pair_id"))
        new[0] = last is not None and not batch.column("pair_id").slice(0, 1).equals(last)
        at = np.flatnonzero(new)
        if len(at):
            cut = (len(held), int(at[-1]))
        held.append(batch)
        rows += batch.num_rows
        last = batch.column("pair_id").slice(batch.num_rows - 1, 1)
        if rows >= CHUNK_NODES and cut is not None:
            full, part = cut
            yield numbered(held[:full] + ([held[full].slice(0, part)] if part else []))
            held = [held[full].slice(part), *held[full + 1 :]]
            rows, cut = sum(b.num_rows for b in held), None
    if held:
        yield numbered(held)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; true for the first row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.append(True, code[1:] != code[:-1])[: len(code)]


def _laid(table: pa.Table, tree: np.ndarray) -> Laid:
    parents = table["parent_id"]
    is_page = pc.fill_null(pc.equal(table["type"], "page"), False).to_numpy() if "type" in table.column_names else np.zeros(len(tree), bool)
    return lay_out(tree, pc.fill_null(table["node_id"], -1).to_numpy(), pc.fill_null(parents, 0).to_numpy(), pc.is_null(parents).to_numpy(), is_page)


def _pair_type(nodes: DataFrame) -> str:
    return nodes.schema["pair_id"].dataType.simpleString()


def reading_order(nodes: DataFrame, columns: Sequence[str] = ("list_pos", "type", "text", "x", "y", "w", "h", "ord", "confidence"), together: bool = False) -> DataFrame:
    """Nodes with their place in reading order and the ordinal of their page (null without one), and ``columns`` of theirs."""
    inner = list(dict.fromkeys(["type", *columns]))
    kept = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in columns)
    order_of = {c: i for i, c in enumerate(inner)}
    renamed = nodes.select("pair_id", "side", "node_id", "parent_id", "list_pos", "ord", *[F.col(c).alias(f"c{i}") for c, i in order_of.items()], F.col("type").alias("type"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tree in _whole_pairs(batches):
            laid = _laid(table, tree)
            order = np.empty(len(tree), np.int64)
            order[laid.first[tree] + laid.pre] = np.arange(len(tree))
            rows = table.take(pa.array(order))
            page = laid.page[order]
            side = pc.if_else(rows["is_truth"], SIDES[1], SIDES[0])
            columns_ = [rows["pair_id"], side, rows["node_id"], rows["parent_id"], pa.array(laid.pre[order], pa.int32()), pa.array(page, pa.int32(), mask=page < 0), *[rows[f"c{order_of[c]}"] for c in columns]]
            yield from pa.Table.from_arrays(columns_, names=["pair_id", "side", "node_id", "parent_id", "pre", "page", *columns]).to_batches()

    ordered = _in_order(renamed, ["type", *[f"c{i}" for i in order_of.values()]], together)
    return ordered.mapInArrow(run, f"pair_id {_pair_type(nodes)}, side string, node_id bigint, parent_id bigint, pre int, page int" + (f", {kept}" if kept else ""))


def post_order(nodes: DataFrame, together: bool = False) -> DataFrame:
    """Nodes with post-order number, leftmost leaf, subtree size and whether they are keyroots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tree in _whole_pairs(batches):
            laid = _laid(table, tree)
            side = pc.if_else(table["is_truth"], SIDES[1], SIDES[0])
            numbers = [pa.array(v, pa.int32()) for v in (laid.post, laid.lmld, laid.post - laid.lmld + 1)]
            columns = [table["pair_id"], side, table["node_id"], *numbers, pa.array(laid.keyroot)]
            yield from pa.Table.from_arrays(columns, names=["pair_id", "side", "node_id", "post", "lmld", "size", "keyroot"]).to_batches()

    return _in_order(nodes, [], together).mapInArrow(run, f"pair_id {_pair_type(nodes)}, side string, node_id bigint, post int, lmld int, size int, keyroot boolean")


def text_streams(nodes: DataFrame, together: bool = False) -> DataFrame:
    """(pair_id, side, stream): the text of each tree's non-empty nodes in reading order, white space collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tree in _whole_pairs(batches):
            laid = _laid(table, tree)
            side = pc.if_else(table["is_truth"], SIDES[1], SIDES[0]).take(pa.array(laid.first))
            yield from pa.Table.from_arrays([table["pair_id"].take(pa.array(laid.first)), side, _streams(table, tree, laid)], names=["pair_id", "side", "stream"]).to_batches()

    found = _in_order(nodes, ["text"], together).mapInArrow(run, f"pair_id {_pair_type(nodes)}, side string, stream string")
    return found.withColumn("stream", text.collapse_spaces(F.col("stream")))


def _streams(table: pa.Table, tree: np.ndarray, laid: Laid) -> pa.Array:
    """The joined texts of each tree."""
    order = np.empty(len(tree), np.int64)
    order[laid.first[tree] + laid.pre] = np.arange(len(tree))
    words = table["text"].combine_chunks().take(pa.array(order))
    full = pc.fill_null(pc.greater(pc.binary_length(words), 0), False)
    counts = np.bincount(tree, full.to_numpy(zero_copy_only=False), minlength=len(laid.first)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), words.filter(full))
    return pc.binary_join(lists, " ")


# --- text -----------------------------------------------------------------------------------------

def text_metrics(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Character and word error counts and rates of collapsed texts ``ref`` and ``hyp``."""
    size = lambda t: F.when(F.col(t) == "", 0).otherwise(F.size(F.split(F.col(t), " ")))
    return pairs.withColumn("_e", text.edit_counts(F.col(ref), F.col(hyp))).withColumns({
        "char_edits": F.col("_e.char_edits"), "word_edits": F.col("_e.word_edits"),
        "ref_chars": F.length(ref), "hyp_chars": F.length(hyp), "ref_words": size(ref), "hyp_words": size(hyp),
    }).drop("_e").withColumns({
        "cer": F.col("char_edits") / F.greatest(F.col("ref_chars"), F.lit(1)),
        "wer": F.col("word_edits") / F.greatest(F.col("ref_words"), F.lit(1))})


def pair_documents(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer pairing on pair_id with ``state``: paired, pred_only or truth_only."""
    p, t = predicted.withColumn("_p", F.lit(True)), truth.withColumn("_t", F.lit(True))
    state = F.when(F.col("_p") & F.col("_t"), "paired").when(F.col("_p"), "pred_only").otherwise("truth_only")
    return p.join(t, "pair_id", "full").withColumn("state", state).drop("_p", "_t")


# --- boxes ----------------------------------------------------------------------------------------

def boxes(ordered: DataFrame) -> DataFrame:
    """Boxes of nodes in reading order: (pair_id, side, page, idx, type, box)."""
    boxed = F.col("x").isNotNull()
    return ordered.filter(boxed).select(
        "pair_id", "side", "page", F.col("pre").alias("idx"), F.coalesce("type", F.lit("")).alias("type"),
        F.struct("x", "y", "w", "h").alias("box"))


def box_candidates(boxes_: DataFrame) -> DataFrame:
    """Overlapping boxes of the same page (no page matches no page), found by grids of several levels: the cells of level n have
    sides of 2^n, and a box belongs to the level whose cells are just as large as it, so it touches four of them at most. Two boxes can
    only meet in the level of the larger one; each side enters its own level and the coarser ones that the other side has on the page. A
    combination counts in the first cell the two share, so it is found once."""
    keys = ["pair_id", "_page"]
    side_of = F.greatest("box.w", "box.h", F.lit(2.0**-60))
    placed = boxes_.withColumn("_page", F.coalesce("page", F.lit(-1))).withColumn("_own", F.ceil(F.log2(side_of)).cast("int"))
    levels = placed.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("side") == s, F.col("_own"))).alias(f"_{s}") for s in SIDES])  # a few numbers per page
    other = F.when(F.col("side") == SIDES[0], F.col(f"_{SIDES[1]}")).otherwise(F.col(f"_{SIDES[0]}"))
    entered = F.array_union(F.array("_own"), F.filter(other, lambda level: level > F.col("_own")))
    gridded = placed.join(levels, keys).withColumn("_level", F.explode(entered)).withColumn("_cell", F.pow(F.lit(2.0), F.col("_level")))
    for at, size in (("x", "w"), ("y", "h")):
        first = F.floor(F.col(f"box.{at}") / F.col("_cell"))
        last = F.floor((F.col(f"box.{at}") + F.col(f"box.{size}")) / F.col("_cell"))
        gridded = gridded.withColumn(f"_f{at}", first).withColumn(f"_{at}", F.explode(F.sequence(first, F.greatest(first, last))))
    gridded = gridded.select(*keys, "side", "idx", "type", "box", "_own", "_level", "_fx", "_fy", "_x", "_y")

    def half(side: str) -> DataFrame:
        return gridded.filter(F.col("side") == side).select(
            *keys, "_level", "_x", "_y", *[F.col(n).alias(f"{side}_{n.strip('_')}") for n in ("_own", "_fx", "_fy", "idx", "type", "box")])

    here = (F.col("_level") == F.greatest("pred_own", "truth_own")) & (F.col("_x") == F.greatest("pred_fx", "truth_fx")) & (F.col("_y") == F.greatest("pred_fy", "truth_fy"))
    return half("pred").join(half("truth"), [*keys, "_level", "_x", "_y"]).filter(here) \
        .withColumn("iou", shaping.iou(F.col("pred_box"), F.col("truth_box"))).filter("iou > 0") \
        .select("pair_id", F.col("_page").alias("page"), "pred_idx", "truth_idx", "pred_type", "truth_type", "iou")


def _match_few(candidates: Column) -> Column:
    free = lambda acc, k: ~F.exists(acc, lambda m: (m["p"] == k["p"]) | (m["t"] == k["t"]))
    strip = lambda k: F.struct(k["iou"].alias("iou"), k["same"].alias("same"), k["p"].alias("p"), k["t"].alias("t"))
    return F.aggregate(candidates, F.array().cast(boxes_fx.MATCHES), lambda acc, k: F.when(
        free(acc, k), F.array_append(acc, strip(k))).otherwise(acc))


def match_boxes(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one matches per (pair, page): highest IoU first, then predicted and truth
    index. Candidates never cross pages, so pages are matched independently: a page's candidates
    in one row while they are few, by rounds over all tasks otherwise."""
    page = ["pair_id", "page"]
    candidates = written(candidates)
    crowded = written(candidates.groupBy(*page).count().filter(F.col("count") > MAX_PAGE_CANDIDATES).select(*page))
    if crowded.isEmpty():
        return _match_in_rows(candidates)
    crowded = scan.broadcast_checked(crowded)
    return _match_in_rows(candidates.join(crowded, page, "left_anti")) \
        .unionByName(_match_in_rounds(candidates.join(crowded, page, "left_semi")))


def _match_in_rows(candidates: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("iou")).alias("rank"), F.col("pred_idx").alias("p"), F.col("truth_idx").alias("t"), "iou",
        (F.col("pred_type") == F.col("truth_type")).alias("same"))))
    grouped = candidates.groupBy("pair_id", "page").agg(ranked.alias("_k"))
    few = F.size("_k") <= BUILT_IN_CANDIDATES
    many = boxes_fx.match_many(F.when(~few, F.col("_k")))
    return grouped.withColumn("_m", F.when(few, _match_few(F.col("_k"))).otherwise(many)) \
        .select("pair_id", "page", F.inline("_m"))


def _match_in_rounds(candidates: DataFrame) -> DataFrame:
    """The same matches without a group in one task: a candidate that ranks first for both of its
    boxes is a match whatever the others do. Take all of those, drop what their boxes touch, and
    repeat until nothing is left."""
    page = ["pair_id", "page"]
    rest = candidates.select(*page, F.struct((-F.col("iou")).alias("rank"), F.col("pred_idx").alias("p"), F.col("truth_idx").alias("t")).alias("k"),
                             (F.col("pred_type") == F.col("truth_type")).alias("same"))
    rounds = []
    while True:
        rest = written(rest)
        if rest.isEmpty():
            break
        first_p = rest.groupBy(*page, F.col("k.p").alias("p")).agg(F.min(F.struct("k", "same")).alias("b"))
        first_t = rest.groupBy(*page, F.col("k.t").alias("t")).agg(F.min("k").alias("k"))
        won = written(first_p.select(*page, "p", F.col("b.k.t").alias("t"), F.col("b.k").alias("k"), F.col("b.same").alias("same"))
                      .join(first_t, [*page, "t", "k"], "left_semi"))
        rounds.append(won.select(*page, (-F.col("k.rank")).alias("iou"), "same", "p", "t"))
        used_p, used_t = won.select(*page, F.col("p").alias("_p")), won.select(*page, F.col("t").alias("_t"))
        rest = rest.withColumn("_p", F.col("k.p")).withColumn("_t", F.col("k.t")) \
            .join(used_p, [*page, "_p"], "left_anti").join(used_t, [*page, "_t"], "left_anti").select(*page, "k", "same")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def _match_pages(boxes_: DataFrame) -> DataFrame:
    """Matches (pair_id, iou, same) of pages with few boxes: one shuffle, then one row per page."""
    node = F.struct("idx", "type", "box")
    pages = boxes_.groupBy("pair_id", "page").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, node))).alias(s) for s in SIDES]) \
        .filter((F.size("pred") > 0) & (F.size("truth") > 0))

    def columns(side: str) -> list[Column]:
        box = F.transform(side, lambda n: n["box"])
        return [F.transform(side, lambda n: F.lit(0)), *[box[f] for f in ("x", "y", "w", "h")], F.transform(side, lambda n: n["type"])]

    matches = pages.select("pair_id", boxes_fx.match_packed(*columns("pred"), *columns("truth")).alias("_m"))
    return matches.select("pair_id", F.inline(F.arrays_zip(F.col("_m.iou").alias("iou"), F.col("_m.same").alias("same"))))


def box_metrics(boxes_: DataFrame, threshold: float = 0.5, largest_page: int | None = None) -> DataFrame:
    """Box scores per pair: mean IoU (missed truth counts 0), precision, recall and F1 at the
    threshold, and how often matched types agree. ``largest_page`` bounds the boxes of a page, if the
    caller knows a bound; otherwise pages are counted first."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    counts = boxes_.groupBy("pair_id").agg(
        F.count_if(F.col("side") == "pred").alias("predicted_boxes"),
        F.count_if(F.col("side") == "truth").alias("truth_boxes"))
    hit = F.col("iou") >= threshold
    matched = _matches(boxes_, largest_page).groupBy("pair_id").agg(
        F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"), F.count_if(hit).alias("hits"),
        F.count_if(hit & F.col("same")).alias("same_type"))
    return box_scores(counts.join(matched, "pair_id", "left"), threshold)


def _matches(boxes_: DataFrame, largest_page: int | None) -> DataFrame:
    if largest_page is not None and largest_page <= MAX_PAGE_BOXES:
        return _match_pages(boxes_)
    crowded = written(boxes_.groupBy("pair_id", "page").count().filter(F.col("count") > MAX_PAGE_BOXES)
                      .select(F.col("pair_id").alias("_pair"), F.col("page").alias("_page")))
    if crowded.isEmpty():
        return _match_pages(boxes_)
    crowded = scan.broadcast_checked(crowded)
    there = (F.col("pair_id") == F.col("_pair")) & F.col("page").eqNullSafe(F.col("_page"))
    gridded = match_boxes(box_candidates(boxes_.join(crowded, there, "left_semi")))
    return _match_pages(boxes_.join(crowded, there, "left_anti")).unionByName(gridded.select("pair_id", "iou", "same"))


def box_scores(df: DataFrame, threshold: float) -> DataFrame:
    df = df.fillna(0, ["matched", "iou_sum", "hits", "same_type", "predicted_boxes", "truth_boxes"])
    col = F.col
    share = lambda n, d, other: F.when(col(d) > 0, col(n) / col(d)).when(col(other) > 0, 0.0).otherwise(1.0)
    return df.withColumns({
        "iou_threshold": F.lit(float(threshold)),
        "mean_iou": share("iou_sum", "truth_boxes", "predicted_boxes"),
        "matched_mean_iou": F.when(col("matched") > 0, col("iou_sum") / col("matched")).otherwise(0.0),
        "precision": share("hits", "predicted_boxes", "truth_boxes"),
        "recall": share("hits", "truth_boxes", "predicted_boxes"),
        "type_accuracy": F.when(col("hits") > 0, col("same_type") / col("hits")).otherwise(0.0),
    }).withColumn("f1", F.when(col("precision") + col("recall") > 0, 2 * col("precision") * col("recall")
                               / (col("precision") + col("recall"))).otherwise(0.0)) \
        .withColumnRenamed("hits", "matches_at_threshold").drop("iou_sum", "same_type")


# --- tree distance -----------------------------------------------------------------------------------

_SIZES = "pred_nodes bigint, truth_nodes bigint, cells bigint, mirrored boolean, refused_reason string, task int, upto bigint"
_TREES = "pred_labels array<int>, pred_leaf array<int>, truth_labels array<int>, truth_leaf array<int>"
_SCORED = "hyp string, ref string, predicted_boxes bigint, truth_boxes bigint, matched bigint, iou_sum double, hits bigint, same_type bigint"


class _Pairs:
    """The pairs of a chunk: which trees they consist of, what their distance costs, and why it is refused."""

    def __init__(self, table: pa.Table, tree: np.ndarray, max_nodes: int | None, max_cells: int | None):
        self.table, self.tree, self.laid = table, tree, _laid(table, tree)
        first = self.laid.first
        self.truth = table["is_truth"].to_numpy()[first].astype(int)
        self.of = np.cumsum(_changes(table["pair_id"]))[first] - 1  # the pair of each tree
        self.count = n = int(self.of[-1]) + 1
        self.ids = table["pair_id"].take(pa.array(first[np.unique(self.of, return_index=True)[1]]))
        spread = lambda values: np.zeros((2, n), np.int64) if values is None else self._by_side(values)
        self.nodes = spread(np.diff(np.append(first, len(tree))))
        cost, turned, misplaced = spread(self.laid.cost), spread(self.laid.mirrored_cost), spread(self.laid.misplaced)
        straight, mirrored = (c[0].astype(object) * c[1] for c in (cost, turned))  # as Python numbers: those of large pairs pass 64 bits
        self.mirrored = (mirrored < straight).astype(bool)
        self.cells = np.minimum(np.minimum(straight, mirrored), np.iinfo(np.int64).max).astype(np.int64)
        reason = np.full(n, None, object)
        if max_cells is not None:
            reason[self.cells > max_cells] = "steps"
        if max_nodes is not None:
            reason[self.nodes.max(axis=0) > max_nodes] = "nodes"
        reason[misplaced.sum(axis=0) > 0] = "broken"
        reason[self.nodes.min(axis=0) == 0] = "unpaired"
        self.reason, self.admitted = reason, np.equal(reason, None)

    def _by_side(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((2, self.count), np.int64)
        out[self.truth, self.of] = values
        return out

    def arrays(self) -> list[pa.Array]:
        """Labels and leftmost leaves in post-order, in the cheaper orientation; empty where the distance is refused."""
        laid, tree, out = self.laid, self.tree, []
        labels = pc.fill_null(self.table["type"], "").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turned = self.mirrored[self.of][tree]
        post, leaf = np.where(turned, laid.mpost, laid.post), np.where(turned, laid.mlmld, laid.lmld)
        for side in (0, 1):
            sizes = np.where(self.admitted, self.nodes[side], 0)
            base = np.cumsum(sizes) - sizes
            rows = np.flatnonzero((self.truth[tree] == side) & self.admitted[self.of[tree]])
            place = base[self.of[tree[rows]]] + post[rows]
            for values in (labels, leaf):
                flat = np.empty(len(rows), np.int32)
                flat[place] = values[rows]
                out.append(pa.ListArray.from_arrays(pa.array(np.append(base, sizes.sum()), pa.int32()), pa.array(flat)))
        return out

    def counted(self, threshold: float) -> list[pa.Array]:
        """Texts of both sides and counts of boxes and matches."""
        table, laid, tree = self.table, self.laid, self.tree
        streams = _streams(table, tree, laid)
        texts = []
        for side in (0, 1):
            at = np.full(self.count, -1)
            mine = np.flatnonzero(self.truth == side)
            at[self.of[mine]] = mine
            texts.append(pc.fill_null(streams.take(pa.array(at, mask=at < 0)), ""))
        boxed = np.flatnonzero(pc.is_valid(table["x"]).to_numpy())
        kinds = pc.fill_null(table["type"], "").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pair, page = self.of[tree], laid.page
        sides = []
        for side in (0, 1):
            rows = boxed[self.truth[tree[boxed]] == side]
            rows = rows[np.lexsort((laid.pre[rows], page[rows], pair[rows]))]
            box = np.stack([pc.fill_null(table[c], np.nan).to_numpy()[rows] for c in ("x", "y", "w", "h")])
            sides.append((rows, box))
        groups, code = np.unique(np.concatenate([np.stack([pair[r], page[r]], axis=1) for r, _ in sides]), axis=0, return_inverse=True)
        cut = len(sides[0][0])
        code = code.ravel()
        group, iou, same = match_groups(code[:cut], sides[0][1], kinds[sides[0][0]], code[cut:], sides[1][1], kinds[sides[1][0]])
        of = groups[group, 0] if len(group) else group
        hit = iou >= threshold
        count = lambda at, weight=None: np.bincount(at, weight, minlength=self.count)
        numbers = [count(pair[sides[0][0]]), count(pair[sides[1][0]]), count(of), count(of, iou), count(of[hit]), count(of[hit & same])]
        kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return [*texts, *[pa.array(v.astype(float if k == pa.float64() else np.int64), k) for v, k in zip(numbers, kinds_, strict=True)]]


def pair_rows(nodes: DataFrame, max_nodes: int | None = c.MAX_TREE_NODES, max_cells: int | None = c.MAX_TREE_CELLS, with_trees: bool = False,
              threshold: float | None = None, together: bool = False) -> DataFrame:
    """One row per pair: nodes of both sides, the cells of the tree distance in the cheaper orientation (and whether that is the mirrored one),
    and why it is refused (null when it may run): 'unpaired', 'broken' (misplaced nodes), 'nodes' or 'steps', the last two not if the limit is None.
    ``with_trees`` adds the trees of admitted pairs, a ``threshold`` the texts and the counts of box matches. ``task`` and ``upto`` place the
    pair's cells (those of one task at most) in the running sum of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for table, tree in _whole_pairs(batches):
            pairs = _Pairs(table, tree, max_nodes, max_cells)
            upto = before + np.cumsum(np.where(pairs.admitted, np.minimum(pairs.cells, CELLS_PER_TASK), 0))
            before = int(upto[-1])
            columns = [pairs.ids, *[pa.array(n) for n in pairs.nodes], pa.array(pairs.cells), pa.array(pairs.mirrored), pa.array(pairs.reason, pa.string()),
                       pa.array(np.full(pairs.count, task, np.int32)), pa.array(upto)]
            columns += pairs.arrays() if with_trees else []
            columns += pairs.counted(threshold) if threshold is not None else []
            yield from pa.Table.from_arrays(columns, names=names).to_batches()

    schema = f"pair_id {_pair_type(nodes)}, {_SIZES}" + f", {_TREES}" * with_trees + f", {_SCORED}" * (threshold is not None)
    names = [part.strip().split()[0] for part in schema.replace("array<int>", "a").split(",")]
    needed = ["type"] * (with_trees or threshold is not None) + ["text", "x", "y", "w", "h"] * (threshold is not None)
    return _in_order(nodes, needed, together).mapInArrow(run, schema)


def admission_report(nodes: DataFrame, together: bool = False, **limits: int | None) -> DataFrame:
    """Sizes, cells and refusal of every pair."""
    return pair_rows(nodes, together=together, **limits).drop("task", "upto")


def dealt_by_cost(pairs: DataFrame, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """Pairs (written, with ``task`` and ``upto``) in partitions of about equal cells: each takes an interval of the running sum over all
    tasks, so it holds more than its share by one pair at most."""
    spark = pairs.sparkSession
    sums = [(r.task, r.cells) for r in pairs.groupBy("task").agg(F.max("upto").alias("cells")).orderBy("task").collect()]  # a row per task
    total = sum(cells for _, cells in sums)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // cells_per_task))
    offsets, before = [], 0
    for task, cells in sums:
        offsets.append((task, before))
        before += cells
    named = spark.createDataFrame(offsets, "task int, before bigint")
    share = F.floor((F.col("before") + F.col("upto") - 1) / max(1, -(-total // parts))).cast("int")
    return pairs.join(F.broadcast(named), "task").repartitionById(parts, F.greatest(F.lit(0), F.least(share, F.lit(parts - 1)))).drop("task", "upto", "before")


def _distance() -> Column:
    return trees.tree_distance("pred_labels", "pred_leaf", "truth_labels", "truth_leaf")


def tree_metrics(nodes: DataFrame, together: bool = False, **limits: int | None) -> DataFrame:
    """Tree edit distance on node types per pair; refused pairs keep a reason and no distance (``UNLIMITED``: no pair is refused for its size)."""
    pairs = dealt_by_cost(written(pair_rows(nodes, with_trees=True, together=together, **limits)))
    out = pairs.withColumn("ted", _distance()).select("pair_id", "pred_nodes", "truth_nodes", "cells", "refused_reason", "ted")
    return out.withColumn("ted_normalized", F.col("ted") / F.greatest("pred_nodes", "truth_nodes"))


# --- everything ----------------------------------------------------------------------------------------

def evaluate(nodes: DataFrame, threshold: float = 0.5, together: bool = False, **limits: int | None) -> DataFrame:
    """Text, box and tree scores of every pair, one row each.

    ``refused_reason`` says why a pair has no tree distance; its other scores are there all the same. A
    missing side counts as an empty document."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    pairs = pair_rows(nodes, with_trees=True, threshold=threshold, together=together, **limits)
    # Texts are compared where they are put together: only their counts are written and dealt.
    compared = text_metrics(pairs.withColumns({"ref": text.collapse_spaces(F.col("ref")), "hyp": text.collapse_spaces(F.col("hyp"))})).drop("ref", "hyp")
    scored = dealt_by_cost(written(compared)).withColumn("ted", _distance())
    return box_scores(scored, threshold).withColumn("ted_normalized", F.col("ted") / F.greatest("pred_nodes", "truth_nodes")) \
        .drop("mirrored", "cells", "pred_labels", "pred_leaf", "truth_labels", "truth_leaf")
