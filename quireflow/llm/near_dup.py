"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Method. A text's set holds its distinct shingles of ``k`` words (64-bit hashes). Two collections of ``m`` sub-keys, each of
``ROWS`` minhashes, are computed; every pair (one of each collection) is a table key. ``2 * m * ROWS`` minhashes thus feed
``m * m`` tables of ``2 * ROWS`` minhashes, about the square root of what separate tables would need. Two sets of similarity s
meet in a table with probability ``(1 - (1 - s^ROWS)^m)^2``; ``m`` is the smallest that loses at most ``MISS`` at the threshold.

Scale. Equal sets become one class first. A pair of sub-keys can only recur if both do, so sub-keys that occur once go before pairs are
made. Then rounds: every bucket that holds several components names one class as its pivot, every class of another component is proposed
to the pivot it shares most buckets with, and the proposals (at most one a class) are confirmed on full sets. Buckets that have become one
component drop out. When a round confirms few, what is still torn goes to an exact pass: its classes meet family by family in
blocks of bounded size, where an inverted index of shingles finds every link between different components. Sets are recomputed from the
texts where they are needed.

Edge cases. Null or blank text: empty set, linked with nothing. Fewer than ``k`` words: the whole sequence is one shingle.
Repeated rows are one class. An id that comes with several texts has a row, a set and links for each. Null ids link like others but name no
class or component unless all its ids are null. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import LOWER, checkpointed, pieces, shingle_hashes, text_bytes, texts, word_hashes, word_spans, written

#: Minhashes of a sub-key; share of links at the threshold that no table may find.
ROWS, MISS = 3, 5e-4
#: Classes of a block in the exact pass.
BLOCK = 1024
#: Rounds go on while one proposal in so many is confirmed; what they leave goes to the exact pass.
FRUITFUL = 3
_SEEDS = np.random.default_rng(771).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sub_keys(threshold: float) -> int:
    """Sub-keys of a collection for a similarity of ``threshold``."""
    m = 1
    while 1 - (1 - (1 - threshold**ROWS) ** m) ** 2 > MISS:
        m += 1
    return m


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, starts = text_bytes(column)
    for a, b in pieces(starts):
        part, at = LOWER[data[starts[a] : starts[b]]], starts[a : b + 1] - starts[a]
        begin, end, text = word_spans(part, at)
        hashes = word_hashes(part, begin, end)
        first = np.searchsorted(text, np.arange(b - a + 1))
        for i in range(b - a):
            words = hashes[first[i] : first[i + 1]]
            yield np.unique(shingle_hashes(words, min(k, len(words)))) if len(words) else words


def _signature(shingles: np.ndarray, m: int) -> np.ndarray:
    """2 * m sub-keys: those of the first collection, then those of the second."""
    n = 2 * m * ROWS
    with np.errstate(over="ignore"):
        least = np.array([((shingles ^ _SEEDS[0, i]) * _SEEDS[1, i]).min() for i in range(n)], np.uint64)
    return shingle_keys(least.reshape(2 * m, ROWS))


def shingle_keys(groups: np.ndarray) -> np.ndarray:
    return np.concatenate([shingle_hashes(g, len(g)) for g in groups])


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash, left_keys, right_keys) of (doc_id, text, text_key); keys are null for an empty set."""
    m = sub_keys(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, left, right = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys = _signature(s, m).view(np.int64) if len(s) else None
                left.append(keys if keys is None else keys[:m])
                right.append(keys if keys is None else keys[m:])
            long_list = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(left, long_list), pa.array(right, long_list)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_hash", "left_keys", "right_keys"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_hash binary, left_keys array<long>, right_keys array<long>")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, cls) of the buckets with several classes; every pair of a left and a right sub-key names a bucket."""
    slots = F.expr("concat(transform(left_keys, (k, i) -> struct(i AS slot, k AS key)), transform(right_keys, (k, i) -> struct(-1 - i AS slot, k AS key)))")
    keys = classes.select("cls", F.inline(slots))
    twice = keys.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1").select("slot", "key")
    found = keys.join(twice, ["slot", "key"], "left_semi").groupBy("cls").agg(F.collect_list(F.struct("slot", "key")).alias("keys"))
    pair = F.expr("flatten(transform(filter(keys, k -> k.slot >= 0), a -> transform(filter(keys, k -> k.slot < 0), b -> xxhash64(a.key, b.key, a.slot, b.slot))))")
    rows = found.select(F.explode(pair).alias("bucket"), "cls")
    return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket", "left_semi")


def torn(rows: DataFrame) -> DataFrame:
    """The rows (bucket, cls, label) of buckets with several labels."""
    ends = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return rows.join(ends, "bucket", "left_semi")


def proposals(rows: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """(a, b), at most one a class: with the pivot of another label that it shares most buckets with, none that was ``tested`` before.

    A bucket's pivot is its least class in turn 0, then its first in an order that changes with each turn."""
    place = F.col("cls") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    pivot = rows.groupBy("bucket").agg(F.min(F.struct(place.alias("place"), "cls", "label")).alias("p")).select("bucket", F.col("p.cls").alias("pivot"), F.col("p.label").alias("pivot_label"))
    met = rows.join(pivot, "bucket").where("label <> pivot_label").groupBy("cls", "pivot").agg(F.count("*").alias("n"))
    met = met.select("cls", "n", F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
    if tested is not None:
        met = met.join(tested, ["a", "b"], "left_anti")
    best = met.groupBy("cls").agg(F.max(F.struct("n", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _confirmer(k: int, per_cent: int):
    """Tests rows (a, b, text_a, text_b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column("text_a"), batch.column("text_b")
            keep, last, left = [], None, None
            for i, right in enumerate(shingle_sets(twos, k)):
                text = ones[i]
                if last is None or not text.equals(last):
                    last, left = text, next(shingle_sets(ones.slice(i, 1), k))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both > 0 and 100 * both >= per_cent * (len(left) + len(right) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def confirmed(edges: DataFrame, docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The edges (a, b) whose full sets have a similarity of ``per_cent`` or more."""
    one = docs.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    two = docs.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    pairs = edges.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return pairs.mapInArrow(_confirmer(k, per_cent), "a long, b long")


def rooted(labels: DataFrame) -> DataFrame:
    """(node, label) with every label followed to a node that is its own; labels never rise."""
    while True:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        found = checkpointed(labels.join(above, "label").select("node", F.col("label").alias("old"), F.col("above").alias("label")))
        labels = found.select("node", "label")
        if found.where("old <> label").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of (a, b) can reach.

    Each round leads every node down its least neighbours to one that has none below it, and goes on with the different edges between those only.
    """
    left, labels = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = rooted(checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("lower"))
        labels = lower if labels is None else checkpointed(labels.join(up, "label", "left").select("node", F.coalesce("lower", "label").alias("label")))
        ends = left.join(lower.select(F.col("node").alias("a"), F.col("label").alias("one")), "a").join(lower.select(F.col("node").alias("b"), F.col("label").alias("two")), "b")
        left = checkpointed(ends.where("one <> two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct())
        if left.isEmpty():
            return labels


def _family_links(k: int, per_cent: int):
    """Links between different labels within each block pair; rows come sorted by block pair."""

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        reps, labels = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
        kinds, counts = np.unique(labels, return_counts=True)
        if len(kinds) == 1:
            return []
        sets = list(shingle_sets(pa.array([g[2] for g in group], pa.large_string()), k))
        sizes = np.array([len(s) for s in sets], np.int64)
        values, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(token, kind="stable")
        posts, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(values)))])
        ends, out = np.cumsum(sizes), []
        roots = {v: v for v in labels.tolist()}

        def root(v: int) -> int:
            while roots[v] != v:
                roots[v] = v = roots[roots[v]]
            return v

        # of two classes with different labels, one at least is outside of the most common label
        for i in np.flatnonzero(labels != kinds[counts.argmax()]).tolist():
            mine = token[ends[i] - sizes[i] : ends[i]]
            at, n = first[mine], first[mine + 1] - first[mine]
            where = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(posts[where], minlength=len(sets))
            hits = np.flatnonzero((both > 0) & (100 * both >= per_cent * (sizes + sizes[i] - both)) & (labels != labels[i]))
            for j in hits.tolist():
                x, y = root(int(labels[i])), root(int(labels[j]))
                if x != y:
                    roots[max(x, y)] = min(x, y)
                    out.append((int(reps[min(i, j)]), int(reps[max(i, j)])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("family", "one", "two", "rep", "label", "text")), strict=True):
                if row[:3] != key:
                    if len(group) > 1:
                        yield emit(links(group))
                    key, group = row[:3], []
                group.append(row[3:])
        if len(group) > 1:
            yield emit(links(group))

    return run


def residual_links(rows: DataFrame, reps: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The links between classes of different labels that share one of the buckets in ``rows`` (bucket, cls, label), all of them torn.

    Families are what shared buckets connect; a family beyond ``BLOCK`` classes is compared block by block.
    """
    low = rows.groupBy("bucket").agg(F.min("label").alias("low"))
    left = written(rows.join(low, "bucket").select(F.col("cls").alias("rep"), "label", "low").distinct())
    family = components(left.select(F.col("label").alias("a"), F.col("low").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("family"))
    members = left.select("rep", "label").distinct().join(family, "label")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    blocks = members.join(sizes, "family").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    with_text = blocks.join(reps.select("rep", "text"), "rep")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = with_text.select("*", other).select(
        "family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "rep", "label", "text")
    laid = dealt.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "rep")
    return laid.mapInArrow(_family_links(k, per_cent), "a long, b long")


def all_links(shared: DataFrame, reps: DataFrame, k: int, per_cent: int) -> list[DataFrame]:
    """Links (a, b) that connect all classes which links connect."""
    rows, tested, links, turn = written(shared.withColumn("label", F.col("cls"))), None, [], 0
    while not rows.isEmpty():
        edges = written(proposals(rows, tested, turn))
        if edges.isEmpty():
            break
        found = written(confirmed(edges, reps, k, per_cent))
        new = found.count()
        if new:
            links.append(found)
            label = rows.select("cls", "label").distinct()
            ends = found.join(label.select(F.col("cls").alias("a"), F.col("label").alias("one")), "a").join(label.select(F.col("cls").alias("b"), F.col("label").alias("two")), "b")
            named = components(ends.select(F.col("one").alias("a"), F.col("two").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("lower"))
            rows = written(torn(rows.join(named, "label", "left").select("bucket", "cls", F.coalesce("lower", "label").alias("label"))))
        tested = edges if tested is None else tested.union(edges)
        turn += 1
        if new * FRUITFUL < edges.count():
            break
    if not rows.isEmpty():
        links.append(written(residual_links(rows, reps, k, per_cent)))
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key (``xxhash64`` of the text), n_shingles, class_id (the least id with the same set),
    component_id, kept.

    ``kept`` is true for the document whose id names its component.
    """
    docs = texts(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    signed = written(signatures(docs, k, per_cent / 100))
    first = [F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_key")).alias("chosen"), F.first("left_keys").alias("left_keys"), F.first("right_keys").alias("right_keys")]
    classes = written(signed.where("n_shingles > 0").groupBy("set_hash").agg(*first).withColumn("cls", F.monotonically_increasing_id()))
    shared = written(shared_buckets(classes))
    chosen = classes.join(shared.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("rep"), F.col("chosen.text_key").alias("chosen_key"), F.col("chosen.doc_id").alias("chosen_id"))
    texts_of = docs.join(chosen, (F.col("text_key") == F.col("chosen_key")) & F.col("doc_id").eqNullSafe(F.col("chosen_id")))
    reps = written(texts_of.groupBy("rep").agg(F.max("text").alias("text")))
    named = classes.select("set_hash", "class_id", F.col("class_id").alias("found"))
    links = all_links(shared, reps, k, per_cent)
    if links:
        labels = written(components(reduce(DataFrame.union, links)).join(classes.select(F.col("cls").alias("node"), "set_hash", "class_id"), "node"))
        least = labels.groupBy("label").agg(F.min("class_id").alias("least"))
        lower = labels.join(least, "label").select("set_hash", "least")
        named = classes.join(lower, "set_hash", "left").select("set_hash", "class_id", F.coalesce("least", "class_id").alias("found"))
    out = signed.select("doc_id", "text_key", "n_shingles", "set_hash").join(named, "set_hash", "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("found", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
