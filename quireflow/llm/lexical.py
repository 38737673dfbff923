"""Ranked lexical search: the best documents of each query item, over norm buckets of impact vectors.

Method. A document's impact vector holds, for each term of the items it contains, what the term adds to a score (integers). Vectors are
ordered by falling length (Euclidean norm) and scanned in buckets of neighbours. An item is a vector of ones on its terms, so its score
is an inner product of at most sqrt(terms) * length: by Cauchy-Schwarz a bucket whose longest vector cannot reach what the item's k-th
best document already has is left out, and so are single vectors. Inside a bucket the item's coordinates are taken from the rarest on,
until the others' largest values together stay below that threshold: only vectors on these coordinates can matter, and each of them
is bounded by its sum there plus the smaller of two bounds of the rest, Cauchy-Schwarz on the remaining length and the largest values.
Survivors are scored exactly in 64-bit integers. Thresholds start from the longest vectors of the whole table, which are scored first.

Scale. Texts are read once per block of items and never shuffled: what travels is a list of (term, count) on the items' terms. Items go in
blocks of at most ``BLOCK_BYTES`` bytes of text, the only thing sent to all tasks; an item beyond that is a block of its own. Vectors are
dealt by ranges of (length, row number), so equal vectors spread over tasks. A task returns at most ``k`` rows an item, which are
ranked in parts first.

Edge cases. A null or empty text has no term and is not counted. Rows that repeat a doc_id are documents of their own; a null doc_id comes
last among equal scores. Rows that repeat an item_id (or have none) are one item with the terms of all. Items without terms give
no rows, and so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import LOWER, pieces, text_bytes, texts, word_hashes, word_spans, written

K, BLOCK_BYTES = 50, 8_000_000
#: So many of the longest vectors, about, give the first thresholds.
HEAD = 20_000
#: Partial rankings of an item.
PARTS = 32
#: Bytes that end a term: ASCII other than letters and digits.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
VECTOR = "doc_id long, row long, n long, terms array<int>, counts array<int>"


def term_keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, keys, text numbers from 0) of the terms of texts a to b: 64-bit hashes of the lower-cased bytes."""
    data, starts = text_bytes(column)
    for a, b in pieces(starts):
        part, at = LOWER[data[starts[a] : starts[b]]], starts[a : b + 1] - starts[a]
        begin, end, text = word_spans(part, at, GAP)
        yield a, b, word_hashes(part, begin, end), text


class Items:
    """The items of a block as sets of term numbers; ``keys`` are the sorted keys of all their terms."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found: dict[int | None, list[np.ndarray]] = {}
        for a, b, keys, text in term_keys(pa.array([r[1] for r in rows], pa.large_string())):
            first = np.searchsorted(text, np.arange(b - a + 1))
            for i in range(a, b):
                found.setdefault(rows[i][0], []).append(keys[first[i - a] : first[i - a + 1]])
        sets = {i: np.unique(np.concatenate(k)) for i, k in found.items()}
        self.ids = [i for i, k in sets.items() if len(k)]
        self.keys = np.unique(np.concatenate([sets[i] for i in self.ids])) if self.ids else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.keys, sets[i]) for i in self.ids]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """All items, at most ``block_bytes`` of text at a time unless a single item has more."""
    sized = items.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while blocks > 1:
        load = sized.groupBy("item_id").agg(F.sum("bytes").alias("bytes")).groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks))).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        if load.where((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    for block in range(blocks):
        yield Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()])


def term_counts(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """``VECTOR`` rows: how often each document holds which of the terms, and how many terms it has in all (``n``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for a, b, found, text in term_keys(batch.column("text")):
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = keys[at] == found
                pair, counts = np.unique(text[hit] * len(keys) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(b - a + 1) * len(keys)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32))) for values in (pair % len(keys), counts)]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.arange(row, row + b - a)), pa.array(np.bincount(text, minlength=b - a)), *lists]
                row += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, VECTOR)


class Weights:
    """What a term adds to a document's score, from counts over the whole table."""

    def __init__(self, documents: int, terms: int, holders: np.ndarray):
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)

    def damping(self, n: np.ndarray) -> np.ndarray:
        if len(n) and 50 * int(n.max()) * self.documents < 1 << 63:
            return 50 + 50 * n * self.documents // self.terms
        return 50 + np.array([50 * x * self.documents // self.terms for x in n.tolist()], np.int64)

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First entry of each document, owner, term and impact of each entry."""
        lists = batch.column("terms")
        at = lists.offsets.to_numpy()
        terms, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        m = self.damping(batch.column("n").to_numpy())[owner]
        return at - at[0], owner, terms, self.weight[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m))


def norms(batch: pa.RecordBatch, weights: Weights) -> np.ndarray:
    _, owner, _, impact = weights.impacts(batch)
    return np.sqrt(np.bincount(owner, impact.astype(np.float64) ** 2, minlength=batch.num_rows))


def with_lengths(vectors: DataFrame, weights: Weights) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("length", pa.array(norms(batch, weights)))

    return vectors.mapInArrow(run, VECTOR + ", length double")


class Bucket:
    """Vectors of similar length; ``lists`` are their entries by term."""

    def __init__(self, batch: pa.RecordBatch, weights: Weights, n_terms: int):
        self.at, self.owner, self.terms, self.impact = weights.impacts(batch)
        self.length = batch.column("length").to_numpy()
        order = np.argsort(self.terms, kind="stable")
        self.by_term_owner, self.by_term_impact = self.owner[order], self.impact[order].astype(np.float64)
        self.n_terms, self.first = n_terms, np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        self.largest = np.zeros(n_terms)
        filled = np.flatnonzero(np.diff(self.first))
        if len(filled):
            self.largest[filled] = np.maximum.reduceat(self.by_term_impact, self.first[filled])

    def candidates(self, terms: np.ndarray, least: float) -> np.ndarray:
        """The vectors that may reach ``least`` (above 0) on ``terms``."""
        nothing = np.zeros(0, np.int64)
        slack = 1 - 1e-9  # the bounds are doubles
        least *= slack
        if math.sqrt(len(terms)) * self.length.max() < least:
            return nothing
        sizes = self.first[terms + 1] - self.first[terms]
        order = np.argsort(sizes, kind="stable")
        terms, sizes = terms[order], sizes[order]
        rest = np.cumsum(self.largest[terms][::-1])[::-1]  # of this coordinate and all behind it
        if rest[0] < least:
            return nothing
        focus = int(np.searchsorted(-rest, -least, side="right"))  # coordinates from here on cannot reach it alone
        taken, counts = terms[:focus], sizes[:focus]
        where = np.repeat(self.first[taken] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owners, values = self.by_term_owner[where], self.by_term_impact[where]
        n = len(self.length)
        got, squares = np.bincount(owners, values, minlength=n), np.bincount(owners, values * values, minlength=n)
        tail = len(terms) - focus
        if tail:
            left = np.sqrt(np.maximum(self.length**2 * (1 + 1e-9) - squares, 0) * tail)
            return np.flatnonzero((got > 0) & (got + np.minimum(left, rest[focus]) >= least) & (math.sqrt(len(terms)) * self.length >= least))
        return np.flatnonzero((got > 0) & (got >= least))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``; ``wanted`` marks the item's terms."""
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        where = np.repeat(self.at[rows] - ends + sizes, sizes) + np.arange(ends[-1])
        sums = np.concatenate([[0], np.cumsum(np.where(wanted[self.terms[where]], self.impact[where], 0))])
        return sums[ends] - sums[ends - sizes]


class Best:
    """The best (score, doc_id) of an item; ``least`` is what a document needs to be one of them."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        score, doc, known = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, ~known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def scan(vectors: DataFrame, items: Items, weights: Weights, k: int, least: list[int]) -> DataFrame:
    """(item, doc_id, score): a superset of the best ``k`` of each item, at most ``k`` from a task; ``item`` is its number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, n) for n in least]
        wanted = np.zeros(len(items.keys), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = Bucket(batch, weights, len(items.keys))
            doc, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for terms, found in zip(items.terms, best, strict=True):
                rows = bucket.candidates(terms, found.least)
                if len(rows):
                    wanted[terms] = True
                    score = bucket.scores(rows, wanted)
                    wanted[terms] = False
                    good = score >= found.least
                    found.add(score[good], doc[rows[good]], known[rows[good]])
        for i, found in enumerate(best):
            if len(found.score):
                docs = pa.array(found.doc, pa.int64(), mask=~found.known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.doc), i, np.int32)), docs, pa.array(found.score)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "counts", "length").mapInArrow(run, "item int, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item with their rank, ranked in parts before they meet."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def rank_block(docs: DataFrame, items: Items, k: int, head: int) -> DataFrame | None:
    if not items.ids:
        return None
    spark = docs.sparkSession
    counted = written(term_counts(docs, items.keys))
    totals = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not totals[0]:
        return None
    holders = np.zeros(len(items.keys), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block at most
        holders[term] = n
    weights = Weights(*totals, holders)
    measured = with_lengths(counted.where(F.size("terms") > 0), weights)
    ordered = written(measured.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row"))
    part = min(1.0, head / totals[0])
    cut = ordered.agg(F.percentile_approx("length", 1 - part, 10_000)).first()[0]
    if cut is None:
        return None
    least = [1] * len(items.ids)
    for item, score in top(scan(ordered.where(F.col("length") >= cut), items, weights, k, least), k).where(F.col("rank") == k).select("item", "score").collect():  # a row per item
        least[item] = score
    best = top(scan(ordered, items, weights, k, least), k)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row per item of a block


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   *, k: int = K, block_bytes: int = BLOCK_BYTES, head: int = HEAD) -> DataFrame:
    """One row per item and rank (1 to ``k``): item_id, rank, doc_id, score; scores above 0 only, equal ones by doc_id."""
    read = texts(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    found = [r for block in item_blocks(asked, block_bytes) if (r := rank_block(read, block, k, head)) is not None]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
