"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Method. Random hyperplanes give each vector a long bit string per tree; a tree is the sorted array of its strings. A query descends
every tree to its longest-prefix matches, a contiguous range of the array, and then all trees ascend together, one bit at
a time, which widens the ranges. Two vectors at angle t agree on a prefix of ``d`` bits in one of ``trees`` trees with probability
``1 - (1 - (1 - t / pi)^d)^trees``. The ascent stops once a vector as near as the worst of the k best found so far would have been
met with probability ``sure``, or at the root, which holds every vector. Found vectors are ranked by their exact cosine.

Scale. Equal vectors become one, with the k + 1 least ids (no result can hold more of them). Vectors are dealt to forests of about
``FOREST`` vectors by a hash, so a forest has a bounded size; it is built where its vectors are and never stored. Queries go to all
forests and are worked on in blocks as they stream past; the k best of each forest are merged by query.

Edge cases. Vectors that are null, zero, empty, or hold a null or a non-finite component take no part. Vectors of other lengths than
the query's are no candidates. Components
may have any finite size. Ties go to the smaller id. Fewer than k candidates: all of them. Repeated ids: each row is
a candidate; a query's own id is none. Null ids take no part. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import written

TREES, BITS, SURE, FOREST, QUERY_BLOCK = 32, 32, 0.97, 16_384, 128
SEED = 90210


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng((SEED, dimension)).standard_normal((dimension, TREES * BITS)).astype(np.float32)


def hash_strings(unit: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(vectors, trees) strings of ``BITS`` bits, the first plane's bit highest."""
    bits = (unit.astype(np.float32) @ normals > 0).reshape(len(unit), TREES, BITS)
    return np.packbits(bits, axis=2).view(">u4").reshape(len(unit), TREES).astype(np.uint32)


def stop_depth(angle: np.ndarray, sure: float) -> np.ndarray:
    """The longest prefix at which a vector at ``angle`` is met with probability ``sure``; 0 is the root."""
    one = 1 - (1 - sure) ** (1 / TREES)
    agree = np.clip(1 - angle / math.pi, 1e-9, 1 - 1e-9)
    return np.clip(np.floor(math.log(one) / np.log(agree)), 0, BITS).astype(np.int64)


class Forest:
    """Sorted arrays of the hash strings of some vectors."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray):
        self.ids, self.unit = ids, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.normals = planes(vectors.shape[1])
        strings = hash_strings(self.unit, self.normals)
        self.order = np.argsort(strings, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, where strings with the same first ``depth`` bits stand."""
        shift = BITS - depth
        low = (strings.astype(np.uint64) >> np.uint64(shift)) << np.uint64(shift)
        high = low + (np.uint64(1) << np.uint64(shift)) - np.uint64(1)
        at = [(np.searchsorted(self.sorted[t], low[:, t].astype(np.uint32)), np.searchsorted(self.sorted[t], high[:, t].astype(np.uint32), side="right")) for t in range(TREES)]
        return np.stack([a for a, _ in at], 1), np.stack([b for _, b in at], 1)

    def search(self, own: list[int], vectors: np.ndarray, k: int, sure: float) -> list[list[tuple[int, float]]]:
        """For each query the k best (id, cosine) of other ids."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        strings = hash_strings(unit, self.normals)
        best: list[list[tuple[int, float]]] = [[] for _ in own]
        open_, scores = np.arange(len(own)), np.full((len(own), len(self.ids)), np.nan)
        for depth in range(BITS, -1, -1):
            low, high = self.ranges(strings[open_], depth)
            if depth and not (high - low).sum(axis=1).max() > 0:
                continue
            kth = np.full(len(open_), -2.0)
            for i, q in enumerate(open_.tolist()):
                if depth == 0:
                    new = np.flatnonzero(np.isnan(scores[q]))
                else:
                    seen = np.zeros(len(self.ids), bool)
                    for t in range(TREES):
                        seen[self.order[t, low[i, t] : high[i, t]]] = True
                    new = np.flatnonzero(seen & np.isnan(scores[q]))
                if len(new):
                    scores[q, new] = np.einsum("ij,j->i", self.unit[new], unit[q])
                known = scores[q][~np.isnan(scores[q])]
                if len(known) > k:
                    kth[i] = np.partition(known, len(known) - k - 1)[-k - 1]
            done = (depth <= stop_depth(np.arccos(np.clip(kth, -1, 1)), sure)) & (kth > -2) if depth else np.ones(len(open_), bool)
            for q in open_[done].tolist():
                found = np.flatnonzero(~np.isnan(scores[q]))
                if len(found) > k + 1:
                    least = np.partition(scores[q][found], len(found) - k - 1)[len(found) - k - 1]
                    found = found[scores[q][found] >= least]
                rows = [(i, float(scores[q, f])) for f in found.tolist() for i in self.ids[f] if i != own[q]]
                best[q] = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
            open_ = open_[~done]
            if not len(open_):
                break
        return best


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, in double precision. Very large or small ones are scaled by a power of two, which leaves
    cosines as they are, so that no square overflows or vanishes."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))
    largest = F.array_max(F.transform("vec", F.abs))
    scale = F.when(largest > 1e100, 2.0**-600).when(largest < 1e-100, 2.0**600)
    return rows.withColumn("scale", scale).select("vec_id", F.when(F.col("scale").isNull(), F.col("vec")).otherwise(F.transform("vec", lambda x: x * F.col("scale"))).alias("vec"))


def _searcher(k: int, sure: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, forest = None, [], [], None
        asked: list[tuple[int, list[float]]] = []

        def answers() -> pa.RecordBatch:
            found = forest.search([a[0] for a in asked], np.array([a[1] for a in asked]), k, sure) if forest else []
            rows = [(a[0], i, s) for a, f in zip(asked, found, strict=False) for i, s in f]
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for size, number, query, ident, many, vec in zip(*(batch.column(c).to_pylist() for c in ("dim", "forest", "query", "vec_id", "ids", "vec")), strict=True):
                if (size, number) != key:
                    if asked:
                        yield answers()
                    key, ids, vectors, forest = (size, number), [], [], None
                if not query:
                    ids.append(many)
                    vectors.append(vec)
                    continue
                if forest is None and ids:
                    forest, vectors = Forest(ids, np.array(vectors)), []
                asked.append((ident, vec))
                if len(asked) >= QUERY_BLOCK:
                    yield answers()
        if asked:
            yield answers()

    return run


def neighbours(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, sure: float = SURE, forest: int = FOREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest found rows of ``rows`` with another id."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))  # limited before the shuffle, so a hot vector stays small
    least = usable(rows, id_col, vector_col).select("vec_id", "vec", place.alias("place")).where(F.col("place") <= k + 1)
    classes = written(least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.size("vec").alias("dim"), "ids", "vec"))
    sizes = classes.groupBy("dim").agg(F.ceil(F.count("*") / forest).alias("forests"))
    sizes = written(sizes)
    index = classes.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("vec"), F.col("forests")).alias("forest"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("vec_id"), "ids", "vec")
    asked = usable(queries, id_col, vector_col).withColumn("dim", F.size("vec")).join(sizes, "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("forests") - 1)).alias("forest"), F.lit(True).alias("query"), "vec_id", F.lit(None).cast("array<bigint>").alias("ids"), "vec")
    laid = index.unionByName(asked).repartition("dim", "forest").sortWithinPartitions("dim", "forest", "query")
    found = laid.mapInArrow(_searcher(k, sure), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
