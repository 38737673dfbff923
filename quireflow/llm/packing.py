"""Packing documents into sequences of a fixed length, best-fit decreasing.

Method. A document's ids, with an end id, are cut into full windows and one rest; a full window is a sequence of its own. The rests of
a shard go in order of falling length, each into the tightest open sequence that has room. A segment tree over the remaining
capacities, whose nodes count the open sequences below them, finds it in as many steps as the tree is deep.

Scale. Texts are read once and never shuffled: a piece travels as a few numbers (or with its ids if they are asked for). Shards
hold about ``SHARD`` pieces, so one task's work is bounded whatever the table's size; the loss is at most a sequence a shard.
Equal words share their ids through a bounded cache of word hashes (64 bits): the tokenizer never joins what a blank separates, so words
are encoded alone.

Edge cases. A null or empty text is its end id. Rows that repeat an id are separate documents, with rows of their own. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import LOWER, pieces, text_bytes, texts, word_hashes, word_spans, written

WINDOW, END_ID, SHARD, CACHED_WORDS = 4096, 2, 50_000, 1_500_000
ENCODED_AT_ONCE = 20_000


class WordCache:
    """Ids of words by the hash of their bytes, encoded once each; emptied when it holds more than ``CACHED_WORDS``."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.array([self.end_id], np.uint32), 1

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Adds words, whose sorted ``keys`` are new."""
        sizes, ids = [], [self.ids[: self.used]]
        for a in range(0, len(words), ENCODED_AT_ONCE):
            made = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words[a : a + ENCODED_AT_ONCE]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        first = self.used + np.cumsum(size) - size
        self.ids = np.concatenate(ids)
        self.used = len(self.ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.sizes = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.sizes, at, size)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text begins. The tokenizer lowers A-Z itself; doing it before
        makes more words equal, unless a text may hold the name of a special token, whose case counts."""
        if len(self.keys) > CACHED_WORDS:
            self.clear()
        raw = data.tobytes()
        if b"<|" not in raw:
            data = LOWER[data]
            raw = data.tobytes()
        begin, end, text = word_spans(data, starts)
        keys, sample, which = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            chosen = sample[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(begin[chosen].tolist(), end[chosen].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        # every text's words, then the end id, which stands at 0
        n = len(starts) - 1
        counts = np.bincount(text, minlength=n) + 1
        stops = np.cumsum(counts)
        first, sizes = np.zeros(int(stops[-1]), np.int64), np.ones(int(stops[-1]), np.int64)
        slot = np.arange(len(text)) + text
        first[slot], sizes[slot] = self.first[at][which], self.sizes[at][which]
        reach = np.cumsum(sizes)
        where = np.arange(reach[-1]) + np.repeat(first - (reach - sizes), sizes)
        return self.ids[where], np.concatenate([[0], reach[stops - 1]])


@lru_cache(2)
def word_cache(path: str, end_id: int) -> WordCache:
    """One cache per worker process, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordCache(path, end_id)


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full windows and the rest of each document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path, end_id)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            data, texts_at = text_bytes(batch.column("text"))
            for a, b in pieces(texts_at):
                ids, starts = cache.encode(data[texts_at[a] : texts_at[b]], texts_at[a : b + 1] - texts_at[a])
                rows = []
                for name, low, high in zip(names[a:b], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    for at in range(low, high, window):
                        raw = ids[at : min(at + window, high)].astype("<u4").tobytes()
                        rows.append((name, at - low, len(raw) // 4, zlib.crc32(raw), high - low, *[raw] * keep_ids))
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Capacities:
    """Open sequences by remaining capacity: a segment tree of counts over 0..window."""

    def __init__(self, window: int):
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        self.open.setdefault(capacity, []).append(sequence)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of least capacity at or above ``need``, taken out of the tree."""
        node, count = self.width + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.width
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; lengths fall."""
    tree, sequences, offsets, made = Capacities(window), [], [], 0
    for n in lengths:
        found = tree.tightest(n) if n < window else None
        if found is None:
            room, sequence, made = window, made, made + 1
        else:
            room, sequence = found
        sequences.append(sequence)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, sequence)
    return sequences, offsets


def _packer(window: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            base = table["shard"][0].as_py() << 32
            sequences, offsets = best_fit(table["length"].to_pylist(), window)
            used: dict[int, int] = {}
            for s, n in zip(sequences, table["length"].to_pylist(), strict=True):
                used[s] = used.get(s, 0) + n
            padded = [used[s] if used[s] & (used[s] - 1) == 0 else window for s in sequences]
            table = table.drop_columns(["shard"]).append_column("sequence_id", pa.array([base + s for s in sequences], pa.int64()))
            yield from table.append_column("offset", pa.array(offsets, pa.int64())).append_column("sequence_length", pa.array(padded, pa.int64())).select(names).to_batches()

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[0].column("shard")[0].as_py() != shards[a]:
                        yield from packed()
                        held.clear()
                    held.append(batch.slice(a, b - a))
        if held:
            yield from packed()

    return run


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length[, ids].

    ``sequence_length`` is what the sequence is padded to: ``window``, or nothing is added if its tokens are a power of two.
    """
    made = written(token_pieces(texts(df, id_col, text_col), tokenizer_path, window, end_id, keep_ids))
    shards = max(1, -(-made.count() // shard))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    laid = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + ", ids binary" * keep_ids
    return laid.mapInArrow(_packer(window, [c.split()[0] for c in schema.split(", ")]), schema)
