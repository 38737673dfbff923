"""Helpers of the training-data operators: Arrow texts as bytes, words, hashes, shared tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.session import scratch_path, shared_folder, written

__all__ = ["checkpointed", "map_texts", "mixed", "pieces", "scratch_path", "shared_folder", "small_batches", "text_bytes", "word_hashes", "word_spans", "written"]

WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (one entry more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts of about ``size`` bytes together, each of one text at least."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, starts: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (exclusive) and text number of each maximal run of bytes outside of ``gap``; runs end with their text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~gap[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all of them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            made = np.multiply.accumulate(step)
        if n > 8 * SLICE_BYTES:
            return made
        have = _powers[kind] = made
    return have


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _power("up", len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [begin, end), the same for equal strings anywhere."""
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[begin]) * _power("down", len(prefix))[begin])


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(data), begin, end)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i, in order of words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = (total + words[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(total)


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of ``df``: ``fn`` takes a record batch and returns a dict of columns."""

    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], (pa.Array, pa.ChunkedArray)) else out[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` fixed by ``checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator works on, under names of its own, so that extra columns never clash.

    Texts may be long: Arrow batches of few rows keep the memory of Python workers bounded, also where an operator is called as a library.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in more])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
