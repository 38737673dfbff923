"""Ordered computations over keys of any size.

A window partitioned by a key puts the whole key into one task. That is right while keys are
small and wrong once one key (a model, a tenant, a busy job) holds a large share of the rows.
Every operator here measures the largest group first and takes one of two exact routes:

* groups within ``MAX_GROUP_ROWS``: an ordinary window;
* larger groups: the rows are range-partitioned by (key, order), so a big key is spread over
  many equal chunks; each chunk is scanned on its own and what the earlier chunks of the same
  key add up to is carried in. At most one key crosses each chunk border, so there are fewer
  carries than chunks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quireflow.session import shared_folder

MAX_GROUP_ROWS = 1_000_000  # rows of one key that one task may sort
CHUNK_ROWS = 500_000  # target rows per chunk on the other route
PART_ROWS = 250_000  # target rows of a partition that several windows sort in one task
MAX_BROADCAST_ROWS = 1_000_000  # rows of a narrow table that may be broadcast

_CHUNK = "_chunk"


def group_stats(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group). Counts are combined before the shuffle."""
    row = df.groupBy(*keys).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return row["n"] or 0, row["m"] or 0


def _sizes(df: DataFrame, keys: Sequence[str], known: tuple[int, int] | None) -> tuple[int, int]:
    """Measured sizes, or the upper bounds a caller already knows (from measuring the table that
    ``df`` was derived from, say): measuring ``df`` would compute it once more."""
    return known or group_stats(df, keys)


def at_least_parallel(df: DataFrame) -> DataFrame:
    """Small inputs of a few files spread over all cores; larger ones are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def together(df: DataFrame, keys: Sequence[str], sizes: tuple[int, int], max_group_rows: int = MAX_GROUP_ROWS,
             part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` hashed by ``keys``, so that windows over them follow without a shuffle: into Spark's own number of partitions, or
    more of them where those would hold more than ``part_rows`` each. Unchanged if a group is too large for a task."""
    rows, largest = sizes
    if largest > max_group_rows:
        return df
    parts = math.ceil(rows / part_rows)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; otherwise unchanged,
    so Spark shuffles (and splits skewed partitions of) the join instead."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` sorted by (keys, order) into equal chunks numbered in that order (column ``_chunk``).

    Range borders come from a sample, so they would move if the stage ran twice; the checkpoint
    fixes rows and numbers for good, also after an executor is lost.
    """
    shared_folder(df.sparkSession)
    n = max(1, math.ceil(rows / chunk_rows))
    columns = [*keys, *order]
    ranged = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return ranged.withColumn(_CHUNK, F.spark_partition_id()).checkpoint()


# --- running aggregates ------------------------------------------------------------------


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``min``, ``max`` or ``bit_or`` from the first row of the key to the current row
    (``inclusive``) or to the row before it."""

    how: str
    value: Column
    inclusive: bool = True

    def total(self) -> Column:
        return getattr(F, self.how)(self.value)

    def local(self, ordered: WindowSpec) -> Column:
        frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        return self.total().over(frame)

    def joined(self, carry: Column, local: Column) -> Column:
        if self.how == "sum":
            return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
        if self.how == "bit_or":
            return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry.bitwiseOR(local))
        return F.greatest(carry, local) if self.how == "max" else F.least(carry, local)


def row_count() -> Running:
    return Running("sum", F.lit(1).cast("long"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Running],
            max_group_rows: int = MAX_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
            sizes: tuple[int, int] | None = None) -> DataFrame:
    """``df`` plus running aggregates. ``order`` must order the rows of a key totally."""
    rows, largest = _sizes(df, keys, sizes)
    if largest <= max_group_rows:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: c.local(ordered) for name, c in columns.items()})

    chunks = ordered_chunks(df, keys, order, rows, chunk_rows)
    totals = chunks.groupBy(*keys, _CHUNK).agg(*[c.total().alias(f"_c_{name}") for name, c in columns.items()])
    by_chunk = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_CHUNK).alias("_k_chunk"),
        F.lag(_CHUNK).over(by_chunk).alias("_earlier"),
        *[getattr(F, c.how)(f"_c_{name}").over(before).alias(f"_c_{name}") for name, c in columns.items()],
    ).filter("_earlier is not null").drop("_earlier")
    match = F.col(_CHUNK) == F.col("_k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ordered = Window.partitionBy(_CHUNK, *keys).orderBy(*order)
    local = chunks.withColumns({f"_l_{name}": c.local(ordered) for name, c in columns.items()})
    # Fewer carries than chunks: at most one key crosses each border.
    joined = local.join(F.broadcast(carries), match, "left")
    return joined.select(
        *df.columns, *[c.joined(F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, c in columns.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, start: int = 1,
             **route) -> DataFrame:
    """Gap-free numbers from ``start`` in ``order`` within each key."""
    out = running(df, keys, order, {name: row_count()}, **route)
    return out.withColumn(name, F.col(name) + (start - 1)) if start != 1 else out


def totals(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], max_group_rows: int = MAX_GROUP_ROWS,
           sizes: tuple[int, int] | None = None) -> DataFrame:
    """``df`` plus aggregates over the whole of each key."""
    _, largest = _sizes(df, keys, sizes)
    if largest <= max_group_rows:
        return df.withColumns({name: total.over(Window.partitionBy(*keys)) for name, total in columns.items()})
    sums = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[total.alias(name) for name, total in columns.items()])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(sums, match).select(*df.columns, *columns)


# --- neighbours --------------------------------------------------------------------------


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int,
               columns: dict[str, Callable[[WindowSpec, WindowSpec], Column]], forward: bool = False,
               max_group_rows: int = MAX_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
               sizes: tuple[int, int] | None = None) -> DataFrame:
    """``df`` plus window columns that look at most ``reach`` rows back (or ahead, ``forward``).

    Each column is built from (ordered window, the same window framed to ``reach`` rows and the
    current row). Big keys are cut into blocks of consecutive rows; every block also gets a copy
    of the ``reach`` rows next to it, dropped again afterwards.
    """
    frame = (0, reach) if forward else (-reach, 0)
    rows, largest = _sizes(df, keys, sizes)
    if largest <= max_group_rows:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: c(ordered, ordered.rowsBetween(*frame)) for n, c in columns.items()})

    size = max(chunk_rows, reach)
    at = F.col("_rn") - 1
    placed = numbered(df, keys, order, "_rn", max_group_rows=max_group_rows, chunk_rows=chunk_rows, sizes=(rows, largest)) \
        .withColumn("_block", F.floor(at / size)).withColumn("_copy", F.lit(False))
    inside = F.pmod(at, F.lit(size))
    edge = placed.filter(inside < reach if forward else inside >= size - reach) \
        .withColumn("_block", F.col("_block") + (-1 if forward else 1)).withColumn("_copy", F.lit(True))
    ordered = Window.partitionBy(*keys, "_block").orderBy("_rn")
    out = placed.unionByName(edge) \
        .withColumns({n: c(ordered, ordered.rowsBetween(*frame)) for n, c in columns.items()})
    return out.filter(~F.col("_copy")).select(*df.columns, *columns)


# --- state-machine replay ----------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """A deterministic state machine over the ordered rows of one key.

    ``step(state, *inputs) -> (state, outputs)``; the state is None before the first row and
    otherwise made of JSON values only. ``inputs`` names columns, ``outputs`` is a DDL schema.
    """

    inputs: tuple[str, ...]
    outputs: str
    step: Callable[..., tuple[Any, tuple]]


def _folded(fold: Fold, keys: Sequence[str], batches: Iterator[pa.RecordBatch], start: tuple | None):
    """Yield (batch, output rows, first key, last key, end state) for one chunk."""
    key, state = start if start else (None, None)
    first = None
    for batch in batches:
        names = batch.schema.names
        key_rows = list(zip(*[batch.column(names.index(k)).to_pylist() for k in keys]))
        inputs = zip(*[batch.column(names.index(c)).to_pylist() for c in fold.inputs])
        out = []
        for this, values in zip(key_rows, inputs):
            if this != key:
                key, state = this, None
            first = first or this
            state, row = fold.step(state, *values)
            out.append(row)
        yield batch, out, first, key, state


def replay(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
           chunk_rows: int = CHUNK_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``df`` plus the fold's outputs, each key folded in ``order``.

    Keys of at most ``chunk_rows`` rows are folded whole after one hash shuffle. With larger keys rows
    are cut into chunks. A fold is sequential, but a chunk's result depends on the earlier chunks only through the
    state it starts with. All chunks run at once from an assumed start; chunks whose true start
    (the end state of the chunk before) turns out different run again, until nothing changes.
    The first chunk is right from the beginning, so the fixed point is exactly the sequential
    result. Limits, breakers and budgets forget quickly, so few rounds are needed; only chunks
    that lie wholly inside one key can pass a changed start on. The driver sees one state per
    chunk, never a row.
    """
    rows, largest = _sizes(df, keys, sizes)
    schema = StructType(df.schema.fields + StructType.fromDDL(fold.outputs).fields)
    added = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(fold.outputs).fields]
    if largest <= chunk_rows:  # every key fits a task: one hash shuffle and one pass
        parts = max(1, math.ceil(rows / chunk_rows), df.sparkSession.sparkContext.defaultParallelism)
        whole = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
        return whole.mapInArrow(_rows_of(fold, tuple(keys), {}, list(df.columns), added), schema)
    chunks = ordered_chunks(df, keys, order, rows, chunk_rows)
    needed = chunks.select(*dict.fromkeys([*keys, *fold.inputs, _CHUNK]))
    starts: dict[int, tuple] = {}
    if chunks.rdd.getNumPartitions() > 1:
        ends: dict[int, dict] = {}
        todo: set[int] | None = None
        while todo is None or todo:
            for row in needed.mapInArrow(_ends_of(fold, tuple(keys), dict(starts), todo), "chunk int, report string").collect():
                ends[row["chunk"]] = json.loads(row["report"])
            todo = set()
            previous = None
            for chunk in sorted(ends):
                if previous is not None and ends[previous]["key"] == ends[chunk]["first"]:
                    start = (tuple(ends[previous]["key"]), ends[previous]["state"])
                    if starts.get(chunk) != start:
                        starts[chunk] = start
                        if ends[chunk]["first"] == ends[chunk]["key"]:
                            todo.add(chunk)
                previous = chunk

    return chunks.mapInArrow(_rows_of(fold, tuple(keys), starts, list(df.columns), added), schema)


def _peek_chunk(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if batch.num_rows:
            chunk = batch.column(batch.schema.names.index(_CHUNK))[0].as_py()

            def rest(first=batch):
                yield first
                yield from batches

            return chunk, rest()
    return None, iter(())


def _ends_of(fold: Fold, keys: tuple, starts: dict, only: set[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, batches = _peek_chunk(batches)
        if chunk is None or (only is not None and chunk not in only):
            return
        first = last = state = None
        for _, _, first, last, state in _folded(fold, keys, batches, starts.get(chunk)):
            pass
        report = json.dumps({"first": first, "key": last, "state": state})
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "report": pa.array([report])})

    return run


def _rows_of(fold: Fold, keys: tuple, starts: dict, columns: list[str], added: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        if starts:
            chunk, batches = _peek_chunk(batches)
        for batch, out, *_ in _folded(fold, keys, batches, starts.get(chunk)):
            fields = [batch.column(batch.schema.names.index(c)) for c in columns]
            extra = zip(*out) if out else [[] for _ in added]
            fields += [pa.array(list(v), t) for v, (_, t) in zip(extra, added)]
            yield pa.RecordBatch.from_arrays(fields, names=columns + [n for n, _ in added])

    return run
