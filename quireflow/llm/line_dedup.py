"""Exact line deduplication across documents, with levelled sorted runs of line hashes.

Method. Documents come in batches of ascending id ranges. A batch's distinct line keys are merge-anti-joined with the sorted
runs of all earlier batches: keys that some run holds belong to an earlier document, so their lines go; of the rest the least
document of the batch keeps its lines. The new keys are added as a run of level 0. When ``FANOUT`` runs of a level exist, they are
merged into one of the next level, so that a key is rewritten once per level and a batch meets few runs.

A run is a Parquet table sorted by the 16-byte hash of the key. All runs are read as one table, deduplicated by construction
(each holds only keys that no earlier run has), so one sort-merge anti-join serves all levels.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys of fewer than ``min_chars`` code
points are never dropped. Edge cases: null or empty text is one empty line; every line of the first document stays, repeats
included; rows that repeat an id form one document for the purpose of "first", and each row loses lines by its own text; a null id comes
before every other id, as one document. Other columns are passed through under any name; those called like a new column give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import scratch_path, texts, written

#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Id ranges of a whole table.
BATCHES = 4
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null id: below every id of the tables.
NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOW)


@dataclass
class LineRuns:
    """The runs of the keys seen so far, level by level, in the shared folder."""

    spark: SparkSession
    levels: dict[int, list[str]] = field(default_factory=dict)

    def seen(self) -> DataFrame | None:
        paths = [p for level in sorted(self.levels) for p in self.levels[level]]
        return self.spark.read.schema("key binary").parquet(*paths) if paths else None

    def add(self, lines: DataFrame) -> DataFrame:
        """The dropped lines (owner, text_key, pos) of a batch (owner, text_key, pos, key) whose ids are above those of all batches before it."""
        runs = self.seen()
        distinct = lines.select("key", "owner").groupBy("key").agg(F.min("owner").alias("first"), F.max("owner").alias("last"))
        if runs is None:
            fresh = distinct
        else:
            fresh = distinct.join(runs.hint("merge"), "key", "left_anti")
        fresh = written(fresh, "line_runs")
        self._push(0, fresh.select("key"))
        if runs is None:
            gone = fresh.where("first < last")
            return lines.join(gone, "key").where("owner > first").select("owner", "text_key", "pos")
        old = lines.join(runs.hint("merge"), "key", "left_semi").select("owner", "text_key", "pos")
        return old.union(lines.join(fresh.where("first < last"), "key").where("owner > first").select("owner", "text_key", "pos"))

    def _push(self, level: int, keys: DataFrame) -> None:
        path = scratch_path(self.spark, f"line_runs/level={level}")
        keys.sortWithinPartitions("key").write.parquet(path)
        self.levels.setdefault(level, []).append(path)
        if len(self.levels[level]) == FANOUT:
            merged = self.spark.read.schema("key binary").parquet(*self.levels.pop(level))
            self._push(level + 1, merged.repartitionByRange("key"))


def owner_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(owner, text_key, pos, key) of the lines whose key has ``min_chars`` code points or more; ``text_key`` tells an id's texts apart."""
    line = docs.select(owner_of(F.col("doc_id")).alias("owner"), F.xxhash64("text").alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = line.where(F.length("line") >= min_chars).select("owner", "text_key", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return key.select("owner", "text_key", "pos", F.unhex(F.md5("key")).alias("key"))


def dropped_lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(owner, pos) of every line of (doc_id, text) that goes."""
    spark = docs.sparkSession
    lines = written(keyed_lines(docs, min_chars))
    borders = sorted({b for (bs,) in lines.select(F.percentile_approx("owner", [i / batches for i in range(1, batches)])).collect() for b in bs or []})
    runs, gone = LineRuns(spark), None
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("owner") > low)
        if high is not None:
            batch = batch.where(F.col("owner") <= high)
        out = written(runs.add(batch))
        gone = out if gone is None else gone.union(out)
    return gone


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = BATCHES, *, keep: bool = False) -> DataFrame:
    """All columns of ``df`` with ``kept_text`` (null stays null), ``n_lines`` and ``n_dropped``; with ``keep`` those three and the
    whole row as a struct ``row``."""
    gone = dropped_lines(texts(df, id_col, text_col), min_chars, batches)
    lists = gone.distinct().groupBy("owner", "text_key").agg(F.collect_list("pos").alias("gone"))
    text = F.col(f"`{text_col}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text.alias("text"), owner_of(F.col(f"`{id_col}`")).alias("owner"), F.xxhash64(text).alias("text_key"))
    joined = rows.join(lists, ["owner", "text_key"], "left").withColumn("lines", lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    new = {"kept_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept), "n_lines": F.size("lines").cast("long"), "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")}
    out = joined.select("row", *[v.alias(n) for n, v in new.items()])  # a step of its own: beside columns of ``df``, names above could be taken for theirs
    return out if keep else out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in new], *new)
