"""Quality rules with host-level verdicts.

Method. One pass counts what the rules need of every whole text. Failures of each rule are summed by host; a host's rate is
shrunk towards the mean of all hosts by a beta prior fitted to the hosts' rates by moments (their variance less what sampling
alone explains). A host whose shrunk rate of any rule exceeds ``LIMIT`` is rejected, and its verdict goes to all its documents:
few bad pages of a small host say little, many of a large one say much. A document that fails the base rule itself goes anyway.

Scale. The texts are read once and never shuffled; what is kept of a document are seven numbers. Sums per host combine before the
shuffle, so a host with a third of all rows costs one row per task. Verdicts are broadcast while there are at most
``BROADCAST_HOSTS`` hosts, otherwise joined.

Edge cases. Null or empty text: all counts 0, fails the base rule. A null host is a host like any other. Repeated rows count
as often as they occur and keep their rows. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import SPACE, pieces, shingle_hashes, text_bytes, texts, word_hashes, word_spans, written

MIN_WORDS, REPEAT_PER_CENT = 50, 50
LIMIT, BROADCAST_HOSTS = 0.5, 10_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def repeat_words(hashes: np.ndarray) -> int:
    """Words that some 3-word window covers which occurs twice or more among the words."""
    windows = shingle_hashes(hashes, 3)
    if len(windows) < 2:
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(windows)] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, all lines)."""
    lines = text.split(b"\n")
    solid = [line for line in lines if line.strip(b" \t\n\x0b\x0c\r")]
    return len(solid) - len(set(solid)), len(lines)


def counts_of(column: pa.Array) -> list[np.ndarray]:
    """The columns ``COUNTS`` of each text."""
    data, starts = text_bytes(column)
    out: list[list[np.ndarray]] = []
    for a, b in pieces(starts):
        part, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        begin, end, text = word_spans(part, at)
        first = np.searchsorted(text, np.arange(b - a + 1))
        hashes = word_hashes(part, begin, end)
        leads = ((part & 0xC0) != 0x80) & ~SPACE[part]
        lines = np.array([dup_lines(part[at[i] : at[i + 1]].tobytes()) for i in range(b - a)], np.int64).reshape(-1, 2)
        repeats = np.array([repeat_words(hashes[first[i] : first[i + 1]]) for i in range(b - a)], np.int64)
        out.append([np.diff(first), _per_text(leads, at), _per_text(SYMBOL[part], at), lines[:, 0], repeats, lines[:, 1]])
    return [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(len(COUNTS))]


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, host) with ``COUNTS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *map(pa.array, counts_of(batch.column("text")))], names=["doc_id", "host", *COUNTS])

    return docs.select("doc_id", "host", "text").mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


#: What a failure of each rule is, in SQL over ``COUNTS``.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PER_CENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_verdicts(counted: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, docs, <rule>_rate ..., rejected): shrunk failure rates of each host."""
    names = list(RULES)
    hosts = counted.groupBy("host").agg(F.count("*").alias("docs"), *[F.sum(F.expr(fail).cast("long")).alias(r) for r, fail in RULES.items()])
    hosts = written(hosts)
    rate = {r: F.col(r) / F.col("docs") for r in names}
    moments = hosts.agg(F.avg(1 / F.col("docs")).alias("per_doc"), *[a for r in names for a in (F.avg(rate[r]).alias(f"{r}_mean"), F.coalesce(F.var_samp(rate[r]), F.lit(0.0)).alias(f"{r}_var"))])
    out, rates = hosts.join(F.broadcast(moments)), []  # one row of moments
    for r in names:
        mean = F.col(f"{r}_mean")
        spread = mean * (1 - mean)
        between = F.greatest(F.col(f"{r}_var") - spread * F.col("per_doc"), spread * 1e-4)
        strength = F.when(between > 0, F.greatest(spread / between - 1, F.lit(1.0))).otherwise(1.0)
        rates.append(((F.col(r) + mean * strength) / (F.col("docs") + strength)).alias(f"{r}_rate"))
    out = out.select("host", "docs", *rates)
    return out.withColumn("rejected", F.greatest(*[F.col(f"{r}_rate") for r in names]) > limit)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, host, ``COUNTS``, base_failed, host_rejected, kept."""
    counted = written(text_counts(texts(df, id_col, text_col, host_col).withColumnRenamed(host_col, "host")))
    verdicts = host_verdicts(counted, limit).select(F.col("host").alias("judged"), "rejected")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = counted.join(verdicts, F.col("host").eqNullSafe(F.col("judged")), "left").withColumn("base_failed", F.expr(RULES["base"]))
    return out.select("doc_id", "host", *COUNTS, "base_failed", F.col("rejected").alias("host_rejected"), (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))
