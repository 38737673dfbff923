"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``documents``; the last
returns packed pieces. Repeated rows stay rows of their own; near-dedup keeps all equal rows of the document that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import langid, line_dedup, mixing, near_dup, packing
from quireflow.llm.common import WORD, documents, scratch_path
from quireflow.llm.queries import small_batches, tokenizer_path

#: Tokenizing and Viterbi cannot be written in SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
#: A text goes if it has no letter or if less than this part of it is sure to be in one language.
LEAST_SCORE = 0.2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language; ``lang`` becomes the predicted one. Learns from the labelled rows that are not held out."""
    small_batches(spark)
    found = langid.identify(docs, langid.trained_on_folds(docs), keep=True)
    good = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return good.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten code points or more stay only in the least document; a text left without a word goes."""
    out = line_dedup.dedup_lines(docs, keep=True).where(F.col("kept_text").rlike(WORD))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8 or more. Of an id with several texts each is judged on its own."""
    small_batches(spark)
    kept = near_dup.near_duplicates(docs).where("kept").select("doc_id", "text_key").distinct().alias("near_dup_kept")
    same = F.col("row.doc_id").eqNullSafe(F.col("near_dup_kept.doc_id")) & (F.xxhash64("row.text") == F.col("near_dup_kept.text_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept, same, "left_semi")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of each document as often as the mix takes it, and its first words for what is left."""
    out = mixing.mix(docs, keep=True)
    copies = F.explode(F.expr("sequence(0L, (taken - 1) DIV size)")).alias("copy")
    taken = out.where("taken > 0").select("size", "taken", "row", copies).withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))
    text = F.col("row")["text"]
    cut = F.when(F.col("words") == F.col("size"), text).otherwise(mixing.first_words(text, F.col("words")))
    new = {"text": cut, "n_chars": F.length(cut).cast("long")}
    return taken.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
