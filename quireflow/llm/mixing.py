"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame operations only.

Method. Words are dealt in blocks of ``block`` words. A source's target is its weight's share of all words, at most ``ceiling``
times its own words; what is above is reshared by weight until none is above (water level over the sources in order of ceiling per
weight). Blocks go to the sources with the highest quotients target / (2 j + 1): seats that every divisor method near the ideal
divisor grants are given at once, and only the few marginal quotients of each source are ranked. A source's blocks go to its
shards by the same rule, with the words of the shards as votes, so every quota is an integer per shard. Within a shard documents
stand in a seeded order; a quota of q blocks takes whole passes over the shard and then the first blocks of that order.

Scale. Sizes are counted in one scan. A source is cut into shards of about ``shard_docs`` documents by a hash of the id, so a source
with a third of all rows is many shards. Only sums per source and shard pass through the rankings, of which the one over sources
holds a few rows per source.

Edge cases. Null text or text without words: size 0, taken 0. Sources of no words: target 0. A null source is the last source.
Empty table: no rows. Rows that repeat an id are documents of their own; if they repeat the size too, which of them a cut
falls on is open, but the rows returned are the same. Clashing extra columns: only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import WORD, written

BLOCK_WORDS, SHARD_DOCS, CEILING, SEED = 64, 4_000, 3, 17
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, docs, source_size, target) of (source, size)."""
    sums = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sums.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)))
    placed = placed.withColumn("cap", F.col("source_size") * float(ceiling)).withColumn("per_weight", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    rising = Window.orderBy("per_weight", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    # the level if just the sources before this one are full; it holds from the first source that it does not fill
    levels = placed.withColumn("level", level).withColumn("holds", F.col("level") <= F.col("per_weight"))
    final = F.min(F.when(F.col("holds"), F.struct("per_weight", "place", "level"))).over(whole)["level"]
    return levels.withColumn("water", final).select("source", "place", "docs", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.lit(0.0)).alias("target"))


def apportioned(votes: DataFrame, within: list[str], unit: str, vote: str, seats: str) -> DataFrame:
    """``votes`` with ``quota``: the seats of each group ``within``, dealt to its units by highest quotients vote / (2 j + 1).

    ``seats`` is the group's number of seats, on each of its rows. A unit's seats differ from its rounded share by no more than its share
    of the rounding of all units plus one, so all but those marginal seats are given at once.
    """
    group = Window.partitionBy(*within)
    marked = votes.withColumn("_sum", F.sum(vote).over(group)).withColumn("_units", F.count("*").over(group))
    share = F.when(F.col("_sum") > 0, F.col(vote) / F.col("_sum")).otherwise(0.0)
    marked = marked.withColumn("_margin", F.ceil(share * F.col("_units")) + 2).withColumn("_base", F.greatest(F.lit(0), F.floor(share * F.col(seats) + 0.5) - F.col("_margin")))
    marked = marked.withColumn("_given", F.sum("_base").over(group))
    tries = marked.where(F.col(vote) > 0).select(*within, unit, vote, seats, "_base", "_given", F.explode(F.expr("sequence(_base, _base + 2 * _margin)")).alias("_j"))
    best = Window.partitionBy(*within).orderBy((F.col(vote) / (2 * F.col("_j") + 1)).desc(), unit)
    won = tries.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col(seats) - F.col("_given"))
    won = won.groupBy(*within, unit).agg(F.count("*").alias("_more"))
    left = marked.alias("l").join(won.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*within, unit]], "left")
    return left.select(*[F.col(f"l.{c}") for c in votes.columns], (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("quota"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and with ``keep`` the whole input row as ``row``."""
    columns = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")]
    if keep:
        sized = df.select(*columns, F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    else:
        sized = written(df.select(*columns))
    targets = source_targets(sized, weights, ceiling)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    counted = targets.withColumn("all", F.lit(0)).withColumn("seats", seats)
    sources = written(apportioned(counted, ["all"], "place", "target", "seats").select("source", "place", "docs", "source_size", "target", F.col("quota").alias("blocks")))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    known = sized.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    dealt = known.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.ceil(F.col("docs") / shard_docs)))
    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    quotas = written(apportioned(shards, ["place"], "shard", "shard_size", "blocks").select("place", "shard", "shard_size", "quota"))
    filled = dealt.join(quotas.withColumnRenamed("place", "p").withColumnRenamed("shard", "s"), (F.col("place") == F.col("p")) & (F.col("shard") == F.col("s")))
    before = F.sum("size").over(Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    words = F.least(F.col("quota") * block, ceiling * F.col("shard_size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    rest = words - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.coalesce(before, F.lit(0))))
    return filled.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), *["row"] * keep)
