"""Exact order statistics, fixed-edge histograms and counters over groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.operators import scan
from quireflow.session import written


def _value_counts(df: DataFrame, keys: Sequence[str], value: str, max_group_rows: int) -> DataFrame:
    """One row per (keys, value) with the running count ``_upto`` and the group's total ``_n``.
    The counts are written once; the passes over them do not compute ``df`` again."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    counts = written(counts)  # a group's nulls are one row that counts nothing, so no group is lost
    upto = scan.running(counts, keys, [value], {"_upto": scan.Running("sum", F.col("_c"))}, max_group_rows=max_group_rows)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = upto.alias("u").join(totals.alias("t"), [F.col(f"u.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return joined.select("u.*", "t._n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], interpolate: bool = True,
              max_group_rows: int = scan.MAX_GROUP_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One row per group with exact quantiles: interpolated, or nearest rank.

    Groups small enough for one task use the built-in aggregates. Others are first counted per
    distinct value and then ranked by a running count that may span many tasks.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, wanted, interpolate, max_group_rows, sizes).drop("_all")
    _, largest = sizes or scan.group_stats(df, keys)
    built_in = F.percentile if interpolate else (lambda v, q: F.expr(f"percentile_disc({q}) within group (order by `{v}`)"))
    if largest <= max_group_rows:
        return df.groupBy(*keys).agg(*[built_in(value, q).alias(n) for n, q in wanted.items()])
    ranked = _value_counts(df, keys, value, max_group_rows)

    def at_rank(rank: Column) -> Column:  # 0-based
        return F.min(F.when((F.col("_upto") > rank) & (F.col("_c") > 0), F.col(value)))

    aggs = []
    for name, q in wanted.items():
        if interpolate:
            place = (F.col("_n") - 1) * F.lit(float(q))
            low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
            aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
        else:
            aggs.append(at_rank(F.ceil(F.col("_n") * F.lit(float(q))) - 1).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


#: Ratio of neighbouring slots: a slot's value lies within half a per cent of all values in it.
SLOT_RATIO = 1.01


def slot_of(value: Column) -> Column:
    """The slot of a positive value; 0 and below share the slot of 0 (null). Slots add up across batches, tasks and streams: from a
    millisecond to an hour there are about 1,500 of them."""
    return F.when(value > 0, F.ceil(F.ln(value) / math.log(SLOT_RATIO)))


def slot_value(slot: Column) -> Column:
    """What stands for all values of a slot."""
    return F.coalesce(2 * F.pow(F.lit(SLOT_RATIO), slot) / (SLOT_RATIO + 1), F.lit(0.0))


def sketched_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles within half a per cent, for groups of any size: rows are counted per slot before they are shuffled,
    and only the slots of a group meet. Groups without values have nulls."""
    counts = df.groupBy(*keys, slot_of(F.col(value)).alias("_slot")).agg(F.count(value).alias("_c"))
    lists = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_c") > 0, F.struct(slot_value(F.col("_slot")).alias("v"), F.col("_c").alias("c"))))).alias("_s"))
    upto = F.aggregate("_s", F.array().cast("array<struct<v:double,u:bigint>>"), lambda acc, s: F.array_append(
        acc, F.struct(s["v"].alias("v"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["u"], F.lit(0)) + s["c"]).alias("u"))))

    def at(q: float) -> Column:
        rank = F.ceil(F.col("_n") * F.lit(q))
        return F.get(F.filter("_u", lambda s: s["u"] >= rank), F.lit(0))["v"]

    return lists.withColumn("_u", upto).select(*keys, *[at(float(q)).alias(n) for n, q in wanted.items()])


def fixed_histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """(keys, le, cumulative): rows at or below each edge; a null ``le`` counts all of them."""
    sums = [F.struct(F.lit(float(e)).alias("le"), F.count_if(F.col(value) <= e).alias("cumulative")) for e in edges]
    every = F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("cumulative"))
    return df.groupBy(*keys).agg(F.array(*sums, every).alias("_b")).select(*keys, F.inline("_b"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Quantile by interpolating inside the first bucket that reaches it (buckets as made by
    ``fixed_histogram``: a bounded number per group, so they fit one array)."""
    ordered = F.array_sort(F.collect_list(F.struct(
        F.coalesce("le", F.lit(float("inf"))).alias("le"), F.col("cumulative").alias("n"))))
    grouped = buckets.groupBy(*keys).agg(ordered.alias("_b")).withColumn("_n", F.element_at("_b", -1)["n"])
    target = F.col("_n") * F.lit(float(q))
    reached = F.filter("_b", lambda b: b["n"] >= target)[0]
    below = F.filter("_b", lambda b: b["n"] < target)
    last = F.when(F.size(below) > 0, F.element_at(below, -1))
    low, before = F.coalesce(last["le"], F.lit(0.0)), F.coalesce(last["n"], F.lit(0))
    width = (reached["le"] - low) * (target - before) / (reached["n"] - before)
    highest = F.element_at("_b", -2)["le"]
    value = F.when(F.col("_n") == 0, F.lit(None)).when(F.isnan(reached["le"]) | (reached["le"] == float("inf")), highest) \
        .otherwise(low + width)
    return grouped.select(*keys, value.cast("double").alias("quantile"))


def counter_increase(samples: DataFrame, keys: Sequence[str], seconds: int, group: Sequence[str],
                     **route) -> DataFrame:
    """Increase and rate of counters per window: differences between neighbouring samples of a
    series, a drop counting from zero. No extrapolation to the window's edges."""
    stepped = scan.neighbours(
        samples, keys, ["ts", "value"], 1, {"_last": lambda ordered, _: F.lag("value").over(ordered)}, **route)
    value, last = F.col("value"), F.col("_last")
    delta = F.when(last.isNull(), 0.0).when(value < last, value).otherwise(value - last)
    start = (F.floor(F.unix_seconds("ts") / seconds) * seconds).alias("window_start")
    return stepped.groupBy(*group, start).agg(F.sum(delta).alias("increase")) \
        .withColumn("rate", F.col("increase") / seconds)


def latest_gauge(samples: DataFrame, series: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Highest of the latest values of a gauge's series."""
    latest = samples.groupBy(*dict.fromkeys([*group, *series])).agg(
        F.max(F.struct("ts", "value"))["value"].alias("value"))
    return latest.groupBy(*group).agg(F.max("value").alias("value"))


def trend(samples: DataFrame, key: str, at: str, value: str, warm_up: float = 0.25,
          **route) -> DataFrame:
    """Peak and least-squares slope per key, the slope without the first ``warm_up`` of samples.

    A slope without spread is 0."""
    placed = scan.numbered(samples, [key], [at, value], "_rn", 0, **route)
    totals = samples.groupBy(key).agg(F.count("*").alias("_n"), F.max(value).alias("peak"))
    sized = placed.join(scan.broadcast_checked(totals), key)
    steady = F.col("_rn") >= F.floor(F.col("_n") * warm_up)
    slope = F.regr_slope(F.when(steady, F.col(value)), F.when(steady, F.col(at)))
    return sized.groupBy(key).agg(
        F.max("peak").alias("peak"), F.max("_n").alias("samples"),
        F.coalesce(F.when(F.count_if(steady) >= 2, slope), F.lit(0.0)).alias("slope"))
