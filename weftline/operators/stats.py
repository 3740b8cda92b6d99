"""Grouped and running statistics of request logs, counters and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places of a block of prefix sums.
PLACES = 1 << 20


def request_stats(log: DataFrame, seconds: str, ok: Column, by: list[str] | None = None) -> DataFrame:
    """AG4, AG27: totals, failures, share of successes, and mean, least and greatest time of successes only (null if none)."""
    time = F.when(ok, F.col(seconds))
    return log.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(100.0 * F.count_if(ok) / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("success_pct"), F.round(F.avg(time), 4).alias("mean_s"), F.min(time).alias("min_s"), F.max(time).alias("max_s"))


def type_counts(log: DataFrame, kind: str) -> DataFrame:
    """AG4: one row with a map of counts by type."""
    each = log.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("request_types"))


def running_mean(log: DataFrame, by: list[str], order: str, seconds: str, ok: Column) -> DataFrame:
    """WN5: mean time of the successes up to and with each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("mean_so_far", F.avg(F.when(ok, F.col(seconds))).over(w))


def loss_percent(sent: Column, received: Column) -> Column:
    """AG20: integer percentage lost, truncated; 0 if nothing was sent."""
    return F.when(sent > 0, F.floor((sent - received) * 100 / sent)).otherwise(0).cast("long")


def counter_replay(log: DataFrame, by: list[str], order: str, delta: Column, reset: Column) -> DataFrame:
    """AG22, WN2: value of a remote counter after each call; a reset starts a new segment at 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = log.withColumn("segment", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*by, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("value_after", F.sum(F.when(reset, 0).otherwise(delta)).over(inner))


def throughput(runs: DataFrame, items: str, elapsed: str, latency: str) -> DataFrame:
    """AG5: operations (a put and a get an item) a second and mean latency; 0 where there is nothing to measure."""
    return runs.agg(F.coalesce(F.round(2 * F.sum(items) / F.nullif(F.sum(elapsed), F.lit(0.0)), 4), F.lit(0.0)).alias("ops_per_second"), F.coalesce(F.round(F.avg(latency), 4), F.lit(0.0)).alias("mean_latency"))


def histogram(df: DataFrame, *keys) -> DataFrame:
    """AG24: counts of samples."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def connected(players: DataFrame, game: str, flag: str) -> DataFrame:
    """AG21: connected players of each game."""
    return players.groupBy(game).agg(F.count_if(F.col(flag)).alias("n_connected"))


def range_weights(balls: DataFrame, ranges: DataFrame, place: str, weight: str) -> DataFrame:
    """AG26: weight of the balls of each range (low, high; both ends included).

    Prefix sums at the two ends do it, so a ball meets no range but those it bounds; 0 for
    an empty range. Places are whole numbers; sums run within blocks of them, and over
    the blocks' own sums. The ends of the ranges are places without weight.
    """
    ends = ranges.select(F.explode(F.array(F.col("low") - 1, F.col("high"))).alias("p"), F.lit(0).alias("w"))
    total = balls.select(F.col(place).alias("p"), F.col(weight).alias("w")).unionByName(ends).groupBy("p").agg(F.sum("w").alias("w")).withColumn("block", F.floor(F.col("p") / PLACES))
    blocks = total.groupBy("block").agg(F.sum("w").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")).alias("_base"))
    inner = F.sum("w").over(Window.partitionBy("block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    sums = total.withColumn("s", inner).join(blocks, "block").withColumn("s", F.col("s") + F.col("_base"))
    low, high = sums.select((F.col("p") + 1).alias("low"), F.col("s").alias("_before")), sums.select(F.col("p").alias("high"), F.col("s").alias("_upto"))
    return ranges.join(low, "low", "left").join(high, "high", "left").select("low", "high", (F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))).alias("weight"))
