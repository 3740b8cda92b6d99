"""Message routing: exchanges, work queues, assignments, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route_direct(messages: DataFrame, bindings: DataFrame, key: str = "routing_key", pattern: str = "pattern") -> DataFrame:
    """JN3: messages to the queues bound with their routing key; one delivery a queue however many bindings match."""
    once = bindings.select("queue", F.col(pattern).alias(key)).distinct()
    return messages.join(once, key)


def topic_regex(pattern: Column) -> Column:
    """Regular expression of a topic pattern: * is one word, # any number of them, words are parted by dots."""
    words = F.transform(F.split(pattern, r"\."), lambda w: F.when(w == "*", F.lit(r"\.[^.]+")).when(w == "#", F.lit(r"(?:\.[^.]+)*")).otherwise(F.concat(F.lit(r"\.\Q"), w, F.lit(r"\E"))))
    return F.concat(F.lit("^"), F.array_join(words, ""), F.lit("$"))


def route_topic(messages: DataFrame, bindings: DataFrame, key: str = "routing_key", pattern: str = "pattern") -> DataFrame:
    """JN4: messages to the queues with a pattern that matches; one delivery a queue.

    Patterns meet the distinct routing keys only; messages then join their key's queues
    by equality. A pattern that begins with a word meets the keys of that first word, one
    that ends with a word those of that last word, and one without either must be compared
    with every key, as it can match any: their list is sent to the keys.
    """
    keys = messages.select(key).distinct()
    parts = bindings.select("queue", topic_regex(F.col(pattern)).alias("_re"), F.split(pattern, r"\.").alias("_w")).distinct()
    wild = F.array(F.lit("*"), F.lit("#"))
    first, last = F.element_at("_w", 1), F.element_at("_w", -1)
    by_first = parts.where(~F.array_contains(wild, first)).select("queue", "_re", first.alias("_end"))
    by_last = parts.where(F.array_contains(wild, first) & ~F.array_contains(wild, last)).select("queue", "_re", last.alias("_end"))
    free = parts.where(F.array_contains(wild, first) & F.array_contains(wild, last)).select("queue", "_re")
    told = keys.withColumns({"_first": F.element_at(F.split(key, r"\."), 1), "_last": F.element_at(F.split(key, r"\."), -1)})
    match = F.expr(f"concat('.', {key}) RLIKE _re")
    met = told.join(by_first, F.col("_first") == F.col("_end")).where(match).select(key, "queue")
    met = met.unionByName(told.join(by_last, F.col("_last") == F.col("_end")).where(match).select(key, "queue"))
    met = met.unionByName(told.join(free, match).select(key, "queue"))
    return messages.join(met.distinct(), key)


def route_fanout(messages: DataFrame, queues: list[str]) -> DataFrame:
    """JN5: every message to every queue; the queues are a list, so each row is multiplied where it is."""
    return messages.select("*", F.explode(F.array(*[F.lit(q) for q in queues])).alias("queue"))


def competing(messages: DataFrame, seq: str, workers: int) -> DataFrame:
    """JN6: each message to exactly one of the workers; which one is left to a broker, here it is the number modulo workers."""
    return messages.withColumn("worker", F.pmod(F.col(seq), F.lit(workers)))


def work_split(n: Column, workers: Column, worker: Column) -> Column:
    """WN8: items of a worker (from 0) when n are split, the remainder going to the first ones."""
    share = F.floor(n / workers)
    return (share + F.when(worker < F.pmod(n, workers), 1).otherwise(0)).cast("long")


def round_robin(df: DataFrame, by: list[str], order: str, ring: int) -> DataFrame:
    """WN6: place in a ring that is walked in order."""
    return df.withColumn("ring_place", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(order)), F.lit(ring)).cast("int"))


def oldest(df: DataFrame, queue: str, seq: str) -> DataFrame:
    """SL10: the first in of each queue."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(queue).orderBy(seq))).where("_k = 1").drop("_k")


def assign_games(players: DataFrame, assigned: DataFrame, player: str, game: str, seats: int = 2) -> DataFrame:
    """JN11: a player with a game rejoins it; new ones fill games of so many seats in the order of their id.

    New players are numbered by a sort in which each partition counts on from the ones
    before it, so no task sees them all; full games are numbered after the assigned ones.
    """
    held = assigned.select(player, game)
    known = players.join(held, player)
    fresh = players.join(held, player, "left_anti").select(player)
    first = assigned.agg((F.coalesce(F.max(game), F.lit(0)) + 1).alias("_first"))
    numbered = numbered_from_zero(fresh, player).crossJoin(F.broadcast(first))  # one row
    return known.select(player, game, F.lit(True).alias("rejoined")).unionByName(numbered.select(player, (F.col("_first") + F.floor(F.col("_n") / seats)).cast("long").alias(game), F.lit(False).alias("rejoined")))


def numbered_from_zero(df: DataFrame, key: str) -> DataFrame:
    """df with _n, its place in key order from 0: ranges are sorted apart, and each counts on from the sizes of those before it.

    The bounds of the ranges come from a sample, so the ranges are settled before they are used twice.
    """
    ranged = settled(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.withColumn("_k", inner).join(F.broadcast(before), "_p").withColumn("_n", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")  # a row a partition


def settled(df: DataFrame) -> DataFrame:
    """df with rows that no longer change: in the folder that spark.checkpoint.dir names; without one only on one machine, where no executor is lost, kept in memory and on disk."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return df.persist()
