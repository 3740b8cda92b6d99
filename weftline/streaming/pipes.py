"""Broker-like sources and sinks, deduplication and live counters on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.packets import protocol_counts


def messages(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """SC6, SC7, SC9: a queue as a folder of Parquet files; what was taken is acknowledged by the query's checkpoint, so after a failure nothing is lost or taken twice."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def subscribed(stream: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """SC8: messages whose key starts with a prefix; the empty one takes all."""
    return stream.where(F.startswith(F.col(key), F.lit(prefix)))


def opcode(message: Column) -> Column:
    """SC13: the first byte of a binary message."""
    return F.conv(F.hex(F.substring(message, 1, 1)), 16, 10).cast("int")


def publish(stream: DataFrame, exchanges: dict[str, str], route: Callable[[DataFrame], DataFrame], checkpoint: str):
    """SK4, SK5: every batch is routed and appended to the folder of each queue; returns the query, not started to wait. A batch that is repeated overwrites its own files."""

    def send(batch: DataFrame, number: int) -> None:
        routed = route(batch)
        for queue, path in exchanges.items():
            routed.where(F.col("queue") == queue).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_only(stream: DataFrame, keys: list[str], ts: str, within: str = "24 hours") -> DataFrame:
    """SR9: one row a key within a time; older keys are forgotten by the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def live_counts(stream: DataFrame, proto: str) -> DataFrame:
    """SR12: protocol counters so far (complete mode)."""
    return protocol_counts(stream, proto)


def polled(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], sink: Callable, checkpoint: str, seconds: int = 5):
    """SR10: a decision over what came in, every so many seconds."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(decide(batch))).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
