"""Replays and streams, compared with their batch forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.streaming import monitor, pipes

LOG = "seq bigint, monitor_name string, action string, process_id string, condition_name string"


def statuses(spark, commands):
    df = spark.createDataFrame([(i, "m", *c) for i, c in enumerate(commands)], LOG)
    return [(r.status, r.woken) for r in monitor.replay(df).orderBy("seq").collect()]


def test_enter_exit_errors(spark):
    got = statuses(spark, [("ENTER", "a", None), ("ENTER", "a", None), ("EXIT", "b", None), ("ENTER", "b", None), ("CHECK_GRANT", "b", None), ("EXIT", "a", None), ("CHECK_GRANT", "b", None), ("EXIT", "b", None), ("EXIT", "b", None)])
    assert [s for s, _ in got] == ["granted", "error", "error", "queued", "queued", "success", "granted", "success", "error"]


def test_wait_signal_broadcast(spark):
    got = statuses(spark, [("ENTER", "a", None), ("WAIT", "a", "c"), ("ENTER", "b", None), ("WAIT", "b", "c"), ("ENTER", "s", None), ("SIGNAL", "s", "c"), ("CHECK_AWAKENED", "a", "c"), ("CHECK_AWAKENED", "b", "c"), ("BROADCAST", "s", "c"), ("SIGNAL", "s", "c"), ("EXIT", "s", None), ("CHECK_AWAKENED", "a", "c"), ("WAIT", "a", None)])
    assert got == [("granted", None), ("waiting_on_condition", None), ("granted", None), ("waiting_on_condition", None), ("granted", None), ("success", 1), ("queued_after_signal", None), ("still_waiting_on_condition", None), ("success", 1), ("success", 0), ("success", None), ("granted_after_wait", None), ("error", None)]


def test_replay_never_has_two_owners_and_stream_agrees(spark, tmp_path):
    acts = ["ENTER", "EXIT", "WAIT", "SIGNAL", "BROADCAST", "CHECK_GRANT"]
    rows = [(i, f"m{i % 3}", acts[(i * i + i // 7) % 6], f"p{(i * 5) % 4}", "c") for i in range(300)]
    df = spark.createDataFrame(rows, LOG)
    batch = sorted(tuple(r) for r in monitor.replay(df).collect())
    assert len(batch) == 300
    owner: dict = {}
    for name, seq, status, _, now in sorted(batch, key=lambda r: r[1]):
        if status == "granted" and rows[seq][2] == "ENTER":
            assert owner.get(name) is None and now == rows[seq][3]
        owner[name] = now
    for k in range(3):
        df.where(F.col("seq").between(k * 100, k * 100 + 99)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = monitor.replay_stream(src).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM replayed").collect()) == batch


def test_publish_and_subscribe(spark, tmp_path):
    spark.createDataFrame([(1, "info", bytearray(b"\x02a")), (2, "error", bytearray(b"\x03b"))], "id int, routing_key string, body binary").write.parquet(str(tmp_path / "in"))
    src = pipes.messages(spark, str(tmp_path / "in"), "id int, routing_key string, body binary", 1)
    route = lambda df: pipes.subscribed(df, "routing_key", "").withColumn("queue", F.when(F.col("routing_key") == "error", "bad").otherwise("all"))
    q = pipes.publish(src, {"bad": str(tmp_path / "bad"), "all": str(tmp_path / "all")}, route, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "all")).select(pipes.opcode(F.col("body"))).collect()] == [2]


@pytest.mark.parametrize("mode", ["first", "counts"])
def test_stateful_streams(spark, tmp_path, mode):
    rows = [("k", "2024-01-01 00:00:00", "tcp"), ("k", "2024-01-01 01:00:00", "udp"), ("n", "2024-01-01 02:00:00", "arp")]
    spark.createDataFrame(rows, "key string, at string, proto string").select("key", F.to_timestamp("at").alias("ts"), "proto").write.parquet(str(tmp_path / "in"))
    src = pipes.messages(spark, str(tmp_path / "in"), "key string, ts timestamp, proto string")
    out = pipes.first_only(src, ["key"], "ts") if mode == "first" else pipes.live_counts(src, "proto")
    q = out.writeStream.format("memory").queryName(f"s_{mode}").outputMode("append" if mode == "first" else "complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT * FROM s_{mode}").collect()
    if mode == "first":
        assert sorted(r.key for r in got) == ["k", "n"]
    else:
        assert got[0].asDict() == {"arp": 1, "icmp": 0, "tcp": 1, "udp": 1, "ip": 2, "rest": 0, "total": 3}


def test_polled(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = pipes.polled(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), lambda df: df.where("id > 0"), lambda df: seen.append(df.count()), str(tmp_path / "cp"), 1)
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 2
