"""Queries: replays and stateful operations, in their batch form (the streams are tested against it)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.tables import load
from weftline.sources.serde import write_csv
from weftline.streaming import monitor, pipes


def command_log(events):
    """Commands made of the events, a monitor for each user; three processes take turns."""
    e, k = F.col("event_type"), F.col("event_id")
    action = F.when(e == "click", "ENTER").when(e == "view", "EXIT").when(e == "purchase", "WAIT").when(e == "signup", "SIGNAL").otherwise("BROADCAST")
    return events.select(k.alias("seq"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("monitor_name"), action.alias("action"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("process_id"), F.when(e.isin("purchase", "signup", "error"), F.concat(F.lit("c"), (k % 2).cast("string"))).alias("condition_name"))


#: The monitor's rules once more, a step a command: owner, enter queue and the two conditions' queues of each monitor.
MONITOR_SQL = """
WITH RECURSIVE log AS (SELECT event_id AS seq, 'm' || user_id AS m, CASE event_type WHEN 'click' THEN 'ENTER' WHEN 'view' THEN 'EXIT' WHEN 'purchase' THEN 'WAIT' WHEN 'signup' THEN 'SIGNAL' ELSE 'BROADCAST' END AS a, 'p' || (event_id % 3) AS p, event_id % 2 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(m, k, seq, owner, enter, c0, c1, status, woken) AS (
SELECT DISTINCT m, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM log
UNION ALL
SELECT m, k, seq,
  CASE WHEN act = 'grant' THEN p WHEN act IN ('EXIT', 'WAIT') THEN enter[1] ELSE owner END,
  CASE WHEN act IN ('grant', 'EXIT', 'WAIT') THEN enter[2:] WHEN act = 'queue' THEN list_append(enter, p) WHEN act IN ('SIGNAL', 'BROADCAST') THEN list_concat(enter, q[1:n]) ELSE enter END,
  CASE WHEN c = 0 AND act = 'WAIT' THEN list_append(c0, p) WHEN c = 0 AND act IN ('SIGNAL', 'BROADCAST') THEN c0[n + 1:] ELSE c0 END,
  CASE WHEN c = 1 AND act = 'WAIT' THEN list_append(c1, p) WHEN c = 1 AND act IN ('SIGNAL', 'BROADCAST') THEN c1[n + 1:] ELSE c1 END,
  CASE act WHEN 'grant' THEN 'granted' WHEN 'queue' THEN 'queued' WHEN 'still' THEN 'queued' WHEN 'error' THEN 'error' WHEN 'WAIT' THEN 'waiting_on_condition' ELSE 'success' END,
  CASE WHEN act IN ('SIGNAL', 'BROADCAST') THEN CAST(n AS INTEGER) END
FROM (SELECT *, CASE WHEN a = 'BROADCAST' THEN len(q) ELSE least(1, len(q)) END AS n FROM (
  SELECT l.m, l.k, l.seq, l.p, l.c, f.owner, f.enter, f.c0, f.c1, l.a, CASE WHEN l.c = 0 THEN f.c0 ELSE f.c1 END AS q,
    CASE WHEN l.a = 'ENTER' THEN CASE WHEN coalesce(f.owner = l.p, false) THEN 'error' WHEN f.owner IS NULL AND (len(f.enter) = 0 OR f.enter[1] = l.p) THEN 'grant' WHEN list_contains(f.enter, l.p) THEN 'still' ELSE 'queue' END
      WHEN coalesce(f.owner = l.p, false) THEN l.a ELSE 'error' END AS act
  FROM f JOIN log l ON l.m = f.m AND l.k = f.k + 1)))
SELECT m AS monitor_name, seq, status, woken, owner FROM f WHERE k > 0
"""


@query(MONITOR_SQL)
def monitor_replay(spark, d):
    """SR1, SR2, SR3, M7."""
    return monitor.replay(command_log(load(spark, d, "events")))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_first(spark, d):
    """SR9 over a whole log: the first row of each key."""
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id FROM events WHERE starts_with(event_type, 'p')")
def prefix_subscription(spark, d):
    """SC8."""
    from weftline.streaming.pipes import subscribed

    return subscribed(load(spark, d, "events"), "event_type", "p").select("event_id")


def scratch(spark, name):
    """A folder of its own for a query, below the shared one; on one machine without such a folder, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="weftline-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def queued(spark, d, folder):
    """The events put into a queue (a folder), and a stream that takes them from it, some files at a time."""
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type")
    rows.write.parquet(f"{folder}/queue")
    return pipes.messages(spark, f"{folder}/queue", "event_id bigint, user_id bigint, event_type string", 2)


@query("SELECT 'errors' AS queue, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'rest', event_id FROM events WHERE event_type <> 'error'")
def queue_relay(spark, d):
    """SC6, SC7, SC9, SK4, SK5: a queue is consumed as a stream, and each message published to a queue of its own."""
    folder = scratch(spark, "relay")
    route = lambda df: df.withColumn("queue", F.when(F.col("event_type") == "error", "errors").otherwise("rest"))
    pipes.publish(queued(spark, d, folder), {q: f"{folder}/{q}" for q in ("errors", "rest")}, route, f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/errors").unionByName(spark.read.parquet(f"{folder}/rest")).select("queue", "event_id")


@query("SELECT count(*) FILTER (event_type = 'signup') AS arp, count(*) FILTER (event_type = 'error') AS icmp, count(*) FILTER (event_type = 'click') AS tcp, count(*) FILTER (event_type = 'view') AS udp, count(*) FILTER (event_type IN ('error', 'click', 'view')) AS ip, count(*) FILTER (event_type = 'purchase') AS rest, count(*) AS total FROM events")
def live_counters(spark, d):
    """SR12: protocol counters of a stream, as they stand when all has come in."""
    folder = scratch(spark, "counters")
    proto = F.create_map(*[F.lit(x) for x in ("signup", "arp", "error", "icmp", "click", "tcp", "view", "udp")])
    counts = pipes.live_counts(queued(spark, d, folder).select(F.coalesce(F.element_at(proto, F.col("event_type")), F.lit("rest")).alias("proto")), "proto")
    last = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    counts.writeStream.foreachBatch(last).outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


@query("SELECT user_id, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents, min(event_type) AS first_type FROM events GROUP BY 1")
def csv_rows(spark, d):
    """SK1: rows written as CSV with a header and read again."""
    path = scratch(spark, "csv")
    rows = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100)).cast("long").alias("cents"), F.min("event_type").alias("first_type"))
    write_csv(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema, enforceSchema=False)


@query("SELECT event_id, user_id, event_type FROM events")
def csv_appended(spark, d):
    """SK10: samples appended to CSV files without a header, in two goes."""
    path = scratch(spark, "samples")
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type")
    for part in (0, 1):
        write_csv(rows.where(F.col("event_id") % 2 == part), path, header=False, append=True)
    return spark.read.csv(path, schema=rows.schema)
