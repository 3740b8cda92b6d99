"""Queries: request statistics, counters, routing, sessions, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import intervals as I
from weftline.operators import packets as K
from weftline.operators import routing as R
from weftline.operators import signal as G
from weftline.operators import stats as S
from weftline.plans.registry import query
from weftline.sources.tables import load

OK = F.col
SQL_STATS = "count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(100.0 * count(*) FILTER (event_type <> 'error') / greatest(1, count(*)), 4) AS success_pct, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_s, min(value) FILTER (event_type <> 'error') AS min_s, max(value) FILTER (event_type <> 'error') AS max_s"


def _events(spark, d):
    return load(spark, d, "events")


@query(f"SELECT {SQL_STATS} FROM events")
def request_stats(spark, d):
    """AG4."""
    return S.request_stats(_events(spark, d), "value", F.col("event_type") != "error")


@query(f"SELECT event_type, {SQL_STATS} FROM events GROUP BY event_type")
def client_stats(spark, d):
    """AG27."""
    return S.request_stats(_events(spark, d), "value", F.col("event_type") != "error", ["event_type"])


@query("SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS request_types FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def type_counts(spark, d):
    """AG4, M9: the map of counts by type, written out."""
    m = S.type_counts(_events(spark, d), "event_type")
    return m.select(F.array_join(F.transform(F.map_entries("request_types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("request_types"))


@query("SELECT event_id, avg(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mean_so_far FROM events")
def running_mean(spark, d):
    """WN5: in whole hundredths, so no order of summing shows."""
    log = _events(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return S.running_mean(log, ["user_id"], "event_id", "value", F.col("event_type") != "error").select("event_id", "mean_so_far")


@query("SELECT user_id, CAST(CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (event_type <> 'error')) * 100 // count(*) ELSE 0 END AS BIGINT) AS loss FROM events GROUP BY user_id")
def loss_percent(spark, d):
    """AG20."""
    each = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("tx"), F.count_if(F.col("event_type") != "error").alias("rx"))
    return each.select("user_id", S.loss_percent(F.col("tx"), F.col("rx")).alias("loss"))


@query("""SELECT event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value_after FROM (
SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)""")
def counter_replay(spark, d):
    """AG22, WN2: increments, decrements and resets."""
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return S.counter_replay(_events(spark, d), ["user_id"], "event_id", delta, F.col("event_type") == "signup").select("event_id", "value_after")


@query("SELECT coalesce(round(2 * sum(l_quantity) / nullif(sum(l_tax), 0), 4), 0) AS ops_per_second, coalesce(round(avg(l_discount), 4), 0) AS mean_latency FROM lineitem")
def throughput(spark, d):
    """AG5."""
    return S.throughput(load(spark, d, "lineitem"), "l_quantity", "l_tax", "l_discount")


PROTO = "CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'udp' WHEN 'error' THEN 'icmp' WHEN 'signup' THEN 'arp' WHEN 'purchase' THEN 'other_ip' ELSE 'rest' END"


@query(f"SELECT count(*) FILTER (p = 'arp') AS arp, count(*) FILTER (p = 'icmp') AS icmp, count(*) FILTER (p = 'tcp') AS tcp, count(*) FILTER (p = 'udp') AS udp, count(*) FILTER (p IN ('icmp', 'tcp', 'udp', 'other_ip')) AS ip, count(*) FILTER (p = 'rest') AS rest, count(*) AS total FROM (SELECT {PROTO} AS p FROM events)")
def protocol_counts(spark, d):
    """AG3, PF13: protocols by way of header fields."""
    e = F.col("event_type")
    frames = _events(spark, d).select(F.when(e == "signup", K.ARP).when(e.isin("click", "view", "error", "purchase"), K.IPV4).otherwise(1).alias("t"), F.when(e == "click", K.TCP).when(e == "view", K.UDP).when(e == "error", K.ICMP).otherwise(99).alias("p"))
    return K.protocol_counts(frames.select(K.protocol(F.col("t"), F.col("p")).alias("proto")), "proto")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 0 AND (event_id % 100 = 53 OR event_id % 90 = 53)")
def dns_filter(spark, d):
    """PF12: the predicate on parsed columns."""
    c = F.col
    parsed = _events(spark, d).select("event_id", F.when(c("user_id") % 2 == 0, K.IPV4).otherwise(K.ARP).alias("ethertype"), F.lit(0).alias("frag_offset"), F.when(c("event_type") == "view", K.UDP).otherwise(K.TCP).alias("ip_proto"), (c("event_id") % 100).alias("src_port"), (c("event_id") % 90).alias("dst_port"))
    return parsed.where(K.is_dns()).select("event_id")


@query("SELECT a.event_id, b.event_id AS reply_id, b.event_id - a.event_id AS rtt FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id + 1 = b.event_id")
def reply_matching(spark, d):
    """JN14, MA17: replies by id and source."""
    e = _events(spark, d)
    asked = e.select("user_id", (F.col("event_id") + 1).alias("k"), "event_id", F.col("event_id").alias("sent"))
    got = e.select("user_id", F.col("event_id").alias("k"), F.col("event_id").alias("reply_id"), F.col("event_id").alias("received"))
    return K.replies(asked, got, ["user_id", "k"]).select("event_id", "reply_id", "rtt")


DIRECT = [("q1", "error"), ("q1", "signup"), ("q2", "click"), ("q2", "click"), ("q3", "nothing")]
TOPIC = [("all", "#"), ("clicks", "*.click"), ("errors", "u1.*"), ("errors", "#.error"), ("odd", "u3.#.view")]


def _bindings(spark, rows):
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(q).alias("queue"), F.lit(p).alias("pattern")) for q, p in rows])))


@query("SELECT DISTINCT event_id, queue FROM events JOIN (VALUES ('q1', 'error'), ('q1', 'signup'), ('q2', 'click'), ('q2', 'click'), ('q3', 'nothing')) b(queue, k) ON event_type = k")
def route_direct(spark, d):
    """JN3."""
    return R.route_direct(_events(spark, d).select("event_id", F.col("event_type").alias("routing_key")), _bindings(spark, DIRECT)).select("event_id", "queue")


@query(r"SELECT DISTINCT event_id, queue FROM (SELECT event_id, 'u' || (user_id % 5) || '.' || event_type AS k FROM events) JOIN (VALUES ('all', '^.*$'), ('clicks', '^[^.]+\.click$'), ('errors', '^u1\.[^.]+$'), ('errors', '^([^.]+\.)*error$'), ('odd', '^u3(\.[^.]+)*\.view$')) b(queue, re) ON regexp_matches(k, re)")
def route_topic(spark, d):
    """JN4: * is a word, # any number of words."""
    key = F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"), F.lit("."), F.col("event_type"))
    return R.route_topic(_events(spark, d).select("event_id", key.alias("routing_key")), _bindings(spark, TOPIC)).select("event_id", "queue")


@query("SELECT event_id, queue FROM events CROSS JOIN (VALUES ('a'), ('b'), ('c')) q(queue)")
def route_fanout(spark, d):
    """JN5."""
    return R.route_fanout(_events(spark, d).select("event_id"), ["a", "b", "c"])


@query("SELECT event_id, event_id % 4 AS worker FROM events")
def work_split(spark, d):
    """JN6."""
    return R.competing(_events(spark, d).select("event_id"), "event_id", 4)


@query("SELECT k AS worker, CAST((1003 // 7) + CASE WHEN k < 1003 % 7 THEN 1 ELSE 0 END AS BIGINT) AS items FROM (SELECT unnest(range(7)) AS k)")
def split_shares(spark, d):
    """WN8."""
    return spark.range(7).select(F.col("id").alias("worker"), R.work_split(F.lit(1003), F.lit(7), F.col("id")).alias("items"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 3 AS INTEGER) AS ring_place FROM events")
def round_robin(spark, d):
    """WN6."""
    return R.round_robin(_events(spark, d), ["user_id"], "event_id", 3).select("event_id", "ring_place")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def fifo_heads(spark, d):
    """SL10."""
    return R.oldest(_events(spark, d), "event_type", "event_id").select("event_type", "event_id")


@query("""WITH known AS (SELECT c_custkey, c_custkey // 10 AS game FROM customer WHERE c_custkey % 10 = 0), fresh AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey % 10 <> 0)
SELECT c_custkey, CAST(game AS BIGINT) AS game, true AS rejoined FROM known UNION ALL SELECT c_custkey, CAST((SELECT max(game) + 1 FROM known) + n // 2 AS BIGINT), false FROM fresh""")
def game_assignment(spark, d):
    """JN11: players rejoin their game or fill the next one."""
    players = load(spark, d, "customer").select("c_custkey")
    known = players.where("c_custkey % 10 = 0").select("c_custkey", F.expr("c_custkey div 10").alias("game"))
    return R.assign_games(players, known, "c_custkey", "game")


@query("""SELECT user_id, CAST(k AS BIGINT) AS session, min(t) AS start_s, max(t) AS end_s, count(*) AS n FROM (SELECT user_id, t, sum(CASE WHEN t - p < 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, k""")
def session_expiry(spark, d):
    """SR8: activity spans closed by silence (a day here)."""
    return I.sessions(_events(spark, d), ["user_id"], "ts", 86400)


@query("""WITH x AS (SELECT event_id AS k, epoch(ts) AS s, epoch(ts) + 600 AS e FROM events) SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.k < b.k AND a.s < b.e AND b.s < a.e""")
def interval_overlap(spark, d):
    """JN12: critical sections that overlap."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return I.overlaps(_events(spark, d).select("event_id", t.alias("s"), (t + 600).alias("e")), "event_id", "s", "e", 600.0)


@query("SELECT l_returnflag, count(*) FILTER (q > n) = 0 AS is_sorted FROM (SELECT l_returnflag, l_quantity AS q, lead(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey) AS n FROM lineitem) GROUP BY 1")
def sort_check(spark, d):
    """WN4, SL3-SL5: sorted by value, so sorted."""
    rows = load(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.struct("l_quantity", "l_orderkey").alias("o"))
    return I.is_sorted(rows, ["l_returnflag"], "o", "l_quantity")


@query("SELECT l_quantity AS v FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_partkey")
def sorted_values(spark, d):
    """SL3-SL5: an order is asked for, the engine sorts."""
    return load(spark, d, "lineitem").orderBy(F.desc("l_quantity"), "l_orderkey", "l_partkey").select(F.col("l_quantity").alias("v"))


@query("SELECT CAST(0 AS BIGINT) AS n_different, true AS same")
def multiset_equal(spark, d):
    """JN13, SO4, SL8: what was produced is what was consumed."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return I.same_multiset(rows, rows.where("l_partkey % 2 = 0").unionByName(rows.where("l_partkey % 2 = 1")), ["l_orderkey", "l_partkey"])


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_quantity = 50) AS n_different, (SELECT count(*) FROM lineitem WHERE l_quantity = 50) = 0 AS same")
def multiset_differs(spark, d):
    """JN13: and by how many rows if not."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return I.same_multiset(rows, rows.where("l_quantity <> 50"), ["l_orderkey", "l_partkey", "l_quantity"])


@query("SELECT user_id, min(event_id) FILTER (value > 200) AS first_at FROM events GROUP BY 1")
def first_crossing(spark, d):
    """WN7."""
    return I.first_crossing(_events(spark, d), ["user_id"], "event_id", F.col("value") > 200)


@query("SELECT user_id AS txn, CASE WHEN bool_and(event_type <> 'error') THEN 'commit' ELSE 'abort' END AS two_phase, CASE WHEN bool_and(event_type <> 'error') AND bool_and(value < 100) THEN 'commit' ELSE 'abort' END AS three_phase FROM events GROUP BY 1")
def txn_vote(spark, d):
    """AG14."""
    vote = F.col("event_type") != "error"
    return _events(spark, d).groupBy(F.col("user_id").alias("txn")).agg(I.decision(vote).alias("two_phase"), I.decision(vote, F.col("value") < 100).alias("three_phase"))


SIGNAL = "CAST(-floor(value) AS BIGINT)"


def _signals(spark, d):
    return _events(spark, d).select("user_id", "event_id", (-F.floor("value")).cast("long").alias("signal"))


@query(f"SELECT event_id, CASE WHEN c > 0 THEN CAST(t // c AS BIGINT) END AS mean_signal FROM (SELECT event_id, CAST(sum(CASE WHEN s > -100 THEN s END) OVER w AS BIGINT) AS t, count(CASE WHEN s > -100 THEN 1 END) OVER w AS c FROM (SELECT *, {SIGNAL} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def moving_mean(spark, d):
    """WN9: truncated towards zero."""
    return G.trailing_mean(_signals(spark, d), ["user_id"], "event_id", "signal").select("event_id", "mean_signal")


@query(f"SELECT event_id, CAST(CASE WHEN s < -75 THEN least(10 + 2, 20) WHEN s > -60 THEN greatest(10 - 2, 5) ELSE 10 END AS INTEGER) AS power, CASE WHEN s > -50 THEN 100 WHEN s > -60 THEN 80 WHEN s > -70 THEN 60 WHEN s > -80 THEN 40 ELSE 20 END AS quality FROM (SELECT event_id, {SIGNAL} AS s FROM events)")
def threshold_control(spark, d):
    """PF15, PF22, SR10 (the decision of a poll)."""
    s = F.col("signal")
    return _signals(spark, d).select("event_id", G.threshold_step(s, F.lit(10)).alias("power"), G.quality_band(s).alias("quality"))


@query(f"""WITH m AS (SELECT event_id, s, CASE WHEN c > 0 THEN t // c END AS mean FROM (SELECT event_id, s, CAST(sum(CASE WHEN s > -100 THEN s END) OVER w AS BIGINT) AS t, count(CASE WHEN s > -100 THEN 1 END) OVER w AS c FROM (SELECT *, {SIGNAL} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))
SELECT event_id, CAST(greatest(5, least(20, CASE WHEN s < -70 THEN 10 + CASE WHEN mean < -70 THEN 4 ELSE 2 END WHEN s > -50 AND mean > -50 THEN 8 ELSE 10 END)) AS INTEGER) AS power FROM m""")
def hysteresis(spark, d):
    """PF21 over WN9."""
    rows = G.trailing_mean(_signals(spark, d), ["user_id"], "event_id", "signal")
    return rows.select("event_id", G.hysteresis(F.col("signal"), F.col("mean_signal"), F.lit(10), -70, -50, 5, 20, 2, True).alias("power"))


@query(f"""WITH q AS (SELECT user_id, event_id, CASE WHEN s > -50 THEN 100 WHEN s > -60 THEN 80 WHEN s > -70 THEN 60 WHEN s > -80 THEN 40 ELSE 0 END AS q FROM (SELECT *, {SIGNAL} AS s FROM events))
SELECT event_id, CAST(coalesce(floor(avg(CASE WHEN q > 0 THEN q END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), 0) AS BIGINT) AS mean_quality FROM q""")
def quality_band(spark, d):
    """WN10 over PF22 (weak signals count for nothing here)."""
    q = F.when(F.col("signal") > -80, G.quality_band(F.col("signal"))).otherwise(0)
    return G.trailing_quality(_signals(spark, d).withColumn("q", q), ["user_id"], "event_id", "q", 10).select("event_id", "mean_quality")


@query("SELECT event_id, value / 100 > 2.0 AS load_alarm, CASE WHEN value * 10 > 1000 THEN value * 10 / 1000 ELSE value * 10 END > 70 AS heat_alarm, value BETWEEN 5 AND 20 AS in_range FROM events")
def alarms(spark, d):
    """PF23, PF24."""
    v = F.col("value")
    return _events(spark, d).select("event_id", G.load_alarm(v / 100).alias("load_alarm"), (G.temperature(v * 10) > 70).alias("heat_alarm"), G.power_in_range(v, 5, 20).alias("in_range"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN CASE WHEN props IS NOT NULL THEN 'ok' ELSE 'missing field' END ELSE 'unknown action' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def action_dispatch(spark, d):
    """PF16, SC14: requests parsed from JSON and judged by their action."""
    parsed = F.from_json("props", "k BIGINT")
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", F.when(F.col("props").isNotNull(), "ok").otherwise("missing field")).otherwise("unknown action")
    return _events(spark, d).select("event_id", status.alias("status"), parsed["k"].alias("k"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS body FROM events")
def json_rows(spark, d):
    """SK7: rows as JSON."""
    return _events(spark, d).select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%d %H:%M:%S') AS stamp, strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def formatted_times(spark, d):
    """Date formats, of a fixed column."""
    stamp, iso = scalar.formatted(F.col("event_id") * 1000)
    return _events(spark, d).select("event_id", stamp.alias("stamp"), iso.alias("iso"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_connected FROM events GROUP BY 1")
def connected_players(spark, d):
    """AG21."""
    return S.connected(_events(spark, d).withColumn("on", F.col("event_type") != "error"), "user_id", "on")


@query("SELECT low, low + 3 AS high, CAST(sum(p_size) AS BIGINT) AS weight FROM (SELECT DISTINCT (p_partkey - 1) // 3 * 3 + 1 AS low FROM part) r JOIN part ON p_partkey BETWEEN low AND low + 3 GROUP BY low")
def range_weights(spark, d):
    """AG26: ranges over the whole span of the keys."""
    balls = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"))
    ranges = balls.select(F.expr("(p_partkey - 1) div 3 * 3 + 1").alias("low")).distinct().select("low", (F.col("low") + 3).alias("high"))
    return S.range_weights(balls, ranges, "p_partkey", "w")
