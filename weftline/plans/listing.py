"""Queries: listings, lookups, validation, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import mutations as M
from weftline.operators import paging as P
from weftline.operators import validation as V
from weftline.plans.registry import query
from weftline.sources.tables import load


@query("""SELECT p.o_orderkey, p.o_custkey, p.o_totalprice, coalesce(c.c_name, 'Unknown') AS c_name
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100) p LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON p.o_custkey = c.c_custkey""")
def list_page(spark, d):
    """SL1, JN1: a page of orders, enriched after paging."""
    rows = P.page_of(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 3, 50)
    names = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return P.with_lookup(rows, names, "o_custkey", "c_name", "Unknown").select("o_orderkey", "o_custkey", "o_totalprice", "c_name")


@query("SELECT count(*) AS total_items, CAST((count(*) + 49) // 50 AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS current_page, CAST(50 AS BIGINT) AS page_size, count(*) > 150 AS has_next, true AS has_previous FROM orders")
def page_meta(spark, d):
    """SL2, AG1."""
    return P.page_meta(load(spark, d, "orders"), 3, 50)


@query("SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 99999900) t")
def page_beyond_end(spark, d):
    """SL1: a page beyond the end is empty."""
    return P.page_of(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1_000_000, 100)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 9000 ORDER BY o_orderkey LIMIT 100")
def page_after(spark, d):
    """SL1: a deep page by the last key of the one before it."""
    return P.page_after(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 9000, 100)


@query("SELECT event_id, CASE WHEN event_id % 7 < 1 THEN 'page' WHEN user_id % 120 NOT BETWEEN 1 AND 100 THEN 'limit' END AS problem FROM events")
def page_check(spark, d):
    """PF7: page and limit of every request."""
    return load(spark, d, "events").select("event_id", P.page_problem(F.col("event_id") % 7, F.col("user_id") % 120).alias("problem"))


@query("""WITH s AS (SELECT p_partkey, p_size FROM part), q AS (SELECT l_partkey, sum(l_quantity) AS q, max(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT 'kept' AS outcome, p_partkey, CAST(p_size * 100000 - coalesce(q, 0) AS DOUBLE) AS copies FROM s LEFT JOIN q ON p_partkey = l_partkey UNION ALL SELECT 'rolled back', p_partkey, CAST(p_size AS DOUBLE) FROM s""")
def transactions(spark, d):
    """MU13: a bulk order over all stock that fits, and one that does not and leaves the stock as it was."""
    items = load(spark, d, "lineitem").select("l_partkey", "l_quantity")
    part = load(spark, d, "part")
    out = None
    for outcome, copies in (("kept", F.col("p_size") * 100000), ("rolled back", F.col("p_size"))):
        stock = part.select(F.col("p_partkey").alias("l_partkey"), copies.cast("double").alias("copies"))
        changed = M.take_stock(stock, items, "l_partkey", "l_quantity", "copies")
        done = M.transaction(stock, changed, changed.where("copies < 0")).select(F.lit(outcome).alias("outcome"), F.col("l_partkey").alias("p_partkey"), "copies")
        out = done if out is None else out.unionByName(done)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def overdue(spark, d):
    """Loans not returned within their term (planned by the reference): open orders older than 90 days, seen from the last order."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    last = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 90 DAY")).alias("term"))
    return orders.where("o_orderstatus = 'O'").crossJoin(F.broadcast(last)).where("o_orderdate < term").select("o_orderkey", "o_custkey")  # one row


@query("SELECT p_partkey, p_size * 30 AS copies, CAST(coalesce(n, 0) AS BIGINT) AS on_loan, p_size * 30 - coalesce(n, 0) > 0 AS available FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON p_partkey = l_partkey")
def copies_left(spark, d):
    """Copies of each title, how many are on loan, and whether one is left (planned by the reference)."""
    out = load(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    met = load(spark, d, "part").select("p_partkey", (F.col("p_size") * 30).alias("copies")).join(out, "p_partkey", "left").withColumn("on_loan", F.coalesce("n", F.lit(0)))
    return met.select("p_partkey", "copies", "on_loan", (F.col("copies") > F.col("on_loan")).alias("available"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_loans, first_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def loans_of_user(spark, d):
    """Open loans of each user, and the first of them (planned by the reference)."""
    loans = load(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_at"))
    return load(spark, d, "customer").select("c_custkey").join(loans, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_loans"), "first_at")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    """SC2."""
    return P.point_lookup(load(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def filtered_list(spark, d):
    """Filters, sort key and direction, page (specified, not implemented in the reference); PF1."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return P.filtered_page(rows, [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000], "o_totalprice", "desc", "o_orderkey", 2, 20).select("o_orderkey", "o_totalprice")


@query("SELECT id AS o_orderkey FROM (SELECT unnest(range(0, 40000, 7)) AS id) a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id)")
def missing_keys(spark, d):
    """PF3, SO1."""
    return P.missing_keys(spark.range(0, 40000, 7).select(F.col("id").alias("o_orderkey")), load(spark, d, "orders"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def existing_keys(spark, d):
    """JN2, PF2."""
    known = load(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return P.existing(load(spark, d, "orders"), known, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(avg(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS mean_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def counts_per_owner(spark, d):
    """Number of children and their mean per parent, also for parents without any (planned by the reference)."""
    each = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.avg(F.round(F.col("o_totalprice") * 100).cast("long")).alias("mean_price"))
    joined = load(spark, d, "customer").select("c_custkey").join(each, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("mean_price", F.lit(0.0)).alias("mean_price"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def one_review_each(spark, d):
    """One review a user and item: the first (planned by the reference)."""
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


ITEMS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query("""SELECT l_orderkey, l_partkey, CASE WHEN NOT (l_quantity > 2) THEN 'quantity too small' WHEN NOT (l_discount < 0.09) THEN 'discount too large' WHEN NOT (l_returnflag <> 'R') THEN 'returned' END AS problem FROM lineitem""")
def validate_first(spark, d):
    """PF4: the first rule that fails."""
    c = F.col
    rules = [(c("l_quantity") > 2, "quantity too small"), (c("l_discount") < 0.09, "discount too large"), (c("l_returnflag") != "R", "returned")]
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", V.first_failure(rules).alias("problem"))


@query("""SELECT l_orderkey, l_partkey, nullif(concat_ws(', ', CASE WHEN l_quantity <= 2 THEN 'quantity' END, CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'flag' END), '') AS problems FROM lineitem""")
def validate_all(spark, d):
    """PF5: all rules that fail."""
    c = F.col
    rules = [(c("l_quantity") > 2, "quantity"), (c("l_discount") < 0.09, "discount"), (c("l_returnflag") != "R", "flag")]
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", V.all_failures(rules).alias("problems"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE event_type END AS unknown FROM events")
def unknown_fields(spark, d):
    """PF6: fields that a batch update does not know."""
    return load(spark, d, "events").select("event_id", V.unknown_fields(F.array("event_type"), ["click", "view", "title"]).alias("unknown"))


@query("SELECT c_custkey, coalesce(nullif(trim(c_name), ''), 'none') AS name, coalesce(CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal, 0) AS BIGINT) END, 1) AS copies FROM customer")
def with_defaults(spark, d):
    """PF8, ST1: trimmed text, defaults for what is absent."""
    positive = F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 0).cast("long"))
    return load(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(V.stripped(F.col("c_name")), F.lit("")), F.lit("none")).alias("name"), F.coalesce(positive, F.lit(1)).alias("copies"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN trim('  new ') END ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE c_name END AS c_name FROM customer""")
def patch_overlay(spark, d):
    """MU3, PF9: patches for some keys; a present null deletes, an absent field stays."""
    base = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    key = F.col("c_custkey")
    patches = base.where(key % 3 == 0).select("c_custkey", F.lit(True).alias("has_c_mktsegment"), F.when(key % 2 == 0, V.stripped(F.lit("  new "))).alias("new_c_mktsegment"), (key % 5 == 0).alias("has_c_name"), F.concat(F.lit("x"), key.cast("string")).alias("new_c_name"))
    return M.patch(base, patches, "c_custkey", ["c_mktsegment", "c_name"])


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey, NULL AS s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 = 0""")
def replace_rows(spark, d):
    """MU2: rows replaced whole; what they do not give is dropped, what is kept stays."""
    base = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return M.replace(base, base.where("s_suppkey % 10 = 0").select("s_suppkey"), "s_suppkey", ["s_nationkey"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_row(spark, d):
    """MU1."""
    return M.insert(load(spark, d, "region"), spark.sql("SELECT 99 AS r_regionkey, 'ATLANTIS' AS r_name"))


@query("""SELECT 'parent' AS side, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'child', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)""")
def cascade_delete(spark, d):
    """MU4: parents deleted with their children."""
    parents = load(spark, d, "customer")
    left, children = M.delete_cascade(parents, load(spark, d, "orders"), parents.where("c_custkey % 7 = 0"), "c_custkey", "o_custkey")
    return left.select(F.lit("parent").alias("side")).unionByName(children.select(F.lit("child").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) THEN 0 ELSE p_size END AS p_size FROM part")
def bulk_update(spark, d):
    """MU5: the same values for listed keys, all of them there."""
    base = load(spark, d, "part").select("p_partkey", "p_size")
    return M.bulk_update(base, base.where("p_size > 45"), "p_partkey", {"p_size": F.lit(0)})


@query("SELECT p_partkey, p_size FROM part")
def bulk_update_refused(spark, d):
    """MU5: with a key missing nothing changes."""
    base = load(spark, d, "part").select("p_partkey", "p_size")
    return M.bulk_update(base, base.where("p_size > 45").select("p_partkey").unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS p_partkey")), "p_partkey", {"p_size": F.lit(0)})


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, running_qty, running_qty <= p_size * 30 AS fits FROM (
SELECT *, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY {ITEMS} ROWS UNBOUNDED PRECEDING) AS running_qty FROM lineitem WHERE l_quantity > 0) l JOIN part ON l_partkey = p_partkey""")
def stock_prefix_check(spark, d):
    """WN1: running quantity against the stock."""
    items = load(spark, d, "lineitem").select(*ITEMS.split(", "), "l_quantity")
    stock = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 30).alias("copies"))
    return M.prefix_check(items, stock, "l_partkey", ITEMS.split(", "), "l_quantity", "copies").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "running_qty", "fits")


@query("SELECT l_orderkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey, l_partkey")
def qty_per_key(spark, d):
    """AG2."""
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))


@query("""WITH k AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, min(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n_items, bool_and(coalesce(q <= p_size AND m > 0, false)) AND sum(n) <= 50 AS accepted FROM k LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def bulk_order_guard(spark, d):
    """MU7: batches that fit the stock as a whole."""
    stock = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("copies"))
    return M.bulk_order(load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), stock, "l_orderkey", "l_partkey", "l_quantity", "copies")


@query("""SELECT l_orderkey, array_to_string((list(l_linenumber || ': ' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))[1:10], '; ') AS errors FROM lineitem WHERE l_quantity < 10 GROUP BY l_orderkey""")
def first_errors(spark, d):
    """SL9: at most ten errors of each request, in order."""
    bad = load(spark, d, "lineitem").where("l_quantity < 10")
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    listed = bad.groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list(at)), 1, 10).alias("e"))
    return listed.select("l_orderkey", F.array_join(F.transform("e", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(": "), x["l_partkey"].cast("string"))), "; ").alias("errors"))


@query("""SELECT p_partkey, p_size * 30 - coalesce(q, 0) AS after_order, p_size * 30 + coalesce(q, 0) AS after_return FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey""")
def restock(spark, d):
    """MU6, MU8: stock less ordered, and plus returned, quantities."""
    stock = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 30).alias("after_order"))
    items = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_quantity")
    out = M.take_stock(stock.withColumn("before", F.col("after_order")), items, "l_partkey", "l_quantity", "after_order")
    return out.select(F.col("l_partkey").alias("p_partkey"), "after_order", (2 * F.col("before") - F.col("after_order")).alias("after_return"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'O' THEN 'returned' WHEN o_orderstatus = 'O' THEN 'created' ELSE 'returned' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 200 ELSE 409 END END AS outcome FROM orders""")
def return_orders(spark, d):
    """MU9: created orders are returned, others are in conflict."""
    rows = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "created").otherwise("returned").alias("status"))
    return M.return_orders(rows, rows.where("o_orderkey % 4 = 0"), "o_orderkey", "status")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def returned_purge(spark, d):
    """MU10."""
    return M.purge(load(spark, d, "orders"), F.col("o_orderstatus") == "F").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE (event_id * 7) % 10 < 8) WHERE k = 1""")
def idempotent_first(spark, d):
    """MU11: the first success of each key."""
    log = load(spark, d, "events").withColumn("status", F.when(F.col("event_id") * 7 % 10 < 8, 201).otherwise(409))
    return M.first_success(log, ["user_id", "event_type"], "event_id", "status").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey, substr(md5(concat_ws('|', CAST(c_custkey AS VARCHAR), coalesce(c_name, ''), CAST(c_nationkey AS VARCHAR), coalesce(c_mktsegment, ''))), 1, 16) AS etag FROM customer")
def etag(spark, d):
    """MU12, ST7: tags by a canonical text."""
    return load(spark, d, "customer").select("c_custkey", M.etag(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("etag"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 428 WHEN o_orderkey % 3 = 1 THEN 412 ELSE 200 END AS write_status, CASE WHEN o_orderkey % 3 = 2 THEN 304 ELSE 200 END AS read_status FROM orders""")
def preconditions(spark, d):
    """PF19."""
    tag, sent = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 1, F.lit("old")).when(F.col("o_orderkey") % 3 == 2, F.col("o_orderkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", V.precondition(sent, tag, False).alias("write_status"), V.precondition(sent, tag, True).alias("read_status"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, event_id % 9 AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(user_id, event_id, k, rest, outcome) AS (SELECT user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(40 AS BIGINT), 0 FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.q > 0 AND o.q <= rest THEN rest - o.q ELSE rest END, CASE WHEN o.q = 0 THEN 400 WHEN o.q <= rest THEN 201 ELSE 409 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, CAST(outcome AS INTEGER) AS outcome FROM f WHERE k > 0""")
def place_orders(spark, d):
    """MU6: orders met in turn while the stock lasts."""
    e = load(spark, d, "events")
    stock = e.select("user_id").distinct().withColumn("copies", F.lit(40))
    return M.place_orders(stock, e.select("user_id", "event_id", (F.col("event_id") % 9).alias("q")), "user_id", "event_id", "q", "copies")
