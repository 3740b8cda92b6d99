"""Queries: distributions, graphs, lattices, scalar and array functions, kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import kernels as N
from weftline.functions import scalar as S
from weftline.operators import distribution as D
from weftline.operators import graph as G
from weftline.operators import packets as K
from weftline.operators import stats
from weftline.plans.registry import query
from weftline.sources import generators, serde
from weftline.sources.tables import load


def _shots(spark, d):
    return stats.histogram(load(spark, d, "lineitem"), F.col("l_quantity").cast("long").alias("state"))


SHOTS = "(SELECT CAST(l_quantity AS BIGINT) AS state, count(*) AS n FROM lineitem GROUP BY 1)"


@query(f"SELECT state, n, round(n / (SELECT sum(n) FROM {SHOTS}), 9) AS p FROM {SHOTS}")
def shot_probs(spark, d):
    """AG8, AG24."""
    return D.probabilities(_shots(spark, d), "n").select("state", "n", F.round("p", 9).alias("p"))


@query(f"SELECT state % 7 AS fval, round(sum(n / (SELECT sum(n) FROM {SHOTS})), 9) AS mass FROM {SHOTS} GROUP BY 1")
def mass_by_value(spark, d):
    """AG9."""
    p = D.probabilities(_shots(spark, d), "n").withColumn("fval", F.col("state") % 7)
    return D.mass_by_value(p, "fval", "p").select("fval", F.round("mass", 9).alias("mass"))


@query(f"SELECT fval, CAST(sum(n) OVER (ORDER BY fval DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cdf FROM (SELECT state % 7 AS fval, sum(n) AS n FROM {SHOTS} GROUP BY 1)")
def cdf_desc(spark, d):
    """WN3: in counts, so it is exact."""
    mass = D.mass_by_value(_shots(spark, d).withColumn("fval", F.col("state") % 7), "fval", "n")
    return D.cdf_desc(mass, "fval", "mass").select("fval", "cdf")


@query("SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def argmax_first(spark, d):
    """AG10: ties go to the first."""
    return D.argmax_first(load(spark, d, "events"), ["user_id"], "value", "event_id")


@query("SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events) WHERE k = 1")
def argmin(spark, d):
    """AG11: the documented intent."""
    return D.argmin_first(load(spark, d, "events"), ["user_id"], "value", "event_id")


@query("SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_quantity ORDER BY l_orderkey, l_partkey) = 1 AS coloured FROM lineitem WHERE l_quantity >= (SELECT min(q) FROM (SELECT l_quantity AS q FROM lineitem ORDER BY 1 DESC LIMIT 4))")
def top4_ties(spark, d):
    """SL6."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.struct("l_orderkey", "l_partkey").alias("o"))
    return D.top_values(rows, "l_quantity", "o", 4).select("l_orderkey", "l_quantity", "coloured")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, sum(value * value) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(-sum(value * value / n * log2(value * value / n)) FILTER (value * value / n > 1e-15), 6) AS entropy, round(sum(CASE WHEN k > 3 THEN value * value ELSE 0 END), 2) AS discarded FROM s GROUP BY 1""")
def entropies(spark, d):
    """AG15, PF20, AG17: entropy and discarded weight of the values of each key."""
    rows = load(spark, d, "events").select("user_id", "value", "event_id")
    e = D.entropy(rows, ["user_id"], "value").select("user_id", F.round("entropy", 6).alias("entropy"))
    return e.join(D.discarded_weight(rows, ["user_id"], "value", "event_id", 3).select("user_id", F.round("discarded", 2).alias("discarded")), "user_id")


@query("SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def bond_truncation(spark, d):
    """SL7."""
    return D.top_per_group(load(spark, d, "events").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id", 3)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(abs(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS f FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fidelity(spark, d):
    """AG16: of neighbours."""
    e = load(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(D.fidelity(F.col("x"), F.col("y")), 6).alias("f"))


FLOW_SQL = "VALUES " + ", ".join(str(x) for x in generators.FLOWS)
NODE_SQL = "VALUES " + ", ".join(str(x) for x in generators.FLOW_NODES)


@query(f"""WITH f(src, dst, w) AS ({FLOW_SQL}), n(id, name) AS ({NODE_SQL}), i AS (SELECT dst, sum(w) AS w FROM f GROUP BY 1), o AS (SELECT src, sum(w) AS w FROM f GROUP BY 1)
SELECT id, name, CAST(coalesce(i.w, 0) AS BIGINT) AS in_w, CAST(coalesce(o.w, 0) AS BIGINT) AS out_w, name || ' (n=' || CASE WHEN coalesce(i.w, 0) = 0 THEN coalesce(o.w, 0) ELSE i.w END || ')' AS label FROM n LEFT JOIN i ON id = i.dst LEFT JOIN o ON id = o.src""")
def flow_totals(spark, d):
    """AG6, ST9, M12: the screening flows."""
    return G.flow_totals(generators.flow_nodes(spark), generators.flows(spark))


@query("SELECT u, v, w FROM (" + FLOW_SQL + ") f(u, v, w) WHERE w > 0")
def positive_labels(spark, d):
    """PF17: flows without a weight are left out."""
    return generators.flows(spark).where("w > 0").select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")


@query("SELECT CAST(count(*) AS BIGINT) AS cut FROM (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem) WHERE (u % 3 = 0) <> (v % 2 = 0)")
def maxcut_value(spark, d):
    """AG7, JN7: parts and suppliers with an edge for each supply; sides by number."""
    edges = load(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), (-1 - F.col("l_suppkey")).alias("v")).distinct()
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 3 == 0).cast("int").alias("x"))
    suppliers = load(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("node"), (F.col("s_suppkey") % 2 == 0).cast("int").alias("x"))
    return G.cut_value(edges, parts.unionByName(suppliers))


@query("""WITH r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY md5('7:0:' || c_custkey) || ':' || c_custkey) - 1 AS a, row_number() OVER (ORDER BY md5('7:1:' || c_custkey) || ':' || c_custkey) - 1 AS b FROM customer), n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT x.k AS p, y.k AS q FROM r x CROSS JOIN n JOIN r y ON y.a = (x.a + 1) % n UNION ALL SELECT x.k, y.k FROM r x CROSS JOIN n JOIN r y ON y.b = (x.b + 1) % n WHERE x.b % 2 = 0)
SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM e WHERE p <> q""")
def random_regular_graph(spark, d):
    """SC16: a random graph of degree three over the customers, by seed."""
    return G.random_graph(load(spark, d, "customer"), "c_custkey", 3, 7)


@query("SELECT DISTINCT a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.event_id < b.event_id AND (a.event_id // 3 = b.event_id // 3 OR a.event_id // 5 = b.event_id // 5)")
def adjacency(spark, d):
    """JN8, SO2: tensors that share an index."""
    e = F.col("event_id")
    tensors = load(spark, d, "events").select("event_id", F.array(F.concat(F.lit("a"), F.expr("event_id div 3").cast("string")), F.concat(F.lit("b"), F.expr("event_id div 5").cast("string"))).alias("ix"))
    return G.adjacency(tensors.where(e.isNotNull()), "event_id", "ix")


@query("SELECT event_id, lag(event_type) OVER w AS from_gate, lag(event_id) OVER w AS from_seq FROM events WHERE event_type NOT IN ('signup') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def last_writer(spark, d):
    """JN10, PF18: wires between gates, instructions without a matrix left out."""
    gates = load(spark, d, "events").where(~F.col("event_type").isin("signup"))
    return G.last_writer(gates, "user_id", "event_id", "event_type").select("event_id", "from_gate", "from_seq")


@query("SELECT DISTINCT event_type AS gate FROM events")
def gate_types(spark, d):
    """SO5."""
    return load(spark, d, "events").select(F.col("event_type").alias("gate")).distinct()


@query("SELECT 1 AS part, l_orderkey FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 2, l_orderkey FROM lineitem WHERE l_quantity = 10 UNION ALL SELECT 3, l_orderkey FROM lineitem WHERE l_quantity > 10")
def partitioned_parts(spark, d):
    """SO3: left, middle and right of a pivot put together."""
    rows, q = load(spark, d, "lineitem").select("l_orderkey", "l_quantity"), F.col("l_quantity")
    parts = [rows.where(c).select(F.lit(k).alias("part"), "l_orderkey") for k, c in ((1, q < 10), (2, q == 10), (3, q > 10))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT CAST(sum(1 - 2 * (bit_count(event_id & 5) % 2)) AS BIGINT) AS z5, CAST(sum(3 * (1 - 2 * (bit_count(event_id & 12) % 2))) AS BIGINT) AS z12 FROM events")
def pauli_expect(spark, d):
    """MA8."""
    s = F.col("event_id")
    return load(spark, d, "events").agg(F.sum(S.parity_sign(s, F.lit(5).cast("long"))).cast("long").alias("z5"), F.sum(3 * S.parity_sign(s, F.lit(12).cast("long"))).cast("long").alias("z12"))


@query("SELECT max(p_size % 5) AS max_cost, min(nullif(p_size % 5, 0)) AS min_nonzero_cost FROM part")
def tree_costs(spark, d):
    """AG19."""
    return G.tree_costs(load(spark, d, "part").select((F.col("p_size") % 5).alias("c")), "c")


@query("SELECT amplitude, re, im, re * re + im * im AS probability FROM (SELECT user_id % 8 AS amplitude, CAST(sum(event_id % 3) AS BIGINT) AS re, CAST(sum(event_id % 5) AS BIGINT) AS im FROM events GROUP BY 1)")
def slice_sums(spark, d):
    """AG23: partial amplitudes of slices."""
    e = load(spark, d, "events").select((F.col("user_id") % 8).alias("amplitude"), (F.col("event_id") % 3).alias("r"), (F.col("event_id") % 5).alias("i"))
    return G.slice_sums(e, "amplitude", "r", "i")


@query("WITH x AS (SELECT l_orderkey % 10 AS i, l_linenumber AS k, l_suppkey % 10 AS j, CAST(l_quantity AS BIGINT) AS q FROM lineitem), a AS (SELECT i, k, sum(q) AS q FROM x GROUP BY 1, 2), b AS (SELECT k, j, sum(q) AS q FROM x GROUP BY 1, 2) SELECT i, j, CAST(sum(a.q * b.q) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY 1, 2")
def sparse_matmul(spark, d):
    """AR6: a product in coordinate form."""
    rows = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 10).alias("i"), (F.col("l_suppkey") % 10).alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return G.matmul(rows.select("i", "k", "v"), rows.select("k", "j", "v"))


@query("""WITH c AS (SELECT x, y, z, CASE WHEN (x * 7 + y * 3 + z) % 4 = 0 THEN -1 ELSE 1 END AS s FROM (SELECT unnest(range(6)) AS x) CROSS JOIN (SELECT unnest(range(6)) AS y) CROSS JOIN (SELECT unnest(range(6)) AS z)),
b AS (SELECT sum(c.s * n.s) AS e FROM c JOIN c n ON (n.x = (c.x + 1) % 6 AND n.y = c.y AND n.z = c.z) OR (n.x = c.x AND n.y = (c.y + 1) % 6 AND n.z = c.z) OR (n.x = c.x AND n.y = c.y AND n.z = (c.z + 1) % 6))
SELECT CAST(sum(s) AS BIGINT) AS magnetisation, CAST(-1.0 * max(e) - 0.5 * sum(s) AS DOUBLE) AS energy, round(avg(s), 6) AS mean_spin, round(avg(s * s) - avg(s) * avg(s), 6) AS spin_variance FROM c, b""")
def lattice_obs(spark, d):
    """AG13, JN9: observables of a lattice with a pattern."""
    spin = F.when(F.pmod(F.col("x") * 7 + F.col("y") * 3 + F.col("z"), F.lit(4)) == 0, -1).otherwise(1)
    return G.lattice_observables(G.lattice(spark, 6, spin), 6, 1.0, 0.5)


@query("SELECT i AS u, j AS v FROM (SELECT unnest(range(12)) AS i) CROSS JOIN (SELECT unnest(range(12)) AS j) WHERE i < j")
def complete_graph(spark, d):
    """SC16."""
    return G.complete_graph(spark, 12)


@query("SELECT i AS u, (i + k) % 20 AS v FROM (SELECT unnest(range(20)) AS i) CROSS JOIN (VALUES (1), (2)) t(k)")
def regular_graph(spark, d):
    """SC16: every node has degree four."""
    return G.ring_lattice(spark, 20, 2)


@query("SELECT i AS u, i + 1 AS v FROM (SELECT unnest(range(19)) AS i)")
def path_graph(spark, d):
    """SC16."""
    return G.path_graph(spark, 20)


@query("SELECT i AS id, array_to_string([(i >> 4) & 1, (i >> 3) & 1, (i >> 2) & 1, (i >> 1) & 1, i & 1], '') AS bits FROM (SELECT unnest(range(32)) AS i)")
def bit_table(spark, d):
    """SC17, MA9."""
    return A.bit_table(spark, 5).select("id", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


@query("SELECT i AS id, CAST(4 * ((i >> 4) & 1) + 2 * ((i >> 3) & 1) + 2 * ((i >> 2) & 1) + 5 * ((i >> 1) & 1) + 6 * (i & 1) AS INTEGER) AS value, CAST(4 * ((i >> 4) & 1) + 3 * ((i >> 3) & 1) + 3 * ((i >> 2) & 1) + 7 * ((i >> 1) & 1) + 8 * (i & 1) AS INTEGER) AS weight FROM (SELECT unnest(range(32)) AS i) WHERE 4 * ((i >> 4) & 1) + 3 * ((i >> 3) & 1) + 3 * ((i >> 2) & 1) + 7 * ((i >> 1) & 1) + 8 * (i & 1) <= 10")
def knapsack_enum(spark, d):
    """AG18, PF10: subsets within the capacity, with their value."""
    v, w = (F.array(*[F.lit(x) for x in xs]) for xs in (generators.KNAPSACK_VALUES, generators.KNAPSACK_WEIGHTS))
    t = A.bit_table(spark, 5)
    return t.select("id", A.dot(F.col("bits"), v, F.lit(0)).alias("value"), A.dot(F.col("bits"), w, F.lit(0)).alias("weight")).where("weight <= 10")


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0, CAST(0 AS HUGEINT), CAST(1 AS HUGEINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 90) SELECT n, CAST(a AS VARCHAR) AS fib FROM f")
def fib(spark, d):
    """MA5."""
    return S.fibonacci(spark, 90).select("n", F.col("fib").cast("string").alias("fib"))


@query("SELECT i, round(1.0 * sqrt((1 + x) / (1 - x)), 6) AS t, x > 0.6 AS over FROM (SELECT i, i * (0.999 / 499) AS x FROM (SELECT unnest(range(500)) AS i))")
def doppler(spark, d):
    """MA2, MA15, WN7's series."""
    return S.linspace(spark, 0.0, 0.999, 500).select("i", F.round(S.doppler(F.lit(1.0), F.col("x")), 6).alias("t"), (F.col("x") > 0.6).alias("over"))


@query("SELECT p_partkey, round((pow(1 + p_size / 100.0, 1.0 / (1 + p_partkey % 10)) - 1) * 100, 6) AS yearly FROM part")
def cagr(spark, d):
    """MA1."""
    return load(spark, d, "part").select("p_partkey", F.round(S.annualised(F.col("p_size").cast("double"), 1 + F.col("p_partkey") % 10), 6).alias("yearly"))


@query("SELECT event_id, CAST(CASE WHEN value > 0 THEN trunc(10 * log10(value)) END AS INTEGER) AS dbm, CAST(CASE WHEN event_id % 256 >= 64 THEN event_id % 256 - 256 ELSE event_id % 256 - 100 END AS BIGINT) AS level FROM events")
def decibels(spark, d):
    """MA3, MA4."""
    return load(spark, d, "events").select("event_id", S.mw_to_dbm(F.col("value")).alias("dbm"), S.rssi_to_dbm(F.col("event_id") % 256).alias("level"))


@query("""WITH c AS (SELECT a.s AS s1, b.s AS s2, a.d AS d1, b.d AS d2 FROM (SELECT s, d FROM (VALUES (0), (1)) t(s) CROSS JOIN (SELECT unnest(range(7)) AS d)) a CROSS JOIN (SELECT s, d FROM (VALUES (0), (1)) t(s) CROSS JOIN (SELECT unnest(range(7)) AS d)) b)
SELECT round(avg(CASE WHEN s1 = 0 OR s2 = 0 THEN CAST((s1 = 0 AND s2 = 1) OR (s1 = 1 AND s2 = 0) AS INTEGER) END), 9) AS one_boy, round(avg(CASE WHEN (s1 = 0 AND d1 = 2) OR (s2 = 0 AND d2 = 2) THEN CAST(s1 = 1 OR s2 = 1 AS INTEGER) END), 9) AS tuesday_boy, round(avg(CAST(s1 <> s2 AS INTEGER)), 9) AS any_two FROM c""")
def family_prob(spark, d):
    """AG12, PF11: by enumeration of all families of two: 2/3, 14/27, 1/2."""
    kids = lambda k: spark.range(14).select((F.col("id") % 2).alias(f"s{k}"), F.expr("id div 2").alias(f"d{k}"))
    c = kids(1).crossJoin(kids(2))  # 196 rows, whatever the tables hold
    boy, tuesday = (F.col("s1") == 0) | (F.col("s2") == 0), ((F.col("s1") == 0) & (F.col("d1") == 2)) | ((F.col("s2") == 0) & (F.col("d2") == 2))
    girl = ((F.col("s1") == 1) | (F.col("s2") == 1)).cast("int")
    return c.agg(F.round(F.avg(F.when(boy, girl)), 9).alias("one_boy"), F.round(F.avg(F.when(tuesday, girl)), 9).alias("tuesday_boy"), F.round(F.avg((F.col("s1") != F.col("s2")).cast("int")), 9).alias("any_two"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN value + user_id WHEN 'view' THEN value - user_id WHEN 'purchase' THEN round(value * user_id, 4) WHEN 'error' THEN CASE WHEN user_id % 3 <> 0 THEN round(value / (user_id % 3), 6) END END AS result, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'division by zero' WHEN event_type = 'signup' THEN 'unknown operation' END AS error FROM events""")
def calculator(spark, d):
    """MA7: errors are rows, not failures."""
    e = F.col("event_type")
    op = F.when(e == "click", "add").when(e == "view", "subtract").when(e == "purchase", "multiply").when(e == "error", "divide").otherwise(e)
    b = F.when(e == "error", F.col("user_id") % 3).otherwise(F.col("user_id")).cast("double")
    result, error = S.calculate(op, F.col("value"), b)
    return load(spark, d, "events").select("event_id", F.when(op == "multiply", F.round(result, 4)).when(op == "divide", F.round(result, 6)).otherwise(result).alias("result"), error.alias("error"))


@query("SELECT array_to_string(list_transform([1, 2, 3, 4, 5, 6, 7, 128], lambda x: x * 2 + 1), ',') AS a")
def dpu_affine(spark, d):
    """AR1, M20."""
    return spark.range(1).select(F.array_join(F.transform(A.affine(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5, 6, 7, 128)])), lambda x: x.cast("string")), ",").alias("a"))


@query("SELECT p_partkey, array_to_string([(1 * p_size + 2 * 3 - 5) >> 1, (-4 * p_size + 7) >> 1], ',') AS y FROM part")
def int_matvec(spark, d):
    """AR2: arithmetic shift, also of negative numbers."""
    row = lambda *x: F.array(*[F.lit(i) for i in x])
    m, v = F.array(row(1, 2, -1), row(-4, -1, 2)), F.array(F.col("p_size"), F.lit(3), F.lit(5))
    y = A.int_matvec(m, v)
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(y, lambda x: x.cast("string")), ",").alias("y"))


@query("SELECT event_id, reverse(lpad(bin(event_id), 20, '0')) AS bits, CAST((event_id >> 3) & 1 AS BIGINT) AS bit3 FROM events")
def reversed_bits(spark, d):
    """ST8, MA9."""
    return load(spark, d, "events").select("event_id", S.reversed_bits(F.col("event_id"), 20).alias("bits"), S.bit_of(F.col("event_id"), 3).alias("bit3"))


@query("SELECT n, CAST(ceil(log2(n)) AS BIGINT) AS size, CAST(2 * ceil(log2(n)) + 1 + ceil(log2(2 + 1 / (2 * 0.1))) AS BIGINT) AS phase, CAST((7 * n) % 15 AS BIGINT) AS times, round(log2(n * 1048576.0 / 16), 6) AS memory FROM (SELECT unnest(range(2, 60)) AS n)")
def register_sizes(spark, d):
    """MA11, MA12, MA13."""
    n = F.col("id")
    size, phase = S.register_sizes(n, 0.1)
    return spark.range(2, 60).select(n.alias("n"), size.cast("long").alias("size"), phase.cast("long").alias("phase"), S.modular_times(F.lit(7), n, F.lit(15)).cast("long").alias("times"), F.round(S.memory_target(n), 6).alias("memory"))


@query("SELECT n, CASE WHEN n <= 89 THEN CAST(pow(n, 9) AS BIGINT) END AS p9, round(exp(0.4 * 2 * 1 * (n % 5 - 2)), 9) AS weight, round(cosh(n / 50.0), 9) AS c, round(sinh(n / 50.0), 9) AS s FROM (SELECT unnest(range(1, 50)) AS n)")
def powers(spark, d):
    """MA6, MA10, MA16."""
    n = F.col("id")
    t = S.transfer_matrix(n / 50.0)
    return spark.range(1, 50).select(n.alias("n"), S.power_by_squaring(n, 9).alias("p9"), F.round(S.metropolis(0.4, F.lit(1), n % 5 - 2), 9).alias("weight"), F.round(t[0][0], 9).alias("c"), F.round(t[0][1], 9).alias("s"))


@query("""SELECT event_id, 'Interface wlan' || (user_id % 4) AS name, CASE WHEN event_type = 'click' THEN (user_id % 30) || '.00 dBm' ELSE 'unknown' END AS power, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type || ' x' END, ''), 'Hello') AS message FROM events""")
def scraped_text(spark, d):
    """ST2, ST3, ST4, ST5, ST6: names, power with a default, words, joined arguments, UTF-8 bodies."""
    u, e = F.col("user_id"), F.col("event_type")
    text = F.concat(F.lit("Interface wlan"), (u % 4).cast("string"), F.when(e == "click", F.concat(F.lit(" txpower "), (u % 30).cast("string"), F.lit(".00 dBm"))).otherwise(""))
    body = S.utf8(F.encode(text, "UTF-8"))
    args = F.when(e == "view", F.array().cast("array<string>")).otherwise(F.array(e, F.lit("x")))
    return load(spark, d, "events").select("event_id", F.concat(F.element_at(S.words_with_prefix(body, "Interface", 1), 1), F.lit(" "), F.element_at(S.interfaces(body), 1)).alias("name"), S.tx_power(body).alias("power"), S.joined_or(args, "Hello").alias("message"))


@query("""SELECT event_id, t.line_no, t.field, CASE t.field WHEN 'interface' THEN 'wlan' || (user_id % 4) WHEN 'driver' THEN event_type ELSE CAST(-1 - user_id AS VARCHAR) END AS value FROM events CROSS JOIN (VALUES (0, 'interface'), (1, 'driver'), (3, 'signal')) t(line_no, field)""")
def line_fields(spark, d):
    """ST13."""
    u = F.col("user_id")
    text = F.concat(F.lit("Interface wlan"), (u % 4).cast("string"), F.lit("\ndriver: "), F.col("event_type"), F.lit("\nother\nsignal: -"), (u + 1).cast("string"), F.lit(" dBm"))
    return S.line_fields(load(spark, d, "events").select("event_id", text.alias("t")), "t", "event_id")


FRAME = "from_hex('0a0b0c0d0e0f' || '010203040506' || '0800' || '45000028' || '00010000' || '4011' || '0000' || 'c0a80001' || '08080808' || lpad(to_hex(1000 + event_id % 50), 4, '0') || '0035')"


@query("SELECT event_id, '01:02:03:04:05:06' AS src_mac, '192.168.0.1' AS src_ip, '8.8.8.8' AS dst_ip, 1000 + event_id % 50 AS src_port, CAST(53 AS BIGINT) AS dst_port, CAST(17 AS BIGINT) AS ip_proto, true AS dns, false AS arp_reply FROM events")
def frame_decode(spark, d):
    """M15, ST10, ST11, PF12, PF14: headers out of bytes."""
    head = "0a0b0c0d0e0f010203040506" + "0800" + "45000028" + "00010000" + "4011" + "0000" + "c0a80001" + "08080808"
    data = F.unhex(F.concat(F.lit(head), F.lpad(F.hex(1000 + F.col("event_id") % 50), 4, "0"), F.lit("0035")))
    out = K.decoded(load(spark, d, "events").select("event_id", data.alias("data")), "data")
    return out.select("event_id", "src_mac", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", K.is_dns().alias("dns"), K.is_arp_reply(K.uint(F.col("data"), 20, 2)).alias("arp_reply"))


@query("SELECT event_id, CAST(65535 - ((s & 65535) + (s >> 16)) AS INTEGER) AS checksum FROM (SELECT event_id, CAST(17664 + event_id % 65536 + 40 * 1000 AS BIGINT) AS s FROM events)")
def internet_checksum(spark, d):
    """AG25."""
    word = lambda c: F.lpad(F.hex(c), 4, "0")
    data = F.unhex(F.concat(F.lit("4500"), word(F.col("event_id") % 65536), word(F.lit(40000))))
    return load(spark, d, "events").select("event_id", N.internet_checksum(data).alias("checksum"))


@query("SELECT doc_id, array_to_string(list_transform(range(doc_id % 4), lambda k: ['NDST', 'DST', 'DST_P', 'DB', 'DB_P', 'BDB'][1 + (doc_id + k) % 6]), ',') AS grades, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE lang || '@x' END AS id, true AS same FROM documents")
def student_roundtrip(spark, d):
    """SC4, SC5, SK2, SK3, AR3, AR4, AR5, M4: records encoded in both formats and read back."""
    return serde.roundtrip(serde.sample_students(load(spark, d, "documents")))


@query("SELECT event_id, CAST(event_id % 200 AS INTEGER) AS op, CAST(event_id % 1000 - 500 AS INTEGER) AS left_score, 21 AS n_bytes FROM events")
def game_snapshot(spark, d):
    """M16, ST12, SK6, SC13: the packed game state and its opcode."""
    return serde.snapshot_roundtrip(load(spark, d, "events").select("event_id", (F.col("event_id") % 200).cast("int").alias("op"), (F.col("event_id") % 1000 - 500).cast("int").alias("left_score")))


@query("SELECT 3 AS n_authors, 16 AS n_books, CAST(5014 AS BIGINT) AS first, CAST(12 AS BIGINT) AS second, CAST(24 AS BIGINT) AS third")
def seed_tables(spark, d):
    """SC3: sizes and copies of the seed tables."""
    return generators.seed_summary(spark)


@query("SELECT x AS id, CAST(y AS DOUBLE) AS y FROM (VALUES (0, -1.2816), (1, -0.5244), (2, 0.0), (3, 0.5244), (4, 1.2816)) t(x, y)")
def normal_grid(spark, d):
    """MA14: at 0.1, 0.3, 0.5, 0.7, 0.9 of a standard normal."""
    return spark.range(5).select(F.col("id").cast("int").alias("id"), (F.round(N.normal_grid(0.1 + 0.2 * F.col("id"), 0.0, 1.0, -3.0, 3.0), 4) + 0.0).alias("y"))


@query("""WITH b AS (SELECT vec_id, CAST(i AS INTEGER) AS block, CAST(embedding[4 * i + 1] AS DOUBLE) AS a, CAST(embedding[4 * i + 2] AS DOUBLE) AS b, CAST(embedding[4 * i + 3] AS DOUBLE) AS c, CAST(embedding[4 * i + 4] AS DOUBLE) AS d FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 4)) AS i FROM embeddings)),
q AS (SELECT vec_id, block, a * a + b * b + c * c + d * d AS n, greatest(pow(a * a + b * b + c * c + d * d, 2) - 4 * pow(a * d - b * c, 2), 0) AS r FROM b),
p AS (SELECT vec_id, block, (n + sqrt(r)) / (2 * n) AS p, (n - sqrt(r)) / (2 * n) AS q FROM q)
SELECT vec_id, block, round(-p * log2(p) - CASE WHEN q > 1e-15 THEN q * log2(q) ELSE 0 END, 4) + 0.0 AS entropy FROM p""")
def svd_entropy(spark, d):
    """AR7, AG15: spectra of the embeddings' two by two blocks, and their entropy (SQL has them in closed form)."""
    v = load(spark, d, "embeddings")
    block = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("size(embedding) div 4 - 1")), lambda i: F.slice("embedding", 4 * i + 1, 4))).alias("block", "m")
    blocks = v.select("vec_id", block).select((F.col("vec_id") * 1024 + F.col("block")).alias("key"), "m")
    out = D.entropy(N.svd_spectrum(blocks, "key", "m", 2), ["key"], "s")
    return out.select(F.expr("key div 1024").alias("vec_id"), (F.col("key") % 1024).cast("int").alias("block"), (F.round("entropy", 4) + 0.0).alias("entropy"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm, CAST(8 AS BIGINT) AS n, true AS falling FROM embeddings")
def svd_norms(spark, d):
    """AR7: the spectrum of each embedding as an eight by eight matrix: falling, and its squares add up to those of the entries."""
    s = N.svd_spectrum(load(spark, d, "embeddings"), "vec_id", "embedding", 8)
    falls = F.array_sort(F.collect_list(F.struct("k", "s")))
    each = s.groupBy("vec_id").agg(F.round(F.sum(F.col("s") * F.col("s")), 4).alias("norm"), F.count(F.lit(1)).alias("n"), falls.alias("l"))
    return each.select("vec_id", "norm", "n", F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i)["s"] <= F.get("l", i - 1)["s"]).alias("falling"))


@query("""WITH v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n, list_sum(list_transform(embedding[1:len(embedding) // 2], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS a FROM embeddings)
SELECT vec_id, '2,4,8,4,2' AS bonds, CAST(1 AS DOUBLE) AS norm, round(2 * a / n - 1, 4) AS z0, CAST(1 AS DOUBLE) AS fidelity, CAST(0 AS DOUBLE) AS discarded FROM v""")
def mps_exact(spark, d):
    """M14, AR6: chains whose bonds are as wide as they need give the state back; <Z> of the first site is the difference of the halves' weights."""
    t = N.chain_table(load(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return t.select("vec_id", F.array_join(F.transform("bonds", lambda b: b.cast("string")), ",").alias("bonds"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("norm", "z0", "fidelity", "discarded")])


@query("SELECT vec_id, '2,4,4,4,2' AS bonds, true AS norm_is_what_is_left, true AS fidelity_is_its_root FROM embeddings")
def mps_chains(spark, d):
    """M14, AG17: with bonds of at most 4 what is lost is what was thrown away at the one bond that is cut."""
    t = N.chain_table(load(spark, d, "embeddings"), "vec_id", "embedding", 4)
    close = lambda a, b: F.abs(a - b) < 1e-6
    left = 1 - F.col("discarded")
    return t.select("vec_id", F.array_join(F.transform("bonds", lambda b: b.cast("string")), ",").alias("bonds"), close(F.col("norm"), left).alias("norm_is_what_is_left"), close(F.col("fidelity") * F.col("fidelity"), left).alias("fidelity_is_its_root"))


@query("SELECT CAST(8 AS BIGINT) AS n, true AS ordered_when_cold, true AS disordered_when_hot, true AS energy_rises, true AS in_bounds")
def ising_curve(spark, d):
    """Metropolis sweeps over a range of temperatures (a key each); a random walk, so what must hold of it is told."""
    t = N.ising_sweeps(spark.range(8).select((1.5 + 0.25 * F.col("id")).alias("temperature")), 16, 200, 7)
    cold, hot = F.col("temperature") < 1.6, F.col("temperature") > 3.2
    return t.agg(F.count(F.lit(1)).alias("n"), F.bool_and(~cold | (F.col("magnetisation") > 0.9)).alias("ordered_when_cold"), F.bool_and(~hot | (F.col("magnetisation") < 0.5)).alias("disordered_when_hot"), (F.max(F.when(cold, F.col("mean_energy"))) < F.min(F.when(hot, F.col("mean_energy")))).alias("energy_rises"), F.bool_and(F.col("mean_energy").between(-2.0, 0.0) & (F.col("heat_capacity") >= 0)).alias("in_bounds"))


@query("SELECT CAST(100000 AS BIGINT) AS n, true AS mean_ok, true AS variance_ok, CAST(7 AS BIGINT) AS days, true AS in_range")
def uniform_samples(spark, d):
    """SC18: a random table has the moments of its distribution (within five standard errors)."""
    t = A.uniform_table(spark, 100_000).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("m"), F.variance("u").alias("v"), F.count_distinct("day").alias("days"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"))
    return t.select("n", (F.abs(F.col("m") - 0.5) < 0.005).alias("mean_ok"), (F.abs(F.col("v") - 1 / 12) < 0.002).alias("variance_ok"), "days", "in_range")


@query("""WITH RECURSIVE g(k, hit, miss) AS (SELECT 0, 1 / sqrt(8.0), 1 / sqrt(8.0) UNION ALL SELECT k + 1, 2 * (7 * miss - hit) / 8 + hit, 2 * (7 * miss - hit) / 8 - miss FROM g WHERE k < 2)
SELECT p_partkey, CAST(state AS INTEGER) AS state, round(CASE WHEN state = p_partkey % 8 THEN hit * hit ELSE miss * miss END, 4) AS p FROM part CROSS JOIN (SELECT unnest(range(8)) AS state) CROSS JOIN g WHERE k = 2""")
def grover_probs(spark, d):
    """Probabilities of three qubits after two rounds of search, for a marked state of each part."""
    found = load(spark, d, "part").select("p_partkey", F.posexplode(A.grover(3, (F.col("p_partkey") % 8).cast("int"), 2)).alias("state", "a"))
    return found.select("p_partkey", "state", F.round(F.col("a") * F.col("a"), 4).alias("p"))
