"""Graphs, flows and lattices as edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.routing import numbered_from_zero


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    """SC16: all pairs u < v of n nodes: the definition of its result, n(n-1)/2 rows made by one generator."""
    return spark.range(n - 1).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("v"))


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    """SC16: u to u + 1."""
    return spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))


def ring_lattice(spark: SparkSession, n: int, reach: int) -> DataFrame:
    """SC16: regular graph of degree 2 * reach: every node with its next reach nodes round a ring."""
    return spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k")).select("u", F.pmod(F.col("u") + F.col("k"), F.lit(n)).alias("v"))


def _turned(nodes: DataFrame, node: str, seed: int, turn: int) -> DataFrame:
    """The nodes with _n, their place (from 0) in an order drawn by seed and turn."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), F.col(node).cast("string")))
    return numbered_from_zero(nodes.select(node, F.concat_ws(":", drawn, F.col(node).cast("string")).alias("_o")), "_o").drop("_o")


def random_graph(nodes: DataFrame, node: str, degree: int, seed: int) -> DataFrame:
    """SC16: random graph u < v of a given degree: rings through all nodes in orders drawn by seed, and for an odd degree a pairing of neighbours in one more.

    A node's degree is smaller only where two rings share an edge. Deterministic in seed;
    each ring is a sort and a join on places, so nothing meets all pairs.
    """
    out = None
    n = nodes.count()
    for turn in range((degree + 1) // 2):
        placed = _turned(nodes, node, seed, turn)
        ring = placed if 2 * turn + 1 < degree else placed.where("_n % 2 = 0")
        ahead = placed.select(F.pmod(F.col("_n") - 1, F.lit(n)).alias("_n"), F.col(node).alias("_v"))
        edges = ring.join(ahead, "_n").where(F.col(node) != F.col("_v")).select(F.least(node, "_v").alias("u"), F.greatest(node, "_v").alias("v"))
        out = edges if out is None else out.unionByName(edges)
    return out.distinct()


def flow_totals(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """AG6, ST9: in-flow and out-flow of each node; its label counts the in-flow, or the out-flow where nothing flows in."""
    into = flows.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in_w"))
    out = flows.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out_w"))
    both = nodes.join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_w", "out_w"])
    shown = F.when(F.col("in_w") == 0, F.col("out_w")).otherwise(F.col("in_w"))
    return both.withColumn("label", F.concat(F.col("name"), F.lit(" (n="), shown.cast("string"), F.lit(")")))


def cut_value(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """AG7, JN7: edges between nodes of different sides; weights do not count."""
    u, v = sides.select(F.col("node").alias("u"), F.col("x").alias("xu")), sides.select(F.col("node").alias("v"), F.col("x").alias("xv"))
    return edges.join(u, "u").join(v, "v").agg(F.coalesce(F.sum(F.col("xu") * (1 - F.col("xv")) + F.col("xv") * (1 - F.col("xu"))), F.lit(0)).cast("long").alias("cut"))


def adjacency(tensors: DataFrame, node: str, indices: str) -> DataFrame:
    """JN8, SO2: pairs i < j of tensors that share an index: they meet at the index, not each with each."""
    each = tensors.select(node, F.explode(F.array_distinct(indices)).alias("ix"))
    a, b = each.select(F.col(node).alias("i"), "ix"), each.select(F.col(node).alias("j"), "ix")
    return a.join(b, "ix").where("i < j").select("i", "j").distinct()


def last_writer(gates: DataFrame, qubit: str, seq: str, gate: str) -> DataFrame:
    """JN10: each gate with the one before it on its wire (null at the wire's start)."""
    w = Window.partitionBy(qubit).orderBy(seq)
    return gates.withColumn("from_gate", F.lag(gate).over(w)).withColumn("from_seq", F.lag(seq).over(w))


def lattice(spark: SparkSession, size: int, spin: Column) -> DataFrame:
    """M13: a periodic cube of spins; spin is an expression over x, y, z (from 0)."""
    cells = spark.range(size**3).select((F.floor(F.col("id") / (size * size))).cast("int").alias("x"), F.pmod(F.floor(F.col("id") / size), F.lit(size)).cast("int").alias("y"), F.pmod(F.col("id"), F.lit(size)).cast("int").alias("z"))
    return cells.withColumn("s", spin.cast("int"))


def lattice_bonds(cells: DataFrame, size: int) -> DataFrame:
    """JN9: each cell with its neighbour in each of three directions, wrapped round: every bond once."""
    step = F.explode(F.array(*[F.struct(*[F.lit(int(k == d)).alias(a) for k, a in enumerate("xyz")]) for d in range(3)]))
    ahead = cells.select("x", "y", "z", "s", step.alias("d"))
    near = ahead.select("s", *[F.pmod(F.col(a) + F.col(f"d.{a}"), F.lit(size)).alias(a) for a in "xyz"])
    return near.join(cells.select("x", "y", "z", F.col("s").alias("t")), ["x", "y", "z"])


def lattice_observables(cells: DataFrame, size: int, coupling: float = 1.0, field: float = 0.0) -> DataFrame:
    """AG13: sum of spins, energy -J sum s t - B sum s (one-way bonds, whole field), mean, <s2> - <s>2."""
    spins = cells.agg(F.sum("s").alias("magnetisation"), F.avg("s").alias("mean_spin"), (F.avg(F.col("s") * F.col("s")) - F.avg("s") * F.avg("s")).alias("spin_variance"))
    bonds = lattice_bonds(cells, size).agg(F.sum(F.col("s") * F.col("t")).alias("_bonds"))
    return spins.crossJoin(bonds).select("magnetisation", (-coupling * F.col("_bonds") - field * F.col("magnetisation")).alias("energy"), F.round("mean_spin", 6).alias("mean_spin"), F.round("spin_variance", 6).alias("spin_variance"))


def tree_costs(nodes: DataFrame, cost: str) -> DataFrame:
    """AG19: greatest, and least non-zero, cost of the nodes of a contraction tree."""
    return nodes.agg(F.max(cost).alias("max_cost"), F.min(F.when(F.col(cost) != 0, F.col(cost))).alias("min_nonzero_cost"))


def slice_sums(slices: DataFrame, amplitude: str, re: str, im: str) -> DataFrame:
    """AG23: partial amplitudes summed over the slices, then their squared modulus."""
    total = slices.groupBy(amplitude).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return total.withColumn("probability", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """AR6: product of two matrices in coordinate form (i, k, v) and (k, j, v): a join on the shared index and a sum; entries of one place are added before they meet."""
    left, right = a.groupBy("i", "k").agg(F.sum("v").alias("p")), b.groupBy("k", "j").agg(F.sum("v").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
