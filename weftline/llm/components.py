"""Connected components of an edge list, in rounds of star contraction.

Each round points every node's larger neighbours at its smallest one, then the node
itself (large star, small star); the number of rounds grows with the logarithm of
the longest path. Edges stay distributed and every round is written to the shared
folder, which ends its lineage; only counts reach the driver.

Defined results: an edge with a null end, and one from a node to itself, links nothing
and names no node; repeated and reversed edges are one; no edges give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_one, materialise


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    return join_one(edges, least, "u", "c", total).select("u", "v", "m")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long); nodes without an edge are not there."""
    at = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        n = at.count()
        if not n:
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        n = large.count()
        small = _with_least(large, n)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.distinct(), "small")
        # Done when every node has one edge and no node that is pointed at points on: then a round changes nothing.
        same = new.join(at, ["u", "v"], "left_anti").isEmpty() and new.count() == at.count()
        at = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
