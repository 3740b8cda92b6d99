"""Distributions: probabilities, cumulative curves, arguments of extremes, entropy, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.routing import settled


def probabilities(counts: DataFrame, n: str) -> DataFrame:
    """AG8: counts with p, their share of all; the total is one row, so no window gathers the rows."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("p", F.col(n) / F.col("_total")).drop("_total")


def mass_by_value(df: DataFrame, value: str, p: str) -> DataFrame:
    """AG9: probability mass of each objective value."""
    return df.groupBy(value).agg(F.sum(p).alias("mass"))


def cdf_desc(mass: DataFrame, value: str, p: str) -> DataFrame:
    """WN3: cumulated mass from the greatest value down.

    Ranges of values are cumulated apart, and each adds the masses of the ranges above it,
    of which there are as many as partitions; no task sees all values.
    """
    ranged = settled(mass.repartitionByRange(F.desc(value)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum(p).alias("_sum"))
    before = sizes.select("_p", F.coalesce(F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum(p).over(Window.partitionBy("_p").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("cdf", inner).join(F.broadcast(before), "_p").withColumn("cdf", F.col("cdf") + F.col("_before")).drop("_p", "_before")  # a row a partition


def argmax_first(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """AG10: of each group the row of greatest value, the first in seq among equals; an aggregate, so it is combined before the shuffle."""
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(seq)).alias("s"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), (-F.col("b.s")).alias(seq))


def argmin_first(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """AG11: of each group the row of least value, the first in seq among equals (the documented intent)."""
    best = df.groupBy(*by).agg(F.min(F.struct(F.col(value).alias("v"), F.col(seq).alias("s"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), F.col("b.s").alias(seq))


def top_values(df: DataFrame, value: str, seq: str, k: int) -> DataFrame:
    """SL6: rows whose value is among the k greatest (duplicates count), and which of equal ones is the first.

    The k-th value is a top-k of k rows; rows at or above it are then found by a filter.
    """
    least = df.orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("_least"))
    rows = df.crossJoin(F.broadcast(least)).where(F.col(value) >= F.col("_least")).drop("_least")  # one row
    return rows.withColumn("coloured", F.row_number().over(Window.partitionBy(value).orderBy(seq)) == 1)


def top_per_group(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """SL7: the k greatest of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))).where(F.col("_k") <= k).drop("_k")


def discarded_weight(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """AG17: sum of squares beyond the k greatest of each group; 0 where there are none."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie)))
    return ranked.groupBy(*by).agg(F.sum(F.when(F.col("_k") > k, F.col(value) * F.col(value)).otherwise(0.0)).alias("discarded"))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG15, PF20: von Neumann entropy of each group's singular values: p = square by sum of squares, p of zero left out; null where all are zero.

    -sum p log2 p is log2(N) - (sum s2 log2 s2) / N with N the sum of the squares, so one
    aggregate does. Where p is near zero the term is, too, so nothing needs to be cut off.
    """
    square = F.col(value) * F.col(value)
    norm, logs = F.sum(square), F.sum(F.when(square > 0, square * F.log2(square)))
    return df.groupBy(*by).agg((F.log2(norm) - logs / norm).alias("entropy"))


def fidelity(a: Column, b: Column) -> Column:
    """AG16: |<a, b>| / (|a| |b|) of real vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.abs(dot(a, b)) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
