"""Array, map and nested functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grades of a student record by number.
GRADES = ["NDST", "DST", "DST_P", "DB", "DB_P", "BDB"]


def affine(a: Column) -> Column:
    """AR1: x * 2 + 1."""
    return F.transform(a, lambda x: x * 2 + 1)


def dot(x: Column, y: Column, zero: Column) -> Column:
    """AG18."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)


def int_matvec(matrix: Column, vector: Column) -> Column:
    """AR2: integer matrix by vector, each entry shifted right by one (arithmetically)."""
    return F.transform(matrix, lambda row: F.shiftright(dot(row, vector, F.lit(0)), 1))


def grade_names(numbers: Column) -> Column:
    """AR3: null for a number without a grade."""
    names = F.array(*[F.lit(g) for g in GRADES])
    return F.transform(numbers, lambda g: F.get(names, g))


def chosen_id(student: Column) -> Column:
    """AR4: the arm of the union that is set: the number, else the address."""
    return F.coalesce(student["nr_albumu"].cast("string"), student["email"])


def same_fields(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """AR5: for each key whether all fields are equal, nulls included; keys of either side."""
    left, right = a.select(key, F.struct(*cols).alias("_a")), b.select(key, F.struct(*cols).alias("_b"))
    return left.join(right, key, "full").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def grover(n: int, marked: Column, rounds: int) -> Column:
    """Amplitudes of n qubits after rounds of search for a marked state: the oracle turns its sign, then all are reflected about their mean."""
    size = 1 << n
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.lit(size**-0.5))

    def step(a: Column, _: Column) -> Column:
        turned = F.transform(a, lambda x, k: F.when(k == marked, -x).otherwise(x))
        mean = F.aggregate(turned, F.lit(0.0), lambda s, x: s + x) / size
        return F.transform(turned, lambda x: 2 * mean - x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def bit_table(spark: SparkSession, n: int) -> DataFrame:
    """SC17: every vector of n bits with its number, first bit the highest."""
    bits = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.col("id"), k).bitwiseAND(F.lit(1)).cast("int"))
    return spark.range(1 << n).select("id", bits.alias("bits"))


def uniform_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """SC18: n rows of a uniform number and a day of the week; the generator is Spark's, so it agrees with others in distribution only."""
    return spark.range(n).select("id", F.rand(seed).alias("u"), F.floor(F.rand(seed + 1) * 7).cast("int").alias("day"))
