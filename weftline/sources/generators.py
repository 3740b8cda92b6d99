"""Seed and literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, sources, targets and weights of the screening diagram (places count from 1).
NAMES = ["IEEE", "ACM", "Scopus", "Tier 1", "Tier 2", "Tier 3", "Included", "Excluded"]
SRC = [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6]
DST = [4, 5, 6, 4, 5, 6, 4, 5, 6, 7, 8, 7, 8, 7, 8]
WEIGHTS = [0, 1, 31, 52, 77, 131, 1, 0, 23, 7, 46, 28, 50, 151, 34]
FLOW_NODES = list(enumerate(NAMES, 1))
FLOWS = list(zip(SRC, DST, WEIGHTS, strict=True))

# The knapsack's values and weights.
KNAPSACK_VALUES = [4, 2, 2, 5, 6]
KNAPSACK_WEIGHTS = [4, 3, 3, 7, 8]

# Authors (name, birth year), and books (title, place of the author, copies, year).
AUTHORS = [("J.R.R. Tolkien", 1892), ("Andrzej Sapkowski", 1948), ("George R.R. Martin", 1948)]
BOOKS = [
    ("My Random Book", 0, 5000, 2000),
    ("The Hobbit", 0, 5, 1937),
    ("The Fellowship of the Ring", 0, 3, 1954),
    ("The Two Towers", 0, 3, 1954),
    ("The Return of the King", 0, 3, 1955),
    ("The Last Wish", 1, 4, 1993),
    ("Sword of Destiny", 1, 4, 1992),
    ("Blood of Elves", 1, 2, 1994),
    ("Time of Contempt", 1, 2, 1995),
    ("A Game of Thrones", 2, 6, 1996),
    ("A Clash of Kings", 2, 5, 1998),
    ("A Storm of Swords", 2, 4, 2000),
    ("A Feast for Crows", 2, 3, 2005),
    ("A Dance with Dragons", 2, 3, 2011),
    ("Fire & Blood", 2, 2, 2018),
    ("The World of Ice & Fire", 2, 1, 2014),
]


def flow_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLOW_NODES, "id int, name string")


def flows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLOWS, "src int, dst int, w int")


def seed_library(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """SC3: authors (id, name, birth_year) and books (id, title, author_id, copies, publication_year); ids tell the place, they are not random."""
    authors = spark.createDataFrame([(f"a{i}", *a) for i, a in enumerate(AUTHORS, 1)], "id string, name string, birth_year int")
    books = [(f"b{k}", title, f"a{i + 1}", n, year) for k, (title, i, n, year) in enumerate(BOOKS, 1)]
    return authors, spark.createDataFrame(books, "id string, title string, author_id string, copies int, publication_year int")


def seed_summary(spark: SparkSession) -> DataFrame:
    authors, books = seed_library(spark)
    each = books.agg(F.count(F.lit(1)).cast("int").alias("n_books"), *[F.sum(F.when(F.col("author_id") == f"a{i}", F.col("copies"))).alias(name) for i, name in enumerate(("first", "second", "third"), 1)])
    return authors.agg(F.count(F.lit(1)).cast("int").alias("n_authors")).crossJoin(each)  # one row each
