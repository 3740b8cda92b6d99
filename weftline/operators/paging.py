"""Listings: sorted pages, page metadata, lookups, and the filter-sort-page interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest page that may be asked for.
MAX_LIMIT = 100


def check_page(page: int, limit: int) -> None:
    """PF7: page from 1, limit from 1 to MAX_LIMIT; checked before anything is planned."""
    if page < 1:
        raise ValueError("page must be 1 or more")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")


def page_of(df: DataFrame, key: str | list, page: int, limit: int) -> DataFrame:
    """SL1: rows (page-1)*limit up to page*limit in key order; planned as one top-k, not a full sort. Beyond the end: no rows."""
    check_page(page, limit)
    return df.orderBy(*([key] if isinstance(key, (str, Column)) else key)).offset((page - 1) * limit).limit(limit)


def page_problem(page: Column, limit: Column) -> Column:
    """PF7 for requests that are rows: what is wrong with a page and limit, null if nothing."""
    return F.when(page.isNull() | (page < 1), F.lit("page")).when(limit.isNull() | ~limit.between(1, MAX_LIMIT), F.lit("limit"))


def page_after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """SL1 by key: the rows after the last key of the page before (None: the first page). A deep page costs as much as the first: the filter reaches the scan, and the top-k holds limit rows."""
    check_page(1, limit)
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def page_meta(df: DataFrame, page: int, limit: int) -> DataFrame:
    """SL2, AG1: one row of metadata, also for a page beyond the end or an empty table."""
    check_page(page, limit)
    total = df.agg(F.count(F.lit(1)).alias("total_items"))
    return total.select("total_items", ((F.col("total_items") + limit - 1) / F.lit(limit)).cast("long").alias("total_pages"), F.lit(page).cast("long").alias("current_page"), F.lit(limit).cast("long").alias("page_size"), (F.col("total_items") > page * limit).alias("has_next"), F.lit(page > 1).alias("has_previous"))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """SC2: the row of a key; no row means it was not found."""
    return df.where(F.col(key) == F.lit(value))


def with_lookup(rows: DataFrame, names: DataFrame, on: str, name: str, default: str) -> DataFrame:
    """JN1: rows with the looked-up name, or default where the key is unknown.

    Written for rows that are a page already, so the join moves a page at most; how
    names is joined is left to its size.
    """
    return rows.join(names, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def filtered_page(df: DataFrame, filters: list[Column], sort: str, order: str, tie: str, page: int, limit: int) -> DataFrame:
    """Filter conjunction, sort key with direction, page (specified by the reference, not implemented there)."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    for f in filters:
        df = df.where(f)
    return page_of(df, [F.col(sort).asc() if order == "asc" else F.col(sort).desc(), F.col(tie).asc()], page, limit)


def missing_keys(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """PF3, SO1: asked rows whose key is not known, duplicates kept."""
    return asked.join(known.select(key).distinct(), key, "left_anti")


def existing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JN2: rows whose foreign key exists."""
    return rows.join(known.select(key), key, "left_semi")
