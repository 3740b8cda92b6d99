"""Mutations as table-to-table transforms: nothing changes in place, so nothing needs a rollback (MU13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.validation import overlay


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """MU1: the table with new rows; columns are matched by name, absent ones are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def replace(df: DataFrame, rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """MU2: rows replace those of equal key whole, but for the columns in keep; unknown keys are ignored."""
    held = df.select(key, *keep)
    new = rows.drop(*keep).join(held, key)
    return df.join(rows.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(df: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """MU3: patches have key, and for each field f the columns has_f and new_f; a present null deletes (PF9)."""
    out = df.join(patches, key, "left")
    new = {f: overlay(F.col(f), F.coalesce(F.col(f"has_{f}"), F.lit(False)), F.col(f"new_{f}")) for f in fields}
    return out.withColumns(new).select(df.columns)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """MU4: the table without these keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """MU4: parents without these keys, and children without rows that refer to them."""
    gone = keys.select(F.col(key).alias(foreign)).distinct()
    return delete(parents, keys, key), children.join(gone, foreign, "left_anti")


def bulk_update(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """MU5: the same values for all keys, or no change at all if any key is missing."""
    asked = keys.select(key).distinct()
    lost = asked.join(df.select(key), key, "left_anti").agg((F.count(F.lit(1)) == 0).alias("_all_there"))
    marked = df.join(asked.withColumn("_hit", F.lit(True)), key, "left").crossJoin(F.broadcast(lost))  # one row
    hit = F.col("_hit") & F.col("_all_there")
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(df.columns)


def prefix_check(items: DataFrame, stock: DataFrame, key: str, order: list[str], qty: str, copies: str) -> DataFrame:
    """WN1: well-formed items with the running quantity of their key, itself included, and whether it fits the stock.

    Malformed items (no positive quantity, unknown key) do not accumulate; one that
    exceeds the stock does.
    """
    good = items.where(F.col(qty) > 0).join(stock.select(key, copies), key)
    running = F.sum(qty).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return good.withColumn("running_qty", running).withColumn("fits", F.col("running_qty") <= F.col(copies))


def bulk_order(items: DataFrame, stock: DataFrame, batch: str, key: str, qty: str, copies: str, most: int = 50) -> DataFrame:
    """MU7: for each batch whether it is accepted: 1 to most items, all well-formed, and each key's total within its stock."""
    per_key = items.groupBy(batch, key).agg(F.sum(qty).alias("_q"), F.min(qty).alias("_least"), F.count(F.lit(1)).alias("_n"))
    judged = per_key.join(stock.select(key, copies), key, "left")
    fits = F.coalesce((F.col("_q") <= F.col(copies)) & (F.col("_least") > 0), F.lit(False))
    return judged.groupBy(batch).agg(F.sum("_n").alias("n_items"), (F.bool_and(fits) & (F.sum("_n") <= most)).alias("accepted"))


def place_orders(stock: DataFrame, orders: DataFrame, key: str, seq: str, qty: str, copies: str) -> DataFrame:
    """MU6: key, seq, outcome of orders in turn: 201 while the stock left suffices (and is taken), else 409 (and nothing is taken); 404 for an unknown key, 400 without a positive quantity.

    Whether an order is met depends on all before it of its key, so the rows come sorted
    by key and number and a task holds one stock at a time. A window sees to that, as Spark
    must keep its keys whole. A repartition does not: it is dropped above a shuffled join by
    the same key, which adaptive execution may then broadcast or split, so that a key's rows
    lie in several tasks.
    """
    rows = orders.join(stock.select(key, copies), key, "left").select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(qty).cast("double").alias("q"), F.col(copies).cast("double").alias("c"))

    def run(batches):
        left = None
        for pdf in batches:
            out = []
            for _, _, q, c, first in pdf.itertuples(index=False):
                if first:
                    left = c
                if c != c or c is None:
                    out.append(404)
                elif not q > 0:
                    out.append(400)
                elif q <= left:
                    left -= q
                    out.append(201)
                else:
                    out.append(409)
            yield pdf.assign(outcome=out)[["k", "s", "outcome"]]

    types = dict(rows.dtypes)
    whole = rows.withColumn("first", F.row_number().over(Window.partitionBy("k").orderBy("s")) == 1)
    done = whole.mapInPandas(run, f"k {types['k']}, s {types['s']}, outcome int")
    return done.select(F.col("k").alias(key), F.col("s").alias(seq), "outcome")


def take_stock(stock: DataFrame, items: DataFrame, key: str, qty: str, copies: str, sign: int = -1) -> DataFrame:
    """MU6 (sign -1) and MU8, MU9 (sign 1): the stock less, or plus, the items' quantities by key (AG2)."""
    moved = items.groupBy(key).agg(F.sum(qty).alias("_moved"))
    return stock.join(moved, key, "left").withColumn(copies, F.col(copies) + sign * F.coalesce("_moved", F.lit(0))).drop("_moved")


def return_orders(orders: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    """MU9: orders with outcome 200 (created, now returned) or 409 (asked for, but not created); others null."""
    asked = orders.join(keys.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left")
    outcome = F.when(F.col("_asked"), F.when(F.col(status) == "created", F.lit(200)).otherwise(F.lit(409)))
    return asked.withColumn("outcome", outcome).withColumn(status, F.when(F.col("outcome") == 200, F.lit("returned")).otherwise(F.col(status))).drop("_asked")


def purge(df: DataFrame, gone: Column) -> DataFrame:
    """MU10: the table without the rows for which gone holds; how many went is the difference of counts."""
    return df.where(~F.coalesce(gone, F.lit(False)))


def first_success(log: DataFrame, key: list, seq: str, status: str) -> DataFrame:
    """MU11, M2: of each idempotency key the first response with a 2xx status."""
    good = log.where((F.col(status) >= 200) & (F.col(status) < 300))
    return good.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).where("_k = 1").drop("_k")


def transaction(snapshot: DataFrame, changed: DataFrame, problems: DataFrame) -> DataFrame:
    """MU13: the changed table, or the snapshot as it was if there is any problem. One row decides; neither table is written before."""
    ok = problems.limit(1).agg((F.count(F.lit(1)) == 0).alias("_ok"))
    kept = changed.crossJoin(F.broadcast(ok)).where("_ok").drop("_ok")  # one row
    return kept.unionByName(snapshot.crossJoin(F.broadcast(ok)).where("NOT _ok").drop("_ok"), allowMissingColumns=True)


def etag(*columns: Column) -> Column:
    """MU12, ST7: first 16 hex digits of the md5 of a canonical text: the values in a given order, joined by '|', null as ''."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary")), 1, 16)
