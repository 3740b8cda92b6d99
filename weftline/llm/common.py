"""What several operators share: tables, row keys, tables in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space, and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here, and the rows survive executors.

    The shuffle files of the write go when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    had = spark.conf.get(CLEANUP, None)
    if had is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if had is not None:
            spark.conf.set(CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables from which nothing will be read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._weftline_path)
        path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """These names, each with as many underscores before it as it takes for no column of df to have it (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not inlined as a projected column may be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row by its id and text. Rows alike in both are one document, whatever their number."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.coalesce(F.col(text_col), F.lit("\x02"))).cast("binary"))


#: A key is hot when it holds more than this share of the rows; so fewer than its inverse are.
HOT_SHARE = 1000
HOT_LEAST = 100


def join_one(many: DataFrame, one: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """many joined with one, which has one row a key and in ``count`` how many rows of many have it.

    Keys above a thousandth of all rows cannot be more than a thousand: their rows of
    one are broadcast, and the hot rows of many stay where they are. The rest is
    shuffled by a key that is not hot. how: inner or left.
    """
    hot = F.col(count) > max(HOT_LEAST, total // HOT_SHARE)
    heavy, rest = one.where(hot), one.where(~hot)
    here = F.broadcast(heavy)
    # The hot rows are taken out before the shuffle, which else would gather those of a key in one task.
    light = many.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return many.join(here, key).unionByName(light.join(rest, key, how))


#: Records of a batch that goes to a Python worker and back; Spark's own default makes batches of whole texts large in both processes.
BATCH_RECORDS = 1000


def modest(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of BATCH_RECORDS, unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_RECORDS))


#: What a worker keeps from task to task: a name, and what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(keep: str) -> None:
    """Drop what other operators have kept. (A function of this module, so a worker runs it on its own KEPT; a nested function would bring a copy of the driver's.)"""
    for name in [n for n in KEPT if n != keep]:
        KEPT.pop(name)()


def lean() -> None:
    """Have the C library return large blocks at once and keep few arenas; without effect where it knows no such settings."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: blocks from 1 MB are mapped, and unmapped when freed
        libc.mallopt(-8, 2)  # M_ARENA_MAX
        libc.malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """run, giving freed memory back when its rows end: a Python worker lives on from stage to stage and would keep it.

    What other operators have kept in the worker is dropped first (keep: the name of run's own).
    """

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drop_kept(keep)
        lean()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        lean()

    return whole
