"""Shared folder, written tables and size-checked broadcasts for the text operators."""

from __future__ import annotations

import ctypes
import gc
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the cluster names no shared folder (local sessions, tests).
LOCAL_FOLDER = "file:///tmp/checkpoints/tidelog"

#: A side may be broadcast when its rows, measured, take no more bytes than this.
BROADCAST_BYTES = 48 << 20

#: Rows and bytes of an Arrow batch: long texts must not add up to more than a worker can hold.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20

#: Copies of a side that is too large to broadcast; the rows of a hot key are dealt over as many tasks.
SALTS = 16

#: What operators keep in a Python worker from task to task, to be made again when missing.
KEPT: list[dict] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = LOCAL_FOLDER
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in the application's own folder, which goes when the application ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/tidelog/{context.applicationId}"
    if getattr(context, "_tidelog_folder", None) != folder:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(place)
        store.deleteOnExit(place)
        context._tidelog_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df as a table written in the shared folder: cuts lineage, survives lost executors.

    paths: gets the table's path, for discard() once all that reads it is written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once in an application, by way of the shared folder."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_tidelog_shipped", False) or not package.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for part in sorted(package.rglob("*.py")):
            z.write(part, f"{package.name}/{part.relative_to(package)}")
    path = f"{scratch_path(spark, 'code')}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path)
    context._tidelog_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Before Python works on texts: ship the package, and bound an Arrow batch, for every operator alike."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of glibc
        libc.malloc_trim(0)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose worker keeps nothing: other operators' tables go before, freed memory goes back after it.

    Workers wait beside their executor for tasks of any operator, so what they hold is taken from all later stages.
    """

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        for tables in KEPT:
            tables.clear()
        try:
            yield from function(batches)
        finally:
            gc.collect()
            give_back()

    return run


def join_side(rows: DataFrame, side: DataFrame, on: list[str], row_bytes, how: str = "inner") -> DataFrame:
    """rows joined with a written table that has a row for each key at most, whatever part of rows a key has.

    The side is broadcast if its measured size allows it; else it is copied
    SALTS times, so that the rows of one key are dealt over as many tasks.  Nulls
    in keys equal nulls.  The key columns of rows stay.
    """
    small = sized(side, row_bytes)[1]
    named = [f"side_{k}_" for k in on]
    for k, n in zip(on, named):
        side = side.withColumnRenamed(k, n)
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(on, named)])
    if small:
        return rows.join(F.broadcast(side), met, how).drop(*named)
    copies = side.withColumn("side_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(copies, met & (F.col("salt_") == F.col("side_salt_")), how).drop(*named, "salt_", "side_salt_")


def sized(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its measured size is within the limit, and whether it is."""
    size = df.agg(F.sum(row_bytes + F.lit(16)).alias("n")).first()["n"] or 0
    return (F.broadcast(df), True) if size <= limit else (df, False)


def broadcast_if_small(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is within the limit, else df as it is.

    row_bytes: a Column, the bytes of a row.  df should be a written table, as it is read for this.
    """
    return sized(df, row_bytes, limit)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_of(column: str = "text"):
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))
