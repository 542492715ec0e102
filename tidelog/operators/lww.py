"""Last-write-wins: state, reads and merges of mutation logs.

The winner of a key is the row with the greatest hybrid logical clock (time,
counter, node), and of equal clocks the greatest value, so merging commutes.
Deletions take part and are dropped afterwards only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.model import LOG_COLUMNS, TOMBSTONE, hlc, is_tombstone


def latest(log: DataFrame) -> DataFrame:
    """The winning row of every key, deletions included.  Combined before its only shuffle.

    Strings in the winner make this a sorting aggregate; the key's hash as the
    first grouping column lets it sort by a number.
    """
    best = log.groupBy(F.xxhash64("key").alias("hash"), "key").agg(F.max(hlc()).alias("w"))
    return best.select("key", "w.value", "w.physical_time", "w.logical_counter", "w.node_id")


def live(state: DataFrame) -> DataFrame:
    """A state without its deletions."""
    return state.filter(~is_tombstone(F.col("value")))


def state_scan(*logs: DataFrame) -> DataFrame:
    """The live state over logs (a memory table and sorted tables, say)."""
    return live(latest(union(*logs))).select("key", "value", "physical_time")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).filter(is_tombstone(F.col("value"))).select("key", "physical_time")


def union(*logs: DataFrame) -> DataFrame:
    out = logs[0].select(*LOG_COLUMNS)
    for other in logs[1:]:
        out = out.unionByName(other.select(*LOG_COLUMNS))
    return out


def merge(*logs: DataFrame) -> DataFrame:
    """The merged state of diverged replicas: commutative, associative, idempotent."""
    return latest(union(*logs))


def point_get(log: DataFrame, keys: list[str]) -> DataFrame:
    """key, status (found, deleted, not_found) and value of the keys asked for; the filter reaches the scan."""
    spark = log.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    state = latest(log.filter(F.col("key").isin(keys))).select("key", "value")
    status = F.when(F.col("value").isNull(), "not_found").when(is_tombstone(F.col("value")), "deleted").otherwise("found")
    return asked.join(state, "key", "left").select("key", status.alias("status"), F.when(status == "found", F.col("value")).alias("value"))


def hlc_order(log: DataFrame) -> DataFrame:
    """key, pos and value: every key's writes in clock order."""
    order = Window.partitionBy("key").orderBy("physical_time", "logical_counter", "node_id", "value")
    return log.select("key", F.row_number().over(order).cast("bigint").alias("pos"), "value")


def write_path(log: DataFrame) -> DataFrame:
    """key, writes, accepted and rejected, as rows arrive by seq: accepted if newer than all before."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    clock = F.struct("physical_time", "logical_counter", "node_id")
    seen = log.select("key", clock.alias("c"), F.max(clock).over(before).alias("best"))
    taken = F.col("best").isNull() | (F.col("c") > F.col("best"))
    return seen.groupBy("key").agg(F.count(F.lit(1)).alias("writes"), F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("rejected"))


def upsert(op: Column, value: Column) -> Column:
    """The value that a set or delete request writes."""
    return F.when(op == "delete", F.lit(TOMBSTONE)).otherwise(value)
