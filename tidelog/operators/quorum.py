"""Quorum writes, hinted handoff, coordinated reads and read repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.model import LOG_COLUMNS, hlc, is_tombstone
from tidelog.operators.lww import latest, union

WRITE_QUORUM = 2

#: Sequence numbers whose hints are counted together.
RUN = 4096


def acks(placed: DataFrame, peers: DataFrame) -> DataFrame:
    """key, replicas, acks, required and status of a write to each key; peers (node_id, alive) is metadata."""
    met = placed.join(F.broadcast(peers), "node_id", "left")
    alive = F.coalesce("alive", F.lit(False))
    out = met.groupBy("key").agg(F.count(F.lit(1)).alias("replicas"), F.count_if(alive).alias("acks"))
    required = F.least(F.lit(WRITE_QUORUM).cast("bigint"), F.col("replicas"))
    return out.select("key", "replicas", "acks", required.alias("required"), F.when(F.col("acks") >= required, "success").otherwise("failed").alias("status"))


def hints(writes: DataFrame, placed: DataFrame, peers: DataFrame) -> DataFrame:
    """target, seq, key, value: the writes that wait for a replica that is down."""
    down = placed.join(F.broadcast(peers.filter("NOT alive").select("node_id")), "node_id", "left_semi")
    waiting = down.select("key", F.col("node_id").alias("target"))
    return writes.select("key", "value", "seq").join(waiting, "key").select("target", "seq", "key", "value")


def deliver(queue: DataFrame, peers: DataFrame, ok: Column) -> DataFrame:
    """target, delivered and remaining of queues (target, seq, ...) drained in order up to the first failure.

    Hints for targets that aren't among the peers stay.  Hints are read once and
    counted in runs of RUN sequence numbers, combined before the shuffle, each
    with its first failure and how many came before that; the runs of a target,
    few, then tell its totals.  No queue is sorted or gathered.
    """
    known = queue.join(F.broadcast(peers.select(F.col("node_id").alias("target"), F.lit(True).alias("known"))), "target", "left")
    sent = (ok & F.coalesce("known", F.lit(False))).alias("sent")
    each = known.select("target", "seq", F.floor(F.col("seq") / RUN).alias("run"), sent)
    # of a run: its hints, and those that were sent before its first failure, by the places of the ones that fail
    runs = each.groupBy("target", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("sent"), F.col("seq"))).alias("stop"), F.collect_list("seq").alias("seqs"))
    before = F.when(F.col("stop").isNull(), F.col("n")).otherwise(F.size(F.filter("seqs", lambda s: s < F.col("stop"))))
    counted = runs.select("target", "run", "n", "stop", before.alias("before"))
    first = F.min(F.when(F.col("stop").isNotNull(), F.col("run"))).over(Window.partitionBy("target"))
    delivered = F.when(F.col("first").isNull() | (F.col("run") < F.col("first")), F.col("n")).when(F.col("run") == F.col("first"), F.col("before")).otherwise(0)
    totals = counted.withColumn("first", first).withColumn("delivered", delivered).groupBy("target")
    return totals.agg(F.sum("delivered").alias("delivered"), F.sum(F.col("n") - F.col("delivered")).alias("remaining"))


def responses(replicas: dict[str, DataFrame]) -> DataFrame:
    """replica, key, value, physical_time ...: each replica's own winner of each key, by one aggregate over all."""
    tagged = reduce(DataFrame.unionByName, [log.select(*LOG_COLUMNS, F.lit(name).alias("replica")) for name, log in sorted(replicas.items())])
    best = tagged.groupBy("key", "replica").agg(F.max(hlc()).alias("w"))
    return best.select("replica", "key", "w.value", "w.physical_time", "w.logical_counter", "w.node_id")


def coordinated_get(replicas: dict[str, DataFrame], read_quorum: int = 1) -> DataFrame:
    """key, value and physical_time of the freshest response; a deletion wins like any write and is then dropped.

    Keys that fewer than read_quorum replicas answer for are left out.  The
    freshest of the replicas' winners is the winner over all their rows, so one
    aggregate tells it, and how many answered.
    """
    if read_quorum <= 1:
        return latest(union(*replicas.values())).filter(~is_tombstone(F.col("value"))).select("key", "value", "physical_time")
    bit = [log.select(*LOG_COLUMNS, F.lit(1 << k).alias("replica")) for k, (_, log) in enumerate(sorted(replicas.items()))]
    best = reduce(DataFrame.unionByName, bit).groupBy("key").agg(F.max(hlc()).alias("w"), F.bit_count(F.bit_or("replica")).alias("answers"))
    found = best.filter((F.col("answers") >= read_quorum) & ~is_tombstone(F.col("w.value")))
    return found.select("key", "w.value", "w.physical_time")


def read_repair(replicas: dict[str, DataFrame], compat: bool = False) -> DataFrame:
    """key, replica, replica_ts and fresh_ts of the replicas to repair: those that answered with an older time.

    compat: the running rule, by which a replica counts as stale if it raises
    the maximum of those before it (by name) or is below it.
    """
    seen = responses(replicas).select("key", "replica", F.col("physical_time").alias("replica_ts"))
    whole = Window.partitionBy("key")
    seen = seen.withColumn("fresh_ts", F.max("replica_ts").over(whole))
    if compat:
        before = F.max("replica_ts").over(whole.orderBy("replica").rowsBetween(Window.unboundedPreceding, -1))
        return seen.withColumn("before", before).filter("before IS NULL OR replica_ts <> before").drop("before")
    return seen.filter("replica_ts < fresh_ts")
