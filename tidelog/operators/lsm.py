"""Log-structured storage: sorted tables, Bloom filters, compaction and the write-ahead log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.model import hash60, is_tombstone
from tidelog.operators.lww import latest, live

FLUSH_BITS, COMPACT_BITS, WRITE_BITS, PROBES = 1024, 4096, 10000, 3
FLUSH_KEYS, COMPACT_FILES = 3, 4

#: Sorted tables are Parquet files with key statistics and a Bloom filter, so that reads by key skip most of them.
OPTIONS = {"compression": "lz4_raw", "parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def probes(key: Column, bits: int = FLUSH_BITS) -> Column:
    """The bit positions of a key: double hashing."""
    h1, h2 = hash60(key), hash60(F.concat(key, F.lit("*")))
    return F.array(*[((h1 + F.lit(i) * h2) % bits).cast("bigint") for i in range(PROBES)])


def bloom_build(ssts: DataFrame, bits: int = FLUSH_BITS) -> DataFrame:
    """sst_id and bit: the set bits of each sorted table's filter, at most `bits` of them."""
    return ssts.select("sst_id", F.explode(probes(F.col("key"), bits)).alias("bit")).distinct()


def bloom_probe(keys: DataFrame, filters: DataFrame, bits: int = FLUSH_BITS) -> DataFrame:
    """key, sst_id, maybe: whether a table's filter has all of a key's bits."""
    asked = keys.select("key", F.array_distinct(probes(F.col("key"), bits)).alias("p")).select("key", F.size("p").alias("n"), F.explode("p").alias("bit"))
    hit = asked.join(filters, "bit").groupBy("key", "sst_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
    return hit.select("key", "sst_id", (F.col("hits") == F.col("n")).alias("maybe"))


def flush(log: DataFrame) -> DataFrame:
    """The entries of each sorted table: the winners within it, when it has enough keys."""
    one = log.groupBy("sst_id", "key").agg(F.max(F.struct("physical_time", "logical_counter", "node_id", "value")).alias("w"))
    entries = one.select("sst_id", "key", "w.value", "w.physical_time", "w.logical_counter", "w.node_id")
    enough = entries.groupBy("sst_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FLUSH_KEYS).select("sst_id")
    return entries.join(enough, "sst_id", "left_semi")


def write_tables(entries: DataFrame, path: str) -> None:
    """One directory for each table; its files are ranges of keys, sorted."""
    ranged = entries.repartitionByRange("sst_id", "key").sortWithinPartitions("sst_id", "key")
    ranged.write.partitionBy("sst_id").options(**OPTIONS).mode("overwrite").parquet(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the tables below path, with sst_id."""
    return spark.read.schema("key string, value string, physical_time long, logical_counter long, node_id string, sst_id long").parquet(path)


def summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("sst_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def compact(entries: DataFrame, gc_grace_ms: int = 0, now_ms: int | None = None) -> DataFrame:
    """The winners of all tables, without deletions (those older than the grace period, where there is one)."""
    state = latest(entries)
    if gc_grace_ms:
        return state.filter(~is_tombstone(F.col("value")) | (F.col("physical_time") > F.lit(now_ms - gc_grace_ms)))
    return live(state)


def replay(wal: DataFrame) -> DataFrame:
    """The memory table that a write-ahead log stands for."""
    return latest(wal)
