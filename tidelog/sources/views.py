"""Canonical views: mutation logs, peers, replicas, heartbeats and accesses over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.model import TOMBSTONE, epoch_ms, hash60

PROBE_MS = 1706659200000  # 2024-01-31 00:00:00 UTC
DOWN = ("node_2", "node_4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, physical_time, logical_counter, node_id, seq from events; errors are deletions."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return log_of_events(e)


def log_of_events(e: DataFrame) -> DataFrame:
    number = F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", TOMBSTONE).otherwise(F.concat("event_type", F.lit(":"), number)).alias("value"),
        epoch_ms(F.col("ts")).alias("physical_time"),
        F.lit(0).cast("bigint").alias("logical_counter"),
        F.concat(F.lit("node_"), (F.col("event_id") % 3).cast("string")).alias("node_id"),
        F.col("event_id").alias("seq"),
    )


def log_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return li.select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("key"),
        F.when(F.col("l_returnflag") == "R", TOMBSTONE).otherwise(F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))).alias("value"),
        epoch_ms(F.col("l_shipdate")).alias("physical_time"),
        F.col("l_linenumber").cast("bigint").alias("logical_counter"),
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("node_id"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and alive of the five nodes."""
    node = F.concat(F.lit("node_"), F.col("r_regionkey").cast("string"))
    return table(spark, sf_dir, "region").select(node.alias("node_id"), (~node.isin(*DOWN)).alias("alive"))


def replica(log: DataFrame, name: str) -> DataFrame:
    """The rows of a log that a replica has: four fifths, decided by the row."""
    return log.filter(hash60(F.concat(F.lit(name), F.col("seq").cast("string"))) % 10 < 8)


def sorted_tables(log: DataFrame) -> DataFrame:
    """log with sst_id, the week of its time."""
    return log.withColumn("sst_id", F.floor(F.col("physical_time") / 604800000).cast("bigint"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node (a user) and ms of each of its beats."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), epoch_ms(F.col("ts")).alias("ms"))


def cache_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, key and pos (the order of time, then event) of reads at three nodes."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return e.select((F.col("event_id") % 3).alias("node"), F.col("user_id").alias("key"), epoch_ms(F.col("ts")).alias("ms"), "event_id")
