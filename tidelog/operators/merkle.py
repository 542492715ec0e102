"""Digests, Merkle summaries and the repair of diverged replicas.

Comparisons take a log or a state of either side.  The sides' rows of a key meet
in one aggregate, combined before its only shuffle, whatever is asked of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.model import LOG_COLUMNS, MERKLE_BUCKETS, entry_hash, hash60, hlc
from tidelog.operators.lww import latest, union


def bucket(key: Column) -> Column:
    return (hash60(key) % MERKLE_BUCKETS).cast("bigint")


def digest(memory: DataFrame, *tables: DataFrame, scope: str = "all") -> DataFrame:
    """key and physical_time of the winners: of all that is given, or of the memory table alone (scope "memtable")."""
    if scope not in ("all", "memtable"):
        raise ValueError(f"unknown scope {scope!r}")
    every = union(memory, *tables) if scope == "all" and tables else memory
    return latest(every).select("key", "physical_time")


def buckets(state: DataFrame) -> DataFrame:
    """bucket and hash: the XOR of the entry hashes of its keys."""
    return state.groupBy(bucket(F.col("key")).alias("bucket")).agg(F.bit_xor(entry_hash()).alias("hash"))


def root(state: DataFrame) -> DataFrame:
    """root, the XOR of all bucket hashes, and n_keys (equal changes cancel out in an XOR)."""
    return state.agg(F.coalesce(F.bit_xor(entry_hash()), F.lit(0)).cast("bigint").alias("root"), F.count(F.lit(1)).alias("n_keys"))


def both(here: DataFrame, there: DataFrame) -> DataFrame:
    """key, here and there: each side's winner of the key, null where it has none."""
    sides = here.select(*LOG_COLUMNS, F.lit(True).alias("own")).unionByName(there.select(*LOG_COLUMNS, F.lit(False).alias("own")))
    winner = lambda own: F.max(F.when(own, hlc()))
    met = sides.groupBy(F.xxhash64("key").alias("hash"), "key").agg(winner(F.col("own")).alias("here"), winner(~F.col("own")).alias("there"))
    return met.select("key", "here", "there")


def side_hash(side: str) -> Column:
    """The entry hash of a side's winner, 0 where it has none."""
    fields = [F.col("key"), *[F.col(f"{side}.{c}").cast("string") for c in LOG_COLUMNS[1:]]]
    return F.when(F.col(side).isNull(), F.lit(0).cast("bigint")).otherwise(hash60(F.concat_ws("|", *fields)))


def differing(met: DataFrame) -> DataFrame:
    """bucket, hash_a and hash_b where the summaries of here and there differ; 16 rows at most."""
    sums = met.groupBy(bucket(F.col("key")).alias("bucket")).agg(F.bit_xor(side_hash("here")).alias("hash_a"), F.bit_xor(side_hash("there")).alias("hash_b"))
    return sums.filter("hash_a <> hash_b")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket, hash_a and hash_b where two replicas' summaries differ; a missing bucket is 0."""
    return differing(both(a, b))


def pull(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, remote_ts and local_ts of the keys that local lacks or has older."""
    met = both(local, remote).select("key", F.col("there.physical_time").alias("remote_ts"), F.col("here.physical_time").alias("local_ts"))
    return met.filter("remote_ts IS NOT NULL AND (local_ts IS NULL OR remote_ts > local_ts)")


def push(local: DataFrame, peer: DataFrame) -> DataFrame:
    """key, value, local_ts and peer_ts of the keys in mismatched buckets that the peer has older, or not at all (0)."""
    met = both(local, peer)
    wrong = differing(met).select("bucket")
    peer_ts = F.coalesce("there.physical_time", F.lit(0)).cast("bigint").alias("peer_ts")
    newer = met.select("key", "here.value", F.col("here.physical_time").alias("local_ts"), peer_ts).filter("local_ts > peer_ts")
    return newer.join(F.broadcast(wrong), bucket(F.col("key")) == F.col("bucket"), "left_semi")  # 16 rows


def repaired_side(own: str, other: str) -> Column:
    """The winner of a key after `own` has pulled from `other` what the digest comparison asks for."""
    asked = F.col(own).isNull() | (F.col(f"{other}.physical_time") > F.col(f"{own}.physical_time"))
    return F.when(asked, F.col(other)).otherwise(F.col(own))


def repaired(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local's state after it has pulled what the digest comparison asks for."""
    return both(local, remote).select("key", repaired_side("here", "there").alias("w")).select("key", *[F.col(f"w.{c}").alias(c) for c in LOG_COLUMNS[1:]])


def mismatched_after_repair(a: DataFrame, b: DataFrame) -> DataFrame:
    """mismatched: the buckets in which the replicas still differ when each has pulled from the other."""
    met = both(a, b).select("key", repaired_side("here", "there").alias("here"), repaired_side("there", "here").alias("there"))
    return differing(met).agg(F.count(F.lit(1)).alias("mismatched"))
