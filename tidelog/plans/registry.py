"""Every registered query: the operators on the canonical views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.model import hash60
from tidelog.operators import clock, detect, lsm, lww, merkle, quorum, ring
from tidelog.operators.store import Store
from tidelog.plans.oracle import ORACLE_SQL
from tidelog.sources import views
from tidelog.streaming import feeds

__all__ = ["ORACLE_SQL", "QUERIES"]

ASKED = ["user_1", "user_2", "user_3", "user_5", "user_8", "user_13", "user_100000000", "nobody"]

Query = Callable[[SparkSession, str], DataFrame]


def keys_of(log: DataFrame) -> DataFrame:
    return log.select("key").distinct()


def replica_logs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    log = views.log_events(s, d)
    return {n: views.replica(log, n) for n in "ABC"}


def placed(s: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    return ring.replicas(keys_of(views.log_events(s, d) if log is None else log), views.peers(s, d))


def node_loads(s: SparkSession, d: str) -> DataFrame:
    """How many keys have each node as their first replica; 0 for the others."""
    first = placed(s, d).filter("rank = 1").groupBy("node_id").agg(F.count(F.lit(1)).alias("load"))
    return views.peers(s, d).select("node_id").join(first, "node_id", "left").select("node_id", F.coalesce("load", F.lit(0)).cast("bigint").alias("load"))


def deletes(s: SparkSession, d: str) -> DataFrame:
    log = views.log_events(s, d)
    return log.filter(lww.is_tombstone(F.col("value")))


def hint_queue(s: SparkSession, d: str) -> DataFrame:
    return quorum.hints(views.log_events(s, d), placed(s, d), views.peers(s, d))


def hint_delivery(s: SparkSession, d: str) -> DataFrame:
    taken = hash60(F.concat(F.lit("ok"), F.col("target"), F.col("seq").cast("string"))) % 100 > 0
    return quorum.deliver(hint_queue(s, d), views.peers(s, d), taken)


def entries(s: SparkSession, d: str) -> DataFrame:
    return lsm.flush(views.sorted_tables(views.log_events(s, d)))


def filled_store(s: SparkSession, d: str, node: str = "node_1", folder: str | None = None) -> Store:
    """A node's store with the log's weekly tables."""
    store = Store(s, folder or feeds.shared(s, "store"), node)
    store.add(entries(s, d))
    return store


def sst_flush(s: SparkSession, d: str) -> DataFrame:
    """The entries of the tables that were written, read back."""
    return filled_store(s, d).read()


def sst_read(s: SparkSession, d: str) -> DataFrame:
    return lsm.summary(filled_store(s, d).read())


def sst_discovery(s: SparkSession, d: str) -> DataFrame:
    """The tables of node_1, in a folder where node_10 has some, too."""
    folder = feeds.shared(s, "store")
    every = entries(s, d)
    Store(s, folder, "node_10").add(every.filter("sst_id % 2 = 1"))
    own = Store(s, folder, "node_1")
    own.add(every.filter("sst_id % 2 = 0"))
    return own.read().groupBy("sst_id").agg(F.count(F.lit(1)).alias("n"))


def compaction(s: SparkSession, d: str) -> DataFrame:
    """The weekly tables merged into one, read back; table 0 is the new one's number."""
    store = filled_store(s, d)
    if not store.compact(0):
        raise ValueError("too few tables to merge")
    return store.read().drop("sst_id")


def wal(s: SparkSession, d: str) -> Store:
    """The log as it was appended, in two parts."""
    store, log = Store(s, feeds.shared(s, "store"), "node_1"), views.log_events(s, d)
    for half in (0, 1):
        store.append(log.filter(F.col("seq") % 2 == half))
    return store


def wal_compact(s: SparkSession, d: str) -> DataFrame:
    """Entries in the write-ahead log before and after it was rewritten."""
    store = wal(s, d)
    before = store.log().count()
    store.rewrite_log()
    return store.log().agg(F.lit(before).cast("bigint").alias("before"), F.count(F.lit(1)).alias("after"))


def bloom_probe(s: SparkSession, d: str) -> DataFrame:
    """Per table: keys asked (all of the log's, and as many absent ones), members, keys that may be in it, and how many of those are not.

    Keys meet the filters' bits, not the tables.
    """
    tables = views.sorted_tables(views.log_events(s, d))
    members = tables.select("sst_id", "key").distinct()
    present = tables.select("key").distinct()
    asked = present.unionByName(present.select(F.concat("key", F.lit("?")).alias("key")))
    maybe = lsm.bloom_probe(asked, lsm.bloom_build(tables)).filter("maybe").select("key", "sst_id", F.lit(1).alias("maybe"), F.lit(0).alias("member"))
    both = maybe.unionByName(members.select("key", "sst_id", F.lit(0).alias("maybe"), F.lit(1).alias("member")))
    met = both.groupBy("sst_id", "key").agg(F.max("maybe").alias("maybe"), F.max("member").alias("member"))
    count = lambda c, name: F.count_if(c).alias(name)
    may, is_member = F.col("maybe") == 1, F.col("member") == 1
    totals = met.groupBy("sst_id").agg(count(is_member, "members"), count(may, "maybe"), count(may & ~is_member, "false_positives"), count(~may & is_member, "missed"))
    return totals.join(F.broadcast(asked.agg(F.count(F.lit(1)).alias("asked"))), how="cross")  # one row


def replica_clocks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    logs = replica_logs(s, d)
    return clock.counts(logs["A"]), clock.counts(logs["B"])


def vclock_writes(s: SparkSession, d: str) -> DataFrame:
    return clock.fold_writes(writes_with_clocks(s, d))


def writes_with_clocks(s: SparkSession, d: str) -> DataFrame:
    """Writes of which three in four come with a client's clock of two nodes."""
    name = lambda k: F.concat(F.lit("node_"), ((F.col("seq") + k) % 3).cast("string"))
    told = F.create_map(name(0), F.col("seq") % 5, name(1), F.col("seq") % 7)
    return views.log_events(s, d).withColumn("client", F.when(F.col("seq") % 4 > 0, told))


def write_local(s: SparkSession, d: str) -> DataFrame:
    """Per node: writes (all logged and notified), those applied, conflicts, keys, the greatest count and the bits set in its filter."""
    done = clock.write_local(writes_with_clocks(s, d))
    per = done.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("writes"), F.count_if("applied").alias("applied"), F.count_if("conflict_compat").alias("conflicts"), F.count_distinct("key").alias("keys"), F.max("own_count").alias("most_writes")
    )
    bits = done.select("node_id", "key", "bits").dropDuplicates(["node_id", "key"]).select("node_id", F.explode("bits").alias("bit")).groupBy("node_id").agg(F.count_distinct("bit").alias("bits"))
    return per.join(bits, "node_id")


def phi(s: SparkSession, d: str) -> DataFrame:
    return detect.phi(views.heartbeats(s, d), views.PROBE_MS)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("node", "n", *[F.round(c, 6).alias(c) for c in ("mean_s", "sd_s", "phi", "phi_monotone")])


def gossip(s: SparkSession, d: str) -> DataFrame:
    e = views.table(s, d, "events")
    return e.select(F.col("user_id").alias("node_id"), views.epoch_ms(F.col("ts")).alias("ms"), (F.col("event_id") % 1000).alias("key_count"))


def membership(s: SparkSession, d: str) -> DataFrame:
    return detect.membership(gossip(s, d), phi(s, d), 0)


def eviction(s: SparkSession, d: str) -> DataFrame:
    """The members that stay when the dead are evicted."""
    scored = phi(s, d)
    newest = gossip(s, d).filter("node_id <> 0").groupBy("node_id").agg(F.max(F.struct("ms", "key_count")).alias("m"))
    return detect.evict(newest.select("node_id", F.col("m.ms").alias("last_seen"), F.col("m.key_count").alias("load")), scored)


def peer_registry(s: SparkSession, d: str) -> DataFrame:
    """The peers after all messages; a presence message that was sent is heard like any other."""
    own = views.peers(s, d).select("node_id", F.lit(0).cast("bigint").alias("root"))
    sent = detect.presence(s.range(1).select(F.lit("node_new").alias("node_id"), F.lit(77).alias("root"))).withColumn("id", F.lit(-1).cast("bigint"))
    return detect.register(own, messages(s, d).unionByName(sent), own="node_0")


def discovery_parse(s: SparkSession, d: str) -> DataFrame:
    return detect.parse_presence(messages(s, d), own="node_0")


def messages(s: SparkSession, d: str) -> DataFrame:
    i, node = F.col("event_id").cast("string"), (F.col("event_id") % 5).cast("string")
    message = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("NODE_ALIVE:node_"), node, F.lit(":abc")))
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit("NODE_ALIVE:node_"), node))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("HELLO:node_"), node, F.lit(":"), i))
        .otherwise(F.concat(F.lit("NODE_ALIVE:node_"), node, F.lit(":"), i))
    )
    return views.table(s, d, "events").select(F.col("event_id").alias("id"), message.alias("message"))


def peer_choice(s: SparkSession, d: str) -> DataFrame:
    rounds = s.range(1000).select(F.col("id").alias("round"), F.concat(F.lit("node_"), (F.col("id") % 5).cast("string")).alias("own"))
    return detect.choose_peer(rounds, views.peers(s, d))


def metrics_counts(s: SparkSession, d: str) -> DataFrame:
    return detect.cache_hits(views.cache_access(s, d)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("reads", "hits", "misses")])


def log(s: SparkSession, d: str) -> DataFrame:
    return views.log_events(s, d)


def memory_and_tables(s: SparkSession, d: str) -> list[DataFrame]:
    """The log split into its newest tenth, still in memory, and the rest in tables."""
    own = log(s, d)
    return [own.filter(F.col("seq") % 10 == 9), own.filter(F.col("seq") % 10 < 9)]


def two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The logs of replicas A and B."""
    logs = replica_logs(s, d)
    return logs["A"], logs["B"]


QUERIES: dict[str, Query] = {
    "lww_latest": lambda s, d: lww.latest(log(s, d)),
    "lww_latest_lineitem": lambda s, d: lww.latest(views.log_lineitem(s, d)),
    "state_scan": lambda s, d: lww.state_scan(*memory_and_tables(s, d)),
    "tombstones": lambda s, d: lww.tombstones(log(s, d)),
    "point_get": lambda s, d: lww.point_get(log(s, d), ASKED),
    "lww_merge": lambda s, d: lww.merge(*[replica_logs(s, d)[n] for n in "AB"]).select("key", "value", "physical_time"),
    "hlc_order": lambda s, d: lww.hlc_order(views.log_lineitem(s, d)),
    "write_path": lambda s, d: lww.write_path(log(s, d)),
    "key_count": lambda s, d: lww.latest(log(s, d)).agg(F.count(F.lit(1)).alias("n_keys")),
    "node_loads": node_loads,
    "digest": lambda s, d: merkle.digest(*memory_and_tables(s, d)),
    "digest_memtable": lambda s, d: merkle.digest(*memory_and_tables(s, d), scope="memtable"),
    "merkle_buckets": lambda s, d: merkle.buckets(lww.latest(log(s, d))),
    "merkle_root": lambda s, d: merkle.root(lww.latest(log(s, d))),
    "merkle_diff": lambda s, d: merkle.diff(*two(s, d)),
    "anti_entropy_pull": lambda s, d: merkle.pull(*two(s, d)),
    "delta_push": lambda s, d: merkle.push(*two(s, d)),
    "replica_convergence": lambda s, d: merkle.mismatched_after_repair(*two(s, d)),
    "anti_entropy_repair": lambda s, d: merkle.repaired(*two(s, d)).select("key", "value", "physical_time"),
    "ring_table": lambda s, d: ring.ring_table(views.peers(s, d)),
    "ring_replicas": placed,
    "ring_replicas_simple": lambda s, d: ring.replicas(keys_of(log(s, d)), views.peers(s, d), vnodes=None),
    "ring_bounded": lambda s, d: ring.bounded(keys_of(log(s, d)), node_loads(s, d)),
    "bounded_capacity": lambda s, d: ring.capacity(node_loads(s, d)),
    "quorum_write": lambda s, d: quorum.acks(placed(s, d), views.peers(s, d)),
    "quorum_delete": lambda s, d: quorum.acks(placed(s, d, deletes(s, d)), views.peers(s, d)),
    "hints_pending": lambda s, d: hint_queue(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("n")),
    "hint_delivery": hint_delivery,
    "coordinated_get": lambda s, d: quorum.coordinated_get(replica_logs(s, d)),
    "coordinated_get_quorum": lambda s, d: quorum.coordinated_get(replica_logs(s, d), read_quorum=3),
    "read_repair": lambda s, d: quorum.read_repair(replica_logs(s, d)),
    "read_repair_compat": lambda s, d: quorum.read_repair(replica_logs(s, d), compat=True),
    "bloom_build": lambda s, d: lsm.bloom_build(views.sorted_tables(log(s, d))),
    "bloom_probe": bloom_probe,
    "sst_read": sst_read,
    "sst_flush": sst_flush,
    "sst_discovery": sst_discovery,
    "compaction": compaction,
    "wal_replay": lambda s, d: lsm.replay(wal(s, d).log()),
    "wal_compact": wal_compact,
    "vclock_state": lambda s, d: clock.counts(log(s, d)),
    "vclock_merge": lambda s, d: clock.merge(*replica_clocks(s, d)),
    "vclock_descends": lambda s, d: clock.compare(*replica_clocks(s, d)).select("key", "a_descends", "b_descends"),
    "vclock_conflicts": lambda s, d: clock.compare(*replica_clocks(s, d)).select("key", "conflict_compat", "conflict_true"),
    "vclock_writes": vclock_writes,
    "write_local": write_local,
    "heartbeat_intervals": lambda s, d: detect.intervals(views.heartbeats(s, d)),
    "phi_accrual": lambda s, d: rounded(phi(s, d)),
    "phi_dead": lambda s, d: detect.dead(phi(s, d)).select("node"),
    "membership": membership,
    "eviction": eviction,
    "discovery_parse": discovery_parse,
    "peer_registry": peer_registry,
    "peer_choice": peer_choice,
    "lru_hits": lambda s, d: detect.cache_hits(views.cache_access(s, d), 40),
    "metrics_counts": metrics_counts,
    "watch_changes": lambda s, d: feeds.watch_changes(log(s, d)),
    "stream_lww": feeds.stream_lww,
    "stream_watch": feeds.stream_watch,
    "stream_state_feed": feeds.stream_state_feed,
    "stream_detectors": feeds.stream_detectors,
}
