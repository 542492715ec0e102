"""Accrual failure detection, membership and cache behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.model import hash60

HISTORY, LEAST_SAMPLES, SD_FLOOR, DEAD_PHI, SMALLEST = 100, 10, 0.001, 8.0, 1e-12
CACHE_KEYS = 100

#: Reads that are settled together, and the time in which a node's reads are numbered together.
BLOCK, SPAN_MS = 1024, 3_600_000
ALIVE_PREFIX = "NODE_ALIVE:"


def intervals(beats: DataFrame) -> DataFrame:
    """node, ms, gap_ms: the time since the node's beat before."""
    w = Window.partitionBy("node").orderBy("ms")
    return beats.select("node", "ms", (F.col("ms") - F.lag("ms").over(w)).alias("gap_ms")).filter("gap_ms IS NOT NULL")


def suspicion(t: Column, mean: Column, sd: Column, monotone: bool = False) -> Column:
    """phi of a silence of t seconds.

    The formula is symmetric about the mean: a beat that comes early is as
    suspicious.  monotone uses the upper tail on both sides.
    """
    y = (t - mean) / sd
    e = F.exp(-y * (F.lit(1.5976) + F.lit(0.070566) * y * y))
    upper = e / (1 + e)
    p = F.nanvl(upper, F.lit(1.0)) if monotone else F.nanvl(F.when(t > mean, upper).otherwise(1 - upper), F.lit(SMALLEST))
    return -F.log10(F.greatest(p, F.lit(SMALLEST)))


def phi(beats: DataFrame, now_ms: int) -> DataFrame:
    """node, n, mean_s, sd_s, phi and phi_monotone at a time, from each node's last 100 gaps; 0 for fewer than 10."""
    back = Window.partitionBy("node").orderBy(F.col("ms").desc())
    last = intervals(beats).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= HISTORY)
    gap = F.col("gap_ms") / 1000.0
    stats = last.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_s"), F.greatest(F.sqrt(F.var_pop(gap)), F.lit(SD_FLOOR)).alias("sd_s"), F.max("ms").alias("last_ms"))
    t = (F.lit(now_ms) - F.col("last_ms")) / 1000.0
    enough = F.col("n") >= LEAST_SAMPLES
    each = [F.when(enough, suspicion(t, F.col("mean_s"), F.col("sd_s"), m)).otherwise(0.0) for m in (False, True)]
    return stats.select("node", "n", "mean_s", "sd_s", each[0].alias("phi"), each[1].alias("phi_monotone"))


def dead(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("phi") > DEAD_PHI)


def membership(gossip: DataFrame, scored: DataFrame, own: str) -> DataFrame:
    """node_id, last_seen, load and status of every node but one's own: its latest message, Dead by phi."""
    newest = gossip.filter(F.col("node_id") != own).groupBy("node_id").agg(F.max(F.struct("ms", "key_count")).alias("m"))
    status = F.when(F.col("phi") > DEAD_PHI, "Dead").otherwise("Alive")
    return newest.join(scored.select(F.col("node").alias("node_id"), "phi"), "node_id", "left").select("node_id", F.col("m.ms").alias("last_seen"), F.col("m.key_count").alias("load"), status.alias("status"))


def evict(peers: DataFrame, scored: DataFrame) -> DataFrame:
    """peers (node_id, ...) without those that the detector holds for dead; its history of them goes with them."""
    gone = dead(scored).select(F.col("node").alias("node_id"))
    return peers.join(gone, "node_id", "left_anti")


def presence(nodes: DataFrame) -> DataFrame:
    """message: what each node (node_id, root) tells the others."""
    return nodes.select(F.concat(F.lit(ALIVE_PREFIX), "node_id", F.lit(":"), F.col("root").cast("string")).alias("message"))


def register(peers: DataFrame, messages: DataFrame, own: str | None = None) -> DataFrame:
    """node_id and root of all peers known (node_id, root) or heard of in messages (id, message), whose latest root counts."""
    heard = parse_presence(messages, own).groupBy("node_id").agg(F.max_by("root", F.struct("id", "root")).alias("heard"))
    known = peers.select("node_id", "root").join(heard, "node_id", "full")
    return known.select("node_id", F.coalesce("heard", "root").alias("root"))


def parse_presence(messages: DataFrame, own: str | None = None) -> DataFrame:
    """id, node_id and root of messages (id, message) of the form prefix, node, colon, root; a root that isn't a number is 0."""
    body = F.substring("message", len(ALIVE_PREFIX) + 1, F.length("message"))
    parts = messages.filter(F.col("message").startswith(ALIVE_PREFIX)).select("id", F.split(body, ":").alias("p")).filter(F.size("p") == 2)
    out = parts.select("id", F.col("p")[0].alias("node_id"), F.coalesce(F.expr("try_cast(p[1] AS BIGINT)"), F.lit(0)).cast("bigint").alias("root"))
    return out.filter(F.col("node_id") != own) if own else out


def choose_peer(rounds: DataFrame, peers: DataFrame) -> DataFrame:
    """round and node_id: for each round the peer, not own, with the least hash of round and name."""
    h = hash60(F.concat_ws("|", F.col("round").cast("string"), "node_id"))
    pairs = rounds.join(F.broadcast(peers.select("node_id")), F.col("own") != F.col("node_id"))  # peers are metadata
    return pairs.groupBy("round").agg(F.min_by("node_id", F.struct(h, "node_id")).alias("node_id"))


def numbered(access: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """node, key and pos, the place of each access (node, key, ms, event_id) among its node's.

    Accesses are counted by spans of time, few, and numbered within these, so a
    node's accesses are never one task's.
    """
    spans = access.select("node", "key", "ms", "event_id", F.floor(F.col("ms") / span_ms).alias("span"))
    counts = spans.groupBy("node", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("node").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    bases = counts.select("node", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("node", "span").orderBy("ms", "event_id")
    return spans.withColumn("at", F.row_number().over(order)).join(bases, ["node", "span"]).select("node", "key", (F.col("base") + F.col("at")).alias("pos"))


def recent_keys(blocks: DataFrame, capacity: int) -> DataFrame:
    """node, block, key, held (its last place) and rank: the `capacity` last different keys before each block (node, block, key, pos).

    A block's keys go on to as many later blocks as it takes until each has
    enough keys, or all there are, before it.
    """
    last = blocks.groupBy("node", "block", "key").agg(F.max("pos").alias("held"))
    heads = blocks.select("node", "block").distinct()
    reach, most = 1, (blocks.agg(F.max("block").alias("m")).first()["m"] or 0)
    while True:
        onward = last.select("node", "key", "held", F.explode(F.sequence(F.col("block") + 1, F.col("block") + reach)).alias("block")).join(heads, ["node", "block"], "left_semi")
        newest = onward.groupBy("node", "block", "key").agg(F.max("held").alias("held"))
        order = Window.partitionBy("node", "block").orderBy(F.col("held").desc())
        kept = newest.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < capacity)
        if reach >= most:
            return kept
        full = kept.groupBy("node", "block").agg(F.count(F.lit(1)).alias("n"))
        short = heads.filter(F.col("block") > reach).join(full, ["node", "block"], "left").filter(F.coalesce("n", F.lit(0)) < capacity)
        if not short.take(1):
            return kept
        reach = min(4 * reach, most)


def cache_hits(access: DataFrame, capacity: int = CACHE_KEYS, block: int = BLOCK) -> DataFrame:
    """node, reads, hits and misses of a least-recently-used cache at each node (access: node, key, ms, event_id).

    A read hits if fewer than `capacity` different keys were read since the
    key's last read.  A node's reads are cut into blocks.  A key last read
    before its block hits only if it is among the capacity last keys there, and
    its rank counts those read since; the others since then are the reads in the
    block whose own last read is before the key's.  So all is settled within
    blocks, by joins of bounded size, and no cache is played through.
    """
    placed = numbered(access).withColumn("block", F.floor((F.col("pos") - 1) / block))
    line = Window.partitionBy("node", "key").orderBy("pos")
    reads = placed.withColumn("last", F.lag("pos").over(line))
    recent = recent_keys(placed, capacity).select("node", "block", "key", "rank")
    ranked = reads.join(recent, ["node", "block", "key"], "left")
    start = F.col("block") * block
    inside = F.col("last") > start
    possible = F.col("last").isNotNull() & (inside | F.col("rank").isNotNull())
    since = F.when(inside, F.lit(0)).otherwise(F.col("rank"))
    between = F.col("pos") - F.greatest(F.col("last"), start) - 1
    known = ranked.select("node", "block", F.col("pos").alias("at"), F.col("last").alias("from"), since.alias("since"), F.coalesce(possible, F.lit(False)).alias("possible"), (since + between < capacity).alias("sure"))
    open_ = F.col("possible") & ~F.col("sure")
    settled = known.filter(~open_).groupBy("node").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("possible") & F.col("sure")).alias("hits"))
    asked = known.filter(open_).drop("possible", "sure").alias("a")
    others = reads.select("node", "block", "pos", "last").alias("o")
    same = (F.col("a.node") == F.col("o.node")) & (F.col("a.block") == F.col("o.block"))
    first = (F.col("o.pos") > F.col("a.from")) & (F.col("o.pos") < F.col("a.at")) & (F.coalesce("o.last", F.lit(0)) < F.col("a.from"))
    counted = asked.join(others, same & first, "left").groupBy("a.node", "a.at", "a.since").agg(F.count("o.pos").alias("others"))
    more = counted.groupBy("node").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("since") + F.col("others") < capacity).alias("hits"))
    total = settled.unionByName(more).groupBy("node").agg(F.sum("reads").alias("reads"), F.sum("hits").alias("hits"))
    return total.select("node", "reads", "hits", (F.col("reads") - F.col("hits")).alias("misses"))
