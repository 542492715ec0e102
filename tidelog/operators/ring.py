"""Placement on a consistent-hash ring.

The ring's points are few (nodes times virtual nodes), so what lies clockwise of
every point is worked out once for the points: the sorted ring is walked from
each point until enough different nodes are met.  A key then needs its successor
point only, found by an equality on a hash prefix and a range within it; keys
are never crossed with nodes, nor points with nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.model import RING, hash60

VNODES, REPLICAS = 256, 3
HEADROOM, LEAST_CAPACITY = 1.25, 5
LEAST_BITS, MOST_BITS = 8, 24

#: Rings of more points aren't broadcast.
BROADCAST_POINTS = 1 << 20


def points(peers: DataFrame, vnodes: int | None = VNODES) -> DataFrame:
    """node_id and point of every (virtual) node; of nodes on one point the greatest name holds it."""
    if vnodes is None:
        named = peers.select("node_id", F.col("node_id").alias("name"))
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1)))
        named = peers.select("node_id", every.alias("v")).select("node_id", F.concat("node_id", F.lit("#"), F.col("v").cast("string")).alias("name"))
    return named.select("node_id", hash60(F.col("name")).alias("point")).groupBy("point").agg(F.max("node_id").alias("node_id"))


def ring_table(peers: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """node_id, how many points it has, and the least and greatest."""
    p = points(peers, vnodes)
    return p.groupBy("node_id").agg(F.count(F.lit(1)).alias("vnodes"), F.min("point").alias("min_hash"), F.max("point").alias("max_hash"))


def ahead(ring: DataFrame, reach: int, full: bool = False) -> DataFrame:
    """point, free and rest: the different nodes on the `reach` points from each point on, in ring order; rest are those marked full.

    The sorted ring, metadata, is one window; its first points follow its last.
    """
    marked = ring if full else ring.withColumn("full", F.lit(False))
    again = marked.withColumn("at", F.col("point") + F.lit(RING))
    line = marked.withColumn("at", F.col("point")).unionByName(again)
    on = Window.orderBy("at").rowsBetween(0, reach - 1)
    met = lambda taken: F.array_distinct(F.collect_list(F.when(taken, F.col("node_id"))).over(on))
    return line.select("point", "at", met(~F.col("full")).alias("free"), met(F.col("full")).alias("rest")).filter(F.col("at") < RING).drop("at")


def clockwise(ring: DataFrame, n: int, n_points: int, full: bool = False) -> DataFrame:
    """point and nodes: the first n different nodes clockwise of each point (all, if there are fewer), those marked full last.

    The walk's reach is doubled until every point has met enough nodes.
    """
    marked = ring if full else ring.withColumn("full", F.lit(False))
    counts = marked.agg(F.count_distinct(F.when(~F.col("full"), F.col("node_id"))).alias("free"), F.count_distinct("node_id").alias("every")).first()
    free, rest = min(n, counts["free"]), max(0, min(n, counts["every"]) - counts["free"])
    reach = 8 * n
    while True:
        met = ahead(ring, min(reach, n_points), full).withColumns({"free": F.slice("free", 1, n), "rest": F.slice("rest", 1, n)})
        if reach >= n_points or not met.filter((F.size("free") < free) | (F.size("rest") < rest)).take(1):
            return met.select("point", F.slice(F.concat("free", "rest"), 1, n).alias("nodes"))
        reach *= 2


def arcs(ring: DataFrame, bits: int) -> DataFrame:
    """prefix, low, high, point: keys with low < hash <= high belong to point; a row for each prefix that an arc meets."""
    width = RING >> bits
    order = Window.orderBy("point")  # metadata: the ring's points
    whole = ring.select("point", F.lag("point").over(order).alias("before"), F.max("point").over(Window.partitionBy()).alias("last"))
    inner = whole.select("point", F.coalesce("before", F.lit(-1).cast("bigint")).alias("low"), F.col("point").alias("high"))
    wrap = whole.filter("before IS NULL").select("point", F.col("last").alias("low"), F.lit(RING).cast("bigint").alias("high"))
    both = inner.unionByName(wrap)
    prefixes = F.sequence(F.expr(f"(low + 1) div {width}"), F.expr(f"least(high, {RING - 1}) div {width}"))
    return both.filter(f"low < {RING - 1}").select(F.explode(prefixes).alias("prefix"), "low", "high", "point")


def place(keys: DataFrame, ring: DataFrame, ranked: DataFrame, n_points: int) -> DataFrame:
    """key, rank, node_id for ranked (point, nodes); as many prefixes as points, so a key has about one arc to test."""
    bits = min(MOST_BITS, max(LEAST_BITS, n_points.bit_length()))
    at = arcs(ring, bits).join(ranked, "point").select("prefix", "low", "high", "nodes")
    side = F.broadcast(at) if n_points <= BROADCAST_POINTS else at
    hashed = keys.select("key", hash60(F.col("key")).alias("h")).withColumn("prefix", F.expr(f"h div {RING >> bits}"))
    found = hashed.join(side, (hashed.prefix == at.prefix) & (F.col("h") > F.col("low")) & (F.col("h") <= F.col("high")))
    return found.select("key", F.posexplode("nodes").alias("pos", "node_id")).select("key", (F.col("pos") + 1).cast("bigint").alias("rank"), "node_id")


def replicas(keys: DataFrame, peers: DataFrame, n: int = REPLICAS, vnodes: int | None = VNODES) -> DataFrame:
    """key, rank, node_id: the first n different nodes clockwise of each key's hash.

    keys has one row for each key.  The nodes are metadata.  With n nodes or
    fewer every key is on all of them, in ring order for vnodes None and in
    name order otherwise.
    """
    peers = metadata(peers)
    n_peers = peers.count()
    if vnodes is not None and n_peers <= n:
        named = peers.select(F.row_number().over(Window.orderBy("node_id")).cast("bigint").alias("rank"), "node_id")
        return keys.select("key").join(F.broadcast(named), how="cross")  # n nodes
    n_points = n_peers * (vnodes or 1)
    ring = metadata(points(peers, vnodes)) if n_points <= BROADCAST_POINTS else points(peers, vnodes)
    return place(keys, ring, clockwise(ring, n, n_points), n_points)


def capacity(loads: DataFrame) -> DataFrame:
    """avg_load and capacity of nodes (node_id, load)."""
    mean = F.ceil(F.sum("load") / F.count(F.lit(1)))
    return loads.agg(mean.cast("bigint").alias("avg_load"), F.greatest(F.ceil(F.lit(HEADROOM) * mean), F.lit(LEAST_CAPACITY)).cast("bigint").alias("capacity"))


def metadata(nodes: DataFrame) -> DataFrame:
    """A table with a row for each node, as a local one: what made it runs once, however often it is read."""
    return nodes.sparkSession.createDataFrame(nodes.collect(), nodes.schema)


def bounded(keys: DataFrame, loads: DataFrame, n: int = REPLICAS) -> DataFrame:
    """key, rank, node_id: as replicas without virtual nodes, but nodes at their capacity come last."""
    loads = metadata(loads)
    n_points = loads.count()
    full = loads.join(F.broadcast(capacity(loads)), how="cross").select("node_id", (F.col("load") >= F.col("capacity")).alias("full"))  # one row
    ring = metadata(points(loads, None).join(F.broadcast(full), "node_id"))
    return place(keys, ring, clockwise(ring, n, n_points, full=True), n_points)
