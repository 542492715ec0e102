"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots.  Rows and bytes are aggregated per
slot, and a versioned slot-to-shard map says where each slot lives.  Version 0
deals the slots out evenly; a rebalancing edits the newest version by moving
few whole slots and stores the result under the next number, so it never
rehashes a record.  The map has N_SLOTS rows at any size of the input; it and
the slots' totals are the only things the driver sees.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import documents, scratch_path, text_of

N_SLOTS = 16384
N_SHARDS = 40
RECORD_OVERHEAD = 16

#: A map is edited until no shard is further from another than this share of the mean, or no slot's move helps.
SPREAD = 0.001

MAP = "virtual_slot int, shard int"


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """docs with size, text_crc32 and virtual_slot.

    The slot is decided by doc_id and text, so that neither rows without an id
    nor those that repeat one share a slot, unless they are equal.  A null text
    has size 16 and the crc of no bytes.
    """
    text = text_of()
    key = F.xxhash64("doc_id", text)
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + RECORD_OVERHEAD).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "virtual_slot": F.pmod(key, F.lit(n_slots)).cast("int"),
        }
    )


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot: at most N_SLOTS rows, combined map-side."""
    return slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def even_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: the slots dealt out in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def best_transfer(full: list[tuple[int, int]], least: list[tuple[int, int]], gap: int, gain: float) -> tuple[tuple[int, int], tuple[int, int] | None] | None:
    """The slot to move from full to least (both sorted by bytes), with one to move back or none, that halves the gap best.

    What moves in all must be at least `gain` away from 0 and from the gap, so
    that each transfer brings the two nearer to each other by as much.
    """
    best, score = None, None
    for back in [None, *least]:
        want = gap / 2 + (back[0] if back else 0)
        k = bisect_left(full, (want, -1))
        for out in full[max(k - 1, 0) : k + 1]:
            moved = out[0] - (back[0] if back else 0)
            if gain <= moved <= gap - gain and (score is None or abs(moved - gap / 2) < score):
                best, score = (out, back), abs(moved - gap / 2)
        if score is not None and score <= gap / 8:
            break
    return best


def edited(shard_of: list[int], slot_bytes: list[int], n_shards: int, spread: float = SPREAD) -> list[int]:
    """An edit of a map that makes the shards' bytes near equal by moving few slots.

    Time and again the fullest shard gives a slot to the emptiest, or trades
    one, until they are within the spread of the mean; a shard that can't give
    any is left out.  Slots of shards that are no more go to the emptiest.
    Empty slots don't move otherwise.
    """
    out = list(shard_of)
    near = max(1.0, spread * sum(slot_bytes) / n_shards)
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    filled = [0] * n_shards
    for slot, shard in enumerate(out):
        if shard < n_shards and slot_bytes[slot]:
            own[shard].append((slot_bytes[slot], slot))
            filled[shard] += slot_bytes[slot]
    for slots in own:
        slots.sort()

    def give(source: int, target: int, x: tuple[int, int]) -> None:
        del own[source][bisect_left(own[source], x)]
        insort(own[target], x)
        out[x[1]] = target
        filled[source] -= x[0]
        filled[target] += x[0]

    for slot in sorted((s for s, shard in enumerate(out) if shard >= n_shards), key=lambda s: (-slot_bytes[s], s)):
        shard = min(range(n_shards), key=filled.__getitem__)
        out[slot] = shard
        if slot_bytes[slot]:
            insort(own[shard], (slot_bytes[slot], slot))
            filled[shard] += slot_bytes[slot]
    moved = True
    while moved:
        moved, able = False, list(range(n_shards))
        while len(able) > 1:
            full, least = max(able, key=filled.__getitem__), min(able, key=filled.__getitem__)
            gap = filled[full] - filled[least]
            if gap <= near:
                break
            transfer = best_transfer(own[full], own[least], gap, near / 4)
            if transfer is None:
                able.remove(full)
                continue
            give(full, least, transfer[0])
            if transfer[1]:
                give(least, full, transfer[1])
            moved = True
    return out


def literal_frame(spark: SparkSession, schema: str, *columns: list[int]) -> DataFrame:
    """Columns of integers, a row for each virtual slot, as a table without files; schema names the slot and the columns."""
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    literal = lambda xs, kind: F.from_json(F.lit(str(list(xs))), f"array<{kind}>")
    zipped = F.arrays_zip(*[literal(xs, kind).alias(name) for xs, name, kind in zip(columns, names[1:], kinds[1:])])
    return spark.range(1).select(F.posexplode(zipped).alias(names[0], "x")).select(names[0], *[F.col(f"x.{n}").alias(n) for n in names[1:]])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the stored versions of a map."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    whole = (s.getPath() for s in store.listStatus(place) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return sorted(int(p.getName().removeprefix("version=")) for p in whole if p.getName().startswith("version="))


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Write a version; an error if there is one of that number, as of another edit at the same time."""
    literal_frame(spark, MAP, shard_of).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The shard of each virtual slot by a stored version, the newest unless one is named."""
    version = max(versions(spark, path)) if version is None else version
    return [r["shard"] for r in spark.read.schema(MAP).parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()]


def rebalance(spark: SparkSession, path: str, slot_bytes: list[int], n_shards: int) -> list[int]:
    """Edit the newest map below path (version 0 is made if there is none); an edit that moves slots becomes the next version."""
    known = versions(spark, path)
    if not known:
        store_map(spark, path, 0, even_map(len(slot_bytes), n_shards))
        known = [0]
    old = load_map(spark, path, known[-1])
    if len(old) != len(slot_bytes):
        raise ValueError(f"the map has {len(old)} slots, not {len(slot_bytes)}")
    new = edited(old, slot_bytes, n_shards)
    if new != old:
        store_map(spark, path, known[-1] + 1, new)
    return new


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, virtual_slot, shard and slot.

    map_path: where the map is kept; its newest version is edited.  A new map
    is made if it is None.  The law is ``bytes``: after the edit the shards'
    sizes are near equal, as far as whole slots allow.  slot numbers a shard's
    rows from 0 without gaps: rows of its earlier virtual slots, then the order
    of doc_id, crc and size within the virtual slot, so the numbering takes one
    sort per virtual slot and none per shard.  Repeated rows each get a number
    of their own; a null text is an empty one; an empty table gives no rows.
    Extra columns of docs stay, but for those with the names added here, which
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "text_crc32", "virtual_slot", "shard", "slot", "base")
    slotted = with_slots(docs, n_slots)
    rows, size = [0] * n_slots, [0] * n_slots
    for r in slot_totals(slotted.select("size", "virtual_slot")).collect():  # n_slots rows at most, at any size
        rows[r["virtual_slot"]], size[r["virtual_slot"]] = r["rows"], r["bytes"]
    shard_of = rebalance(spark, map_path or scratch_path(spark, "slot-map"), size, n_shards)
    ahead, base = [0] * n_shards, []
    for slot, own in enumerate(shard_of):
        base.append(ahead[own])
        ahead[own] += rows[slot]
    where = literal_frame(spark, f"{MAP}, base bigint", shard_of, base)
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(where), "virtual_slot")  # n_slots rows
        .withColumn("slot", F.col("base") + F.col("at"))
        .drop("base", "at")
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes`` over 40 shards, by a stored map of 16,384 virtual slots."""
    return shard(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
