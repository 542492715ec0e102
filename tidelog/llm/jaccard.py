"""Links between texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates share one of 20 bands of 5 minima (a pair at 0.8 is missed with a
chance of 4 in 10,000), and the exact similarity decides.  A band's members are
numbered and each is first compared with the one before it, which settles most
groups of copies.  Bands whose members are still of several components are then
solved whole, each in a task: the overlaps of all its sets are counted at once
by products of blocks, and a spanning forest of its links is returned, so pairs
are never rows.  Bands of more than LONG_BAND members are paired by their
distance in numbers instead, up to REACH apart, then four times as far and so
on, only members of different components, until no candidate is left: the same
links, with memory that doesn't grow with the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_if_small, lean, small_batches, stored
from tidelog.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
REACH = 32

#: Members of a band that is solved in one task, and shingles of a block there.
LONG_BAND, COLUMNS = 2048, 1024
SEED = 7

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, words as in simhash; of fewer words, of all."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], dtype=np.uint64))


def bands(text: str) -> list[int]:
    """A signed 64-bit key for each band; none without words."""
    own = shingles(text)
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), 2048):  # bounds memory for long texts
        mixed = own[k : k + 2048, None] * FACTORS + OFFSETS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


@lean
def band_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([bands(t.as_py() or "") for t in texts], pa.list_(pa.int64()))


def similar(a: str, b: str) -> bool:
    one, two = shingles(a), shingles(b)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= LEAST * (len(one) + len(two) - both)


@lean
def similar_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for one, two in batches:
        yield pa.array([similar(a, b) for a, b in zip(one.to_pylist(), two.to_pylist())], pa.bool_())


def numbered(own: DataFrame) -> DataFrame:
    """band, i, n and t: the members of each band that has several, numbered from 1, and how many they are."""
    line = Window.partitionBy("band")
    each = own.select("t", F.explode("bands").alias("band"))
    return each.select("band", F.row_number().over(line.orderBy("t")).alias("i"), F.count(F.lit(1)).over(line).alias("n"), "t").filter("n > 1")


def pairs(members: DataFrame, low: int, high: int) -> DataFrame:
    """a and b: members (band, i, t, label) of a band that are low to high apart and have different labels."""
    later = members.filter(F.col("i") > low).select("band", "t", F.col("label").alias("label_b"), "i", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("i") - 1))).alias("k"))
    later = later.select("band", F.col("t").alias("b"), "label_b", (F.col("i") - F.col("k")).alias("i"))
    met = later.join(members.select("band", "i", F.col("t").alias("a"), "label"), ["band", "i"])
    return met.filter("label <> label_b").select("a", "b").distinct()


def verified(some: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, that are similar, by their texts (t, text); texts in no pair aren't shuffled."""
    ends = stored(some.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "pair-ends")
    texts = texts.join(broadcast_if_small(ends, F.lit(8)), "t", "left_semi")
    a = texts.select(F.col("t").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("t").alias("b"), F.col("text").alias("text_b"))
    near: Column = F.arrow_udf(similar_batches, "boolean")("text_a", "text_b")
    return some.join(a, "a").join(b, "b").withColumn("near", near).filter("near").select("a", "b")


@lean
def shingle_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([shingles(t).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))


def band_links(ts: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join those of a band's members which links connect and labels don't."""
    m = len(ts)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]  # shingles of one member overlap with none
    overlap = np.zeros((m, m), np.float32)
    for low in range(0, int((held > 1).sum()), COLUMNS):  # bounds memory
        mine = (column >= low) & (column < low + COLUMNS)
        block = np.zeros((m, COLUMNS), np.float32)
        block[owner[mine], column[mine] - low] = 1
        overlap += block @ block.T
    near = overlap >= LEAST * (sizes[:, None] + sizes[None, :] - overlap)
    own = np.unique(labels, return_inverse=True)[1]
    edges = []
    for i in range(1, m):
        at = np.flatnonzero(near[i, :i] & (own[:i] != own[i]))
        for group in np.unique(own[at]):
            edges.append((int(ts[at[own[at] == group][0]]), int(ts[i])))
        if len(at):
            own[np.isin(own, np.append(np.unique(own[at]), own[i]))] = own[i]
    return edges


@lean
def band_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each band of a partition sorted by band (band, t, label, shingles)."""
    held: list[tuple[int, int, int, np.ndarray]] = []

    def solved() -> pa.RecordBatch:
        edges = band_links(np.array([r[1] for r in held]), np.array([r[2] for r in held]), [r[3] for r in held])
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        flat, ends = batch.column(3).values.to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if held and held[0][0] != row[0]:
                yield solved()
                held.clear()
            held.append((*row, flat[ends[k] : ends[k + 1]].copy()))
    if held:
        yield solved()


def within_bands(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of the bands of rest (band, t, label), by the texts (t, text)."""
    ends = stored(rest.select("t").distinct(), "band-ends")
    used = texts.join(broadcast_if_small(ends, F.lit(8)), "t", "left_semi")
    sets = stored(used.select("t", F.arrow_udf(shingle_batches, "array<long>")("text").alias("shingles")), "band-shingles")
    grouped = rest.select("band", "t", "label").join(sets, "t").select("band", "t", "label", "shingles").repartition("band").sortWithinPartitions("band")
    return grouped.mapInArrow(band_edges, "a long, b long").distinct()


def labels(texts: DataFrame, reach: int = REACH, long_band: int = LONG_BAND) -> DataFrame:
    """node and label (the least t it is linked with) for those of the texts (t, text), distinct and without nulls, that have links."""
    small_batches(texts.sparkSession)
    own = stored(texts.select("t", F.arrow_udf(band_batches, "array<long>")("text").alias("bands")), "bands")
    members = stored(numbered(own), "band-members")
    edges = stored(verified(stored(pairs(members.withColumn("label", F.col("t")), 1, 1), "pairs"), texts), "links")
    label = components(edges)

    def unsettled(some: DataFrame) -> DataFrame:
        """The members of bands that have several components, with their labels."""
        known = label.select(F.col("node").alias("t"), "label")
        named = some.join(known, "t", "left").select("band", "i", "n", "t", F.coalesce("label", "t").alias("label"))
        several = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
        return stored(named.join(several, "band", "left_semi"), "band-members")

    found = stored(within_bands(unsettled(members.filter((F.col("n") > 2) & (F.col("n") <= long_band))), texts), "links")
    low, high = 2, reach
    while True:
        if found.take(1):
            edges = stored(edges.unionByName(found), "links")
            label = components(edges)
        rest = unsettled(members.filter((F.col("n") > long_band) & (F.col("n") > low)))
        if not rest.take(1):
            return label
        found = stored(verified(stored(pairs(rest, low, high), "pairs"), texts), "links")
        low, high = high + 1, 4 * high
