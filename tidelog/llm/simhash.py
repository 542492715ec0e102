"""SimHash near-duplicates by an inverted index on byte positions.

A 64-bit fingerprint is eight bytes.  Fingerprints that differ in at most 4 bits
differ in at most 4 bytes, so they share at least 4 positional bytes: that is
the guaranteed minimum.  The index has a posting list for every position and
byte.  In a list the shared positional bytes of each pair are tallied, pairs
that reach the minimum are retained, and these are verified by their differing
bits.  A pair is taken in the list of its first shared position alone, so the
last three positions need no lists.

Lists grow with the input, and pairs with their square; so a list of more than
LONG_LIST fingerprints is split exactly: as a retained pair shares further
positions, the list is split by each of the next positions' bytes, and the pair
is taken in the list of its first 2 (3, 4) shared positions.  Where all lists
would be longer, the index begins with 2 (3, 4) positions at once.  In a list of
4 positions that is still long every pair has the minimum; 32 bits are open
there, and two fingerprints differ in at most 4 of them if and only if they
share a neighbour within 2 bits; so each emits its 529 neighbours, and members
of a neighbour's group are linked to its least member.

Pairs aren't written out: a list gives the edges of a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.common import discard, documents, join_side, small_batches, stored, text_of

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
SHARED_BYTES = BYTES - MOST_BITS
LONG_LIST = 2048

#: Rows of a block of pairs that are tallied at once.
BLOCK = 64


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, white space \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):  # bounds memory for long texts
        part = np.array(hashes[k : k + 4096], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprints as signed 64-bit integers."""
    for texts in batches:
        out = np.fromiter((fingerprint(t.as_py() or "") for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.array(out.view(np.int64))


def fingerprints(text: Column) -> Column:
    return F.arrow_udf(fingerprint_batches, "long")(text)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def positions_of(which: int) -> list[int]:
    """The positions of a list, which names them by bits."""
    return [p for p in range(BYTES) if which >> p & 1]


def first_positions(depth: int) -> list[int]:
    """Every choice of positions, as bits, that can be the first `depth` of SHARED_BYTES shared ones."""
    last = MOST_BITS + depth  # of the positions after the last one, enough must be left
    return [sum(1 << p for p in choice) for choice in combinations(range(last), depth)]


def mask_of(which: int) -> int:
    return signed(sum(0xFF << (8 * p) for p in positions_of(which)))


def postings(fps: DataFrame, depth: int = 1) -> DataFrame:
    """fp -> a row for each of its lists: which (positions), key (their bytes) and fp."""
    pairs = [[w, mask_of(w)] for w in first_positions(depth)]
    choice = F.explode(F.from_json(F.lit(str(pairs)), "array<array<bigint>>")).alias("x")
    return fps.select("fp", choice).select(F.col("x")[0].cast("short").alias("which"), F.col("fp").bitwiseAND(F.col("x")[1]).alias("key"), "fp")


def split_further(lists: DataFrame, depth: int) -> DataFrame:
    """The rows of lists of `depth` positions, one for each next position."""
    onward = []  # by which: pairs of the longer choice and its mask
    for which in range(1 << BYTES):
        grown = [which | 1 << p for p in range(which.bit_length(), MOST_BITS + depth + 1)] if bin(which).count("1") == depth else []
        onward.append([[w, mask_of(w)] for w in grown])
    table = F.from_json(F.lit(str(onward)), "array<array<array<bigint>>>")
    longer = lists.select("fp", F.explode_outer(F.element_at(table, F.col("which").cast("int") + 1)).alias("x"))
    return longer.select(F.col("x")[0].cast("short").alias("which"), F.col("fp").bitwiseAND(F.col("x")[1]).alias("key"), "fp")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes are zero in each of the differences x."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return BYTES - np.bitwise_count(y & np.uint64(0x0101010101010101))


def retained(fps: np.ndarray, which: int) -> Iterator[tuple[int, np.ndarray]]:
    """i and the later j of the pairs of a list that reach the minimum of shared bytes and have it as their first list."""
    positions = positions_of(which)
    before = [np.uint64(0xFF << (8 * p)) for p in range(positions[-1]) if p not in positions]
    for k in range(0, len(fps) - 1, BLOCK):
        x = fps[k : k + BLOCK, None] ^ fps[None, k + 1 :]
        met = shared_bytes(x) >= SHARED_BYTES
        rows, columns = np.nonzero(met)
        fits = columns >= rows  # column c is fingerprint k + 1 + c
        for mask in before:  # sharing an earlier position, the pair is another list's
            fits &= x[rows, columns] & mask != 0
        rows, columns = rows[fits], columns[fits]
        for i in np.unique(rows):
            yield k + int(i), k + 1 + columns[rows == i]


def spanning(fps: np.ndarray, which: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within one list (sorted, distinct fingerprints)."""
    label = np.arange(len(fps))
    for i, later in retained(fps, which):
        linked = label[later[np.bitwise_count(fps[later] ^ fps[i]) <= MOST_BITS]]
        if len(linked) and (linked != label[i]).any():
            group = np.unique(np.append(linked, label[i]))
            label[np.isin(label, group)] = group[0]
    return [(int(fps[label[k]]), int(fps[k])) for k in range(len(fps)) if label[k] != k]


def list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the posting lists of a partition sorted by which, key, fp; lists aren't longer than LONG_LIST."""
    held = np.empty((0,), dtype=[("which", "i2"), ("key", "i8"), ("fp", "i8")])

    def solve(rows: np.ndarray) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        new = (rows["which"][1:] != rows["which"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(rows)]))
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            part = rows[cuts[k] : cuts[k + 1]]
            out += spanning(np.ascontiguousarray(part["fp"]).view(np.uint64), int(part["which"][0]))
        return out

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(edges, dtype=np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, c]).view(np.int64)) for c in (0, 1)], ["a", "b"])

    for b in batches:
        rows = np.empty(b.num_rows, dtype=held.dtype)
        for name in held.dtype.names:
            rows[name] = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        last = (rows["which"] == rows["which"][-1]) & (rows["key"] == rows["key"][-1])
        cut = int(np.argmax(last)) if last.any() else len(rows)
        held = rows[cut:]
        if edges := solve(rows[:cut]):
            yield batch(edges)
    if edges := solve(held):
        yield batch(edges)


def neighbours(which: Column, fp: Column) -> Column:
    """The fingerprints within 2 bits of fp in the bytes that a list of 4 positions leaves open."""
    every = []
    for w in range(1 << BYTES):
        bits = [8 * p + k for p in range(BYTES) if not w >> p & 1 for k in range(8)] if bin(w).count("1") == SHARED_BYTES else []
        flips = [0, *(1 << b for b in bits), *((1 << b) | (1 << c) for b, c in combinations(bits, 2))] if bits else []
        every.append([signed(f) for f in flips])
    flips = F.element_at(F.from_json(F.lit(str(every)), "array<array<bigint>>"), which.cast("int") + 1)
    return F.transform(flips, lambda f: fp.bitwiseXOR(f))


def neighbour_edges(lists: DataFrame) -> DataFrame:
    """Edges of the long lists of 4 positions: members of a neighbour's group with its least member."""
    shared = lists.select("which", "fp", F.explode_outer(neighbours(F.col("which"), F.col("fp"))).alias("near"))
    # the list's key is part of the neighbour: groups of one choice and neighbour are of one list
    least = shared.groupBy("which", "near").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a <> top").drop("top")
    return shared.join(least, ["which", "near"]).filter("a <> fp").select("a", F.col("fp").alias("b"))


def link_edges(fps: DataFrame, long_list: int = LONG_LIST, paths: list[str] | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints fps(fp), a written table.

    The lengths of lists are counted with map-side combine, so a list that takes
    a large part of all fingerprints is never one task's.
    """
    depth, many = 1, fps.count()
    while depth < SHARED_BYTES and many > long_list * 256**depth:
        depth += 1
    index, parts = stored(postings(fps, depth), "byte-index", paths), []
    while True:
        long = stored(index.groupBy("which", "key").count().filter(F.col("count") > long_list).select("which", "key"), "long-lists", paths)
        any_long = bool(long.take(1))
        short = index.join(long, ["which", "key"], "left_anti") if any_long else index
        parts.append(short.repartition("which", "key").sortWithinPartitions("which", "key", "fp").mapInArrow(list_edges, "a long, b long"))
        if not any_long:
            break
        rest = index.join(long, ["which", "key"], "left_semi")
        if depth == SHARED_BYTES:
            parts.append(neighbour_edges(rest))
            break
        index = stored(split_further(rest, depth), "byte-index", paths)
        depth += 1
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.distinct()


def link(docs: DataFrame, long_list: int = LONG_LIST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, label and component_id of every row of docs (doc_id, text), with the columns in carry.

    label is the component's least fingerprint, component_id the least doc_id
    that links reach.  A null text counts as empty: fingerprint zero, linked as
    any other.  Repeated rows come back as often; rows with a null doc_id get the
    least id of their component, or null if it has none.  An empty table gives
    no rows.  Equal fingerprints meet once in the index, so copies cost nothing
    there.
    """
    small_batches(docs.sparkSession)
    own = stored(docs.select("doc_id", *carry, fingerprints(text_of()).alias("fp")), "fingerprints")
    least = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    paths: list[str] = []
    edges = stored(link_edges(least.select("fp"), long_list, paths), "links")
    discard(docs.sparkSession, paths)
    labels = components(edges)  # node, label: only fingerprints that have links
    named = least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = stored(named.join(component, "label").select("fp", "label", "component_id"), "named-fingerprints")
    # a fingerprint may be that of a third of all rows
    return join_side(own, whole, ["fp"], F.lit(24)).select("doc_id", *carry, "fp", "label", "component_id")


def op3_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    linked = link(documents(spark, sf_dir).select("doc_id", "text"))
    return linked.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
