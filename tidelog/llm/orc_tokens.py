"""Token ids in ORC files.

Documents are dealt out by ranges of doc_id, sorted, encoded and written as ORC:
integer run-length encoded ids, row indexes, and Bloom filters on doc_id.  A
row also holds its length and the ids before it in its partition, so that any
stripe can be read alone: a document's start is its partition's base plus that.  Files are
numbered by the partitions that wrote them, in doc_id order, and the bases are
sums of lengths over earlier partitions, in however many files each wrote.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.bpe import default_path
from tidelog.llm.common import broadcast_if_small, documents, scratch_path, small_batches, stored, text_of
from tidelog.llm.token_table import TokenTable

END_ID = 1
SCHEMA = "doc_id long, before long, n_tokens int, ids array<int>"
OPTIONS = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}

#: Chunks that the library gets as one text, and chunks kept in a process.
JOINED, CHUNKS_KEPT = 2000, 600_000

_TABLES: dict[str, TokenTable] = {}


def library_table(path: str) -> TokenTable:
    """Ids of chunks between white space, by the tokenizers library.

    The tokenizer drops white space and none of its steps reaches across it, so
    a text's ids are those of its chunks in a row.  Many chunks go to the
    library as one text, with the character NUL as a word between them, whose id
    tells them apart; chunks that hold a NUL go alone.
    """
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()

        def ids_of(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]

        ((cut,),) = ids_of(["\0"])  # one id, or the method doesn't fit this tokenizer

        def encode_many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if any("\0" in w for w in words):
                found = ids_of(words)
                return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((k for x in found for k in x), np.int32)
            runs = [" \0 ".join([*words[k : k + JOINED], ""]) for k in range(0, len(words), JOINED)]
            flat = np.fromiter((k for x in ids_of(runs) for k in x), np.int32)
            cuts = np.flatnonzero(flat == cut)
            assert len(cuts) == len(words)
            return np.diff(cuts, prepend=-1) - 1, flat[flat != cut]

        _TABLES[path] = TokenTable(encode_many, CHUNKS_KEPT)
    return _TABLES[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, before, n_tokens and ids, in doc_id order over the partitions.

    Rows with one doc_id (or none: null comes first) are ordered by a hash of
    the text, so they may be dealt over partitions too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = library_table(path), 0
        for b in batches:
            flat, ends = table.ids(b.column(1))
            ends = ends + np.arange(len(ends))  # an end id more for each document
            ids = np.full(int(ends[-1]), END_ID, np.int32)
            keep = np.ones(len(ids), bool)
            keep[ends[1:] - 1] = False
            ids[keep] = flat
            starts = before + ends[:-1]
            before += int(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), pa.array(np.diff(ends), pa.int32()), lists], ["doc_id", "before", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    own = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, folder: str, path: str | None = None) -> str:
    """Write docs (doc_id, text) below folder, a path of the shared file system."""
    encoded(docs, path or default_path()).write.options(**OPTIONS).orc(folder)
    return folder


def crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            raw = memoryview(rows.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            ends = rows.offsets.to_numpy() * 4
            yield pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return F.arrow_udf(run, "long")(ids)


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids from the files.

    With doc_ids, the filter on doc_id reaches the files: stripes and row groups
    are skipped by their statistics and Bloom filters.  The bases are of the
    lengths column alone.
    """
    small_batches(spark)
    files = spark.read.schema(SCHEMA).orc(folder)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")  # of the partition that wrote the file
    named = files.select("*", number.alias("part"))
    totals = stored(named.groupBy("part").agg(F.sum("n_tokens").alias("total")), "orc-parts")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = stored(totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base")), "orc-bases")
    rows = named.filter(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else named
    found = rows.join(broadcast_if_small(bases, F.lit(16)), "part")
    return found.select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as ORC and read them back.

    A null or empty text has the end id alone; repeated rows are written as
    often; an empty table gives no rows.
    """
    folder = write(documents(spark, sf_dir).select("doc_id", "text"), scratch_path(spark, "orc-tokens"))
    return read(spark, folder).select("doc_id", "start", "n_tokens", crc32(F.col("ids")).alias("ids_crc32"))
