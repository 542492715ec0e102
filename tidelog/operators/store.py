"""A node's log-structured store: sorted tables with their filters, and the write-ahead log, below one shared folder.

* ``tables/node_id=N/sst_id=I``: Parquet, ranged and sorted by key;
* ``filters/node_id=N/sst_id=I``: the set bits of the table's Bloom filter;
* ``wal/node_id=N/v=V``: the log's versions; the newest whole one counts.

A table counts once its filter is written, which is last.  Nodes are told apart
by equality of the partition's value, so one name may begin with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.model import LOG_COLUMNS
from tidelog.operators.lsm import COMPACT_BITS, COMPACT_FILES, FLUSH_BITS, FLUSH_KEYS, OPTIONS, bloom_build, compact, probes, read_tables, write_tables
from tidelog.operators.lww import latest

LOG = "key string, value string, physical_time long, logical_counter long, node_id string"


class Store:
    """The store of one node.  One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, node: str):
        self.spark, self.node = spark, node
        self.tables, self.filters, self.wal = (f"{folder.rstrip('/')}/{part}/node_id={node}" for part in ("tables", "filters", "wal"))

    def _path(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _remove(self, path: str) -> None:
        store, place = self._path(path)
        store.delete(place, True)

    def _numbers(self, path: str, name: str) -> list[int]:
        """The values of the partitions below path that are written whole."""
        store, place = self._path(path)
        if not store.exists(place):
            return []
        found = [s.getPath() for s in store.listStatus(place) if s.getPath().getName().startswith(f"{name}=")]
        whole = [p for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix(f"{name}=")) for p in whole)

    def table_ids(self) -> list[int]:
        return self._numbers(self.filters, "sst_id")

    def read(self, ids: list[int] | None = None) -> DataFrame:
        """The entries of the node's tables, or of some, with sst_id."""
        ids = self.table_ids() if ids is None else ids
        schema = f"{LOG}, sst_id long"
        if not ids:
            return self.spark.createDataFrame([], schema)
        files = self.spark.read.schema(schema).option("basePath", self.tables)
        return files.parquet(*[f"{self.tables}/sst_id={i}" for i in ids])

    def read_filters(self) -> DataFrame:
        """sst_id and bit of the tables' filters."""
        ids = self.table_ids()
        if not ids:
            return self.spark.createDataFrame([], "sst_id long, bit long")
        files = self.spark.read.schema("bit long, sst_id long").option("basePath", self.filters)
        return files.parquet(*[f"{self.filters}/sst_id={i}" for i in ids]).select("sst_id", "bit")

    def _write(self, entries: DataFrame, sst_id: int, bits: int) -> None:
        entries.select(*LOG_COLUMNS).repartitionByRange("key").sortWithinPartitions("key").write.options(**OPTIONS).mode("overwrite").parquet(f"{self.tables}/sst_id={sst_id}")
        set_bits = self.read([sst_id]).select(F.explode(probes(F.col("key"), bits)).alias("bit")).distinct()
        set_bits.coalesce(1).write.mode("overwrite").parquet(f"{self.filters}/sst_id={sst_id}")  # `bits` rows at most

    def add(self, entries: DataFrame) -> None:
        """Write many sorted tables at once (the log's columns and sst_id), as they come from flush."""
        write_tables(entries.select(*LOG_COLUMNS, "sst_id"), self.tables)
        bloom_build(read_tables(self.spark, self.tables)).repartition("sst_id").write.partitionBy("sst_id").mode("overwrite").parquet(self.filters)
        store, place = self._path(self.filters)
        for s in store.listStatus(place):  # a folder for each table
            if s.getPath().getName().startswith("sst_id="):
                store.create(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")).close()

    def flush(self, memory: DataFrame, sst_id: int) -> DataFrame:
        """Write a memory table that has enough keys as a sorted table; returns what stays in memory: nothing, or all of it."""
        state = latest(memory)
        if len(state.limit(FLUSH_KEYS).collect()) < FLUSH_KEYS:
            return memory
        self._write(state, sst_id, FLUSH_BITS)
        return memory.limit(0)

    def compact(self, sst_id: int, gc_grace_ms: int = 0, now_ms: int | None = None) -> bool:
        """Merge the node's tables into one without deletions, where there are enough of them, and remove them; whether it did."""
        inputs = self.table_ids()
        if len(inputs) < COMPACT_FILES:
            return False
        if sst_id in inputs:
            raise ValueError(f"table {sst_id} is an input")
        self._write(compact(self.read(inputs), gc_grace_ms, now_ms), sst_id, COMPACT_BITS)
        for i in inputs:  # a table without its filter doesn't count
            self._remove(f"{self.filters}/sst_id={i}")
            self._remove(f"{self.tables}/sst_id={i}")
        return True

    def _version(self) -> int:
        return max(self._numbers(self.wal, "v"), default=0)

    def append(self, entries: DataFrame) -> None:
        """Append entries to the write-ahead log."""
        entries.select(*LOG_COLUMNS).write.mode("append").parquet(f"{self.wal}/v={self._version()}")

    def log(self) -> DataFrame:
        """The entries of the write-ahead log."""
        found = self._numbers(self.wal, "v")
        return self.spark.read.schema(LOG).parquet(f"{self.wal}/v={found[-1]}") if found else self.spark.createDataFrame([], LOG)

    def rewrite_log(self) -> None:
        """Replace the write-ahead log by its winners: a new version is written whole, then the older ones go."""
        found = self._numbers(self.wal, "v")
        if not found:
            return
        latest(self.log()).write.mode("overwrite").parquet(f"{self.wal}/v={found[-1] + 1}")
        for v in found:
            self._remove(f"{self.wal}/v={v}")
