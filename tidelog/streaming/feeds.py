"""Structured Streaming: ingest with last-write-wins state, change feeds, and detectors with keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.model import entry_hash, state_json
from tidelog.operators.detect import HISTORY
from tidelog.operators.lww import latest
from tidelog.operators.merkle import root
from tidelog.sources.views import log_of_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LOG = "key string, value string, physical_time long, logical_counter long, node_id string"
HOUR_MS = 3_600_000

#: Parts of a streamed state; a batch rewrites those that it touches.
STATE_BUCKETS = 32

#: Only where the cluster names no shared folder (local sessions, tests).
LOCAL_FOLDER = "file:///tmp/checkpoints/tidelog"


def stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of log entries."""
    return log_of_events(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def stream_of_log(spark: SparkSession, path: str, schema: str, files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; at most so many new files, or bytes, go into a batch, and none is dropped."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", str(files))
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    return reader.parquet(path)


def paced(writer, every: str | None = None):
    """A query that runs at intervals (such as "5 seconds"), or once over all there is."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def shared(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = LOCAL_FOLDER
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class StreamState:
    """A state in Parquet that batches are merged into, in buckets of keys.

    ``data/v=N/bucket=B`` holds what batch N made of a bucket, ``versions/N``
    the version of every bucket after it, written last; the newest one written
    whole is the state.  A batch that is run again writes the same folders.
    Buckets that neither of the last two versions refers to are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = STATE_BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _numbers(self) -> list[int]:
        store, place = _place(self.spark, f"{self.path}/versions")
        if not store.exists(place):
            return []
        whole = (s.getPath() for s in store.listStatus(place) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return sorted(int(p.getName()) for p in whole)

    def _versions(self, number: int) -> dict[int, int]:
        """bucket -> version, a row for each bucket at most."""
        return {r["bucket"]: r["v"] for r in self.spark.read.schema("bucket int, v long").parquet(f"{self.path}/versions/{number}").collect()}

    def _read(self, at: dict[int, int]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(at.items())])

    def read(self, before: int | None = None) -> DataFrame:
        """The state: the newest, or what batches before a number have left."""
        found = [n for n in self._numbers() if before is None or n < before]
        return self._read(self._versions(found[-1]) if found else {})

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge a batch of log entries into the state."""
        own = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        found = [n for n in self._numbers() if n < number]
        old = self._versions(found[-1]) if found else {}
        winners = latest(batch).persist()
        touched = {r["bucket"] for r in own(winners).select("bucket").distinct().collect()}  # STATE_BUCKETS at most
        had = self._read({b: v for b, v in old.items() if b in touched})
        merged = own(latest(had.unionByName(winners)))
        if touched:
            merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/v={number}")
        winners.unpersist()
        new = old | {b: number for b in touched}
        self.spark.createDataFrame(sorted(new.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{number}")
        for n in found[:-1]:
            gone = self._versions(n)
            for b, v in gone.items():
                if new.get(b) != v and old.get(b) != v:
                    store, place = _place(self.spark, f"{self.path}/data/v={v}/bucket={b}")
                    store.delete(place, True)
            store, place = _place(self.spark, f"{self.path}/versions/{n}")
            store.delete(place, True)


def ingest(log: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Keep the state of a log below path: each batch is merged into it.

    Data of any age is taken, as an older clock loses by itself; no watermark is
    needed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        StreamState(batch.sparkSession, path).merge(batch, number)

    return paced(log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), every).start()


def state_feed(log: DataFrame, path: str, feed: str, checkpoint: str, every: str | None = None):
    """Keep the state of a log, and emit all of it as JSON whenever its root has changed.

    feed/batch=N holds key and register (JSON) of every live or deleted key
    after batch N, with the root.  A state without keys has root 0, like one
    that was never there, so nothing is emitted for it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = StreamState(spark, path)
        was = root(own.read(before=number)).first()["root"]
        own.merge(batch, number)
        state = own.read()
        now = root(state).first()["root"]
        if now != was:
            state.select("key", state_json().alias("register"), F.lit(now).alias("root")).write.mode("overwrite").parquet(f"{feed}/batch={number}")

    return paced(log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), every).start()


BEATS = "node long, n long, last_ms long, mean_ms double"


def detector_stream(beats: DataFrame, history: int = HISTORY) -> DataFrame:
    """BEATS of every node that a batch has beats of (node, ms), by keyed state; beats come in order from batch to batch.

    A node's state is the time of its last beat and its last gaps.
    """

    # a local function, so that workers get it by value and need no package
    def beat_stats(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gaps = state.get if state.exists else (None, [])
        gaps = list(gaps)
        for t in sorted(t for part in parts for t in part["ms"].tolist()):
            if last is not None:
                gaps.append(t - last)
            last = t
        gaps = gaps[-history:]
        state.update((last, gaps))
        yield pd.DataFrame({"node": [key[0]], "n": [len(gaps)], "last_ms": [last], "mean_ms": [sum(gaps) / len(gaps) if gaps else None]})

    return beats.groupBy("node").applyInPandasWithState(beat_stats, BEATS, "last_ms long, gaps array<long>", "update", GroupStateTimeout.NoTimeout)


def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the stream of events leaves: key, value, physical_time, logical_counter, node_id."""
    path = shared(spark, "stream-state")
    ingest(stream_of_events(spark, sf_dir), path, shared(spark, "stream-checkpoint")).awaitTermination()
    return StreamState(spark, path).read()


def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and seq of every write, as a feed writes them."""
    path = shared(spark, "feed")
    feed = stream_of_events(spark, sf_dir).select("key", "seq")
    feed.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared(spark, "feed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, seq long").parquet(path)


def stream_state_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, register and root as the last emission of the feed over the stream of events has them."""
    path, feed = shared(spark, "stream-state"), shared(spark, "state-feed")
    state_feed(stream_of_events(spark, sf_dir), path, feed, shared(spark, "stream-checkpoint")).awaitTermination()
    emitted = spark.read.schema("key string, register string, root long, batch int").parquet(feed)
    newest = emitted.agg(F.max("batch").alias("batch")).first()["batch"]
    return emitted.filter(F.col("batch") == newest).select("key", "register", "root")


def stream_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BEATS of every node (user) after the stream of events."""
    path = shared(spark, "detectors")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    beats = stream_of_events(spark, sf_dir).select(F.substring_index("key", "_", -1).cast("bigint").alias("node"), F.col("physical_time").alias("ms"))
    checkpoint = shared(spark, "stream-checkpoint")
    paced(detector_stream(beats).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)).start().awaitTermination()
    newest = spark.read.schema(f"{BEATS}, batch int").parquet(path).groupBy("node").agg(F.max_by(F.struct("n", "last_ms", "mean_ms"), "batch").alias("x"))
    return newest.select("node", "x.n", "x.last_ms", F.round("x.mean_ms", 6).alias("mean_ms"))


def watch_changes(log: DataFrame) -> DataFrame:
    """hour, root and changed: the state's root hash after every hour with writes, and whether it is a new one.

    A write that wins replaces its key's entry in the root, so the XOR of the
    new and the old entry's hash is what it changes; the roots are running XORs
    over hours.
    """
    order = Window.partitionBy("key").orderBy("physical_time", "logical_counter", "node_id", "value")
    moved = log.select(F.expr(f"physical_time div {HOUR_MS}").alias("hour"), entry_hash().alias("h"), F.coalesce(F.lag(entry_hash()).over(order), F.lit(0)).alias("was"))
    hours = moved.groupBy("hour").agg(F.bit_xor(F.col("h").bitwiseXOR(F.col("was"))).alias("x"))
    until = Window.orderBy("hour")  # a row for each hour
    rooted = hours.select("hour", F.bit_xor("x").over(until).alias("root"))
    return rooted.select("hour", "root", (F.col("root") != F.lag("root", 1, 0).over(until)).alias("changed"))
