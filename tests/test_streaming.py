"""Streams of several batches against batch results."""

import json

from pyspark.sql import functions as F

from tidelog.functions.model import TOMBSTONE
from tidelog.operators import detect, merkle
from tidelog.operators.lww import latest
from tidelog.sources import views
from tidelog.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()))


def parts_of(df, path, n):
    """df in n files that arrive one after the other, by seq."""
    for k in range(n):
        df.filter(F.col("seq") % n == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_state_of_many_batches(spark, small, tmp_path):
    """A file a batch; late writes lose; few versions stay; a batch that is run again changes nothing."""
    log = views.log_events(spark, small)
    path = parts_of(log, f"{tmp_path}/in", 5)
    stream = feeds.stream_of_log(spark, path, "key string, value string, physical_time long, logical_counter long, node_id string, seq long", files=1)
    feeds.ingest(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    own = feeds.StreamState(spark, f"{tmp_path}/state")
    want = rows(latest(log))
    assert rows(own.read()) == want
    assert len(own._numbers()) == 2 and own._numbers()[-1] == 4
    kept = {p.parent.name for p in (tmp_path / "state" / "data").glob("v=*/bucket=*")}
    assert kept <= {"v=3", "v=4"}
    own.merge(log.filter("seq % 5 = 4"), 4)
    assert rows(own.read()) == want


def test_batches_rewrite_touched_buckets_only(spark, tmp_path):
    frame = lambda *rs: spark.createDataFrame([(k, v, t, 0, "n") for k, v, t in rs], feeds.LOG)
    own = feeds.StreamState(spark, str(tmp_path))
    own.merge(frame(*[(f"k{i}", "a", 1) for i in range(200)]), 0)
    own.merge(frame(("k7", "b", 2)), 1)
    assert len(list((tmp_path / "data" / "v=1").glob("bucket=*"))) == 1
    own.merge(frame(), 2)
    assert {r["value"] for r in own.read().filter("key = 'k7'").collect()} == {"b"} and own.read().count() == 200


def test_state_feed_emits_changes(spark, tmp_path):
    """A batch that changes nothing emits nothing, nor does an empty state."""
    write = lambda *rs: spark.createDataFrame([(k, v, t, 0, "n") for k, v, t in rs], feeds.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: feeds.state_feed(feeds.stream_of_log(spark, f"{tmp_path}/in", feeds.LOG, files=1), f"{tmp_path}/state", f"{tmp_path}/feed", f"{tmp_path}/check").awaitTermination()
    for batch in ([("a", "1", 1)], [("a", "0", 0)], [("a", TOMBSTONE, 2), ("b", "x", 1)]):
        write(*batch)
        run()
    emitted = spark.read.schema("key string, register string, root long, batch int").parquet(f"{tmp_path}/feed").collect()
    assert {r["batch"] for r in emitted} == {0, 2}
    last = {r["key"]: json.loads(r["register"])["value"] for r in emitted if r["batch"] == 2}
    assert last == {"a": TOMBSTONE, "b": "x"}
    assert {r["root"] for r in emitted if r["batch"] == 2} == {merkle.root(feeds.StreamState(spark, f"{tmp_path}/state").read()).first()["root"]}


def test_detectors_keep_their_state(spark, tmp_path):
    """Three batches leave what one pass over all beats gives."""
    beats = [(n, 1000 * k * (n + 1) + k % 7, k) for n in range(3) for k in range(150)]
    frame = spark.createDataFrame(beats, "node long, ms long, seq long")
    for k in range(3):
        frame.filter(f"seq div 50 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {}

    def take(batch, number):
        got.update({r["node"]: (r["n"], r["last_ms"], r["mean_ms"]) for r in batch.collect()})

    stream = feeds.stream_of_log(spark, f"{tmp_path}/in", "node long, ms long, seq long", files=1)
    feeds.paced(feeds.detector_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check")).start().awaitTermination()
    want = {r["node"]: (r["n"], r["mean_s"] * 1000) for r in detect.phi(frame.select("node", "ms"), 10**9).collect()}
    assert {n: x[0] for n, x in got.items()} == {n: x[0] for n, x in want.items()}
    assert all(abs(got[n][2] - want[n][1]) < 1e-6 and got[n][1] == max(m for k, m, _ in beats if k == n) for n in got)


def test_periodic_trigger(spark, tmp_path):
    """A query that runs at intervals takes what arrives between them."""
    one = lambda k: spark.createDataFrame([(k, "v", 1, 0, "n")], feeds.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    one("a")
    query = feeds.ingest(feeds.stream_of_log(spark, f"{tmp_path}/in", feeds.LOG, max_bytes=1 << 20), f"{tmp_path}/state", f"{tmp_path}/check", every="1 second")
    try:
        query.processAllAvailable()
        one("b")
        query.processAllAvailable()
        assert {r["key"] for r in feeds.StreamState(spark, f"{tmp_path}/state").read().collect()} == {"a", "b"}
    finally:
        query.stop()
