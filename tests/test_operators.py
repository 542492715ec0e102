"""Operators on small written cases."""

import json
import math
import random
import time
from collections import OrderedDict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tidelog.functions.model import TOMBSTONE, now_ms, state_json
from tidelog.operators import clock, detect, lsm, lww, merkle, quorum, ring
from tidelog.operators.store import Store

LOG = "key string, value string, physical_time long, logical_counter long, node_id string"


@pytest.fixture
def log(spark):
    return lambda rows: spark.createDataFrame([(k, v, t, c, n) for k, v, t, c, n in rows], LOG)


@pytest.fixture
def peers(spark):
    return lambda names, down=(): spark.createDataFrame([(n, n not in down) for n in names], "node_id string, alive boolean")


FIVE = ["node_A", "node_B", "node_C", "node_D", "node_E"]


def state(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_newer_write_wins(log):
    got = lww.merge(log([("task_status", "pending", 100, 0, "node_A")]), log([("task_status", "completed", 105, 0, "node_B")])).collect()
    assert [(r["value"], r["physical_time"], r["node_id"]) for r in got] == [("completed", 105, "node_B")]
    assert state(lww.latest(log([("config", "v2", 200, 0, "node_A"), ("config", "v1", 150, 0, "node_B")]))) == {"config": "v2"}


def test_clock_order_and_ties(log):
    rows = [("k", "a", 1, 0, "n2"), ("k", "b", 1, 1, "n1"), ("k", "c", 1, 1, "n2"), ("k", "d", 0, 9, "n9"), ("k", "e", 1, 1, "n2")]
    assert state(lww.latest(log(rows))) == {"k": "e"}
    assert [r["value"] for r in lww.hlc_order(log(rows)).orderBy("pos").collect()] == ["d", "a", "b", "c", "e"]


def test_merge_is_commutative_associative_idempotent(log):
    rnd = random.Random(4)
    a, b, c = (log([(f"k{rnd.randrange(6)}", f"v{rnd.randrange(4)}", rnd.randrange(5), rnd.randrange(2), f"n{rnd.randrange(3)}") for _ in range(20)]) for _ in range(3))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lww.merge(a, b)) == rows(lww.merge(b, a))
    assert rows(lww.merge(lww.merge(a, b), c)) == rows(lww.merge(a, lww.merge(b, c)))
    assert rows(lww.merge(a, a)) == rows(lww.latest(a))


COMPACTION = [("key1", "old_val", 100, 0, "node1"), ("key1", "new_val", 200, 0, "node1"), ("key2", "keep_me", 100, 0, "node1"), ("key3", "data", 100, 0, "node1"), ("key3", TOMBSTONE, 300, 0, "node1")]


def test_compaction_drops_deletions_after_the_merge(log):
    assert state(lsm.compact(log(COMPACTION))) == {"key1": "new_val", "key2": "keep_me"}
    assert state(lsm.compact(log(COMPACTION), gc_grace_ms=50, now_ms=320)) == {"key1": "new_val", "key2": "keep_me", "key3": TOMBSTONE}
    assert state(lww.state_scan(log(COMPACTION[:2]), log(COMPACTION[2:]))) == {"key1": "new_val", "key2": "keep_me"}


def test_point_get(log):
    got = {r["key"]: (r["status"], r["value"]) for r in lww.point_get(log(COMPACTION), ["key1", "key3", "key9"]).collect()}
    assert got == {"key1": ("found", "new_val"), "key3": ("deleted", None), "key9": ("not_found", None)}


def test_digest_comparison(log):
    local = log([("key_A", "x", 100, 0, "n"), ("key_B", "x", 200, 0, "n"), ("key_C", "x", 300, 0, "n")])
    remote = log([("key_A", "y", 100, 0, "n"), ("key_B", "y", 250, 0, "n"), ("key_C", "y", 290, 0, "n"), ("key_D", "y", 400, 0, "n")])
    assert {r["key"] for r in merkle.pull(local, remote).collect()} == {"key_B", "key_D"}
    assert {r["key"] for r in merkle.push(local, remote).collect()} == {"key_C"}
    both = lww.merge(local, remote).select("key", "physical_time")
    assert sorted(map(tuple, merkle.repaired(local, remote).select("key", "physical_time").collect())) == sorted(map(tuple, both.collect()))


def test_merkle_summaries(log):
    one = [("key_A", "value1", 100, 0, "node_1")]
    a, b = log(one), log([*one, ("key_B", "value2", 200, 0, "node_1")])
    assert merkle.root(a).first()["root"] != merkle.root(b).first()["root"]
    assert merkle.diff(a, b).count() == 1 and merkle.diff(a, a).count() == 0
    assert merkle.root(log([])).first()["root"] == 0


def test_ring(spark, peers):
    keys = spark.createDataFrame([(f"user_profile_{k}",) for k in range(300)], "key string")
    got = ring.replicas(keys, peers(FIVE)).collect()
    of = {}
    for r in got:
        of.setdefault(r["key"], {})[r["rank"]] = r["node_id"]
    assert len(of) == 300 and all(sorted(x) == [1, 2, 3] and len(set(x.values())) == 3 for x in of.values())
    assert {tuple(r) for r in ring.replicas(keys, peers(FIVE)).collect()} == {tuple(r) for r in got}
    first = [x[1] for x in of.values()]
    assert all(25 < first.count(n) < 110 for n in FIVE)
    gone = {(r["key"], r["rank"]): r["node_id"] for r in ring.replicas(keys, peers(FIVE[:4])).collect()}
    assert all(gone[k, 1] == x[1] for k, x in of.items() if x[1] != "node_E")
    few = ring.replicas(keys, peers(["b", "a"])).collect()
    assert len(few) == 600 and all(r["node_id"] == "ab"[r["rank"] - 1] for r in few)
    alone = ring.replicas(keys, peers(["node_1"]), vnodes=None).collect()
    assert len(alone) == 300 and {r["rank"] for r in alone} == {1}


def test_bounded_loads(spark):
    loads = spark.createDataFrame([("node_A", 100), ("node_B", 100), ("node_C", 0)], "node_id string, load long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert ring.capacity(loads).first().asDict() == {"avg_load": 67, "capacity": 84}
    assert {(r["node_id"], r["rank"]) for r in ring.bounded(keys, loads, 1).collect()} == {("node_C", 1)}
    assert ring.bounded(keys, loads, 3).count() == 9


def test_quorum_and_hints(spark, peers):
    placed = spark.createDataFrame([("chaos_key", k, n) for k, n in enumerate(["node_local", "node_dead", "node_alive"], 1)], "key string, rank long, node_id string")
    nodes = peers(["node_local", "node_dead", "node_alive"], ["node_dead"])
    assert quorum.acks(placed, nodes).first().asDict() == {"key": "chaos_key", "replicas": 3, "acks": 2, "required": 2, "status": "success"}
    writes = spark.createDataFrame([("chaos_key", "v", 7)], "key string, value string, seq long")
    queue = quorum.hints(writes, placed, nodes)
    assert [tuple(r) for r in queue.collect()] == [("node_dead", 7, "chaos_key", "v")]
    two_down = peers(["node_local", "node_dead", "node_alive"], ["node_dead", "node_alive"])
    assert quorum.acks(placed, two_down).first()["status"] == "failed"


def test_hints_drain_up_to_the_first_failure(spark, peers):
    queue = spark.createDataFrame([("a", s) for s in range(6)] + [("b", s) for s in range(3)] + [("unknown", 1)], "target string, seq long")
    got = {r["target"]: (r["delivered"], r["remaining"]) for r in quorum.deliver(queue, peers(["a", "b"]), ~((F.col("target") == "a") & F.col("seq").isin(3, 5))).collect()}
    assert got == {"a": (3, 3), "b": (3, 0), "unknown": (0, 1)}


def test_reads_and_repair(log):
    answers = {"A": log([("k", "old", 1, 0, "n"), ("d", "x", 1, 0, "n")]), "B": log([("k", "new", 3, 0, "n"), ("d", TOMBSTONE, 5, 0, "n")]), "C": log([("k", "mid", 2, 0, "n")])}
    assert state(quorum.coordinated_get(answers)) == {"k": "new"}  # the deletion of d isn't undone by A
    assert {(r["key"], r["replica"]) for r in quorum.read_repair(answers).collect()} == {("k", "A"), ("k", "C"), ("d", "A")}
    assert {(r["key"], r["replica"]) for r in quorum.read_repair(answers, compat=True).collect()} == {("k", "A"), ("k", "B"), ("k", "C"), ("d", "A"), ("d", "B")}


CLOCKS = [
    ("equal", {"a": 1}, {"a": 1}, False, False, True, False),
    ("dominated", {"a": 2, "b": 1}, {"a": 1, "b": 1}, True, False, False, False),
    ("concurrent", {"a": 2, "b": 1}, {"a": 1, "b": 2}, False, False, True, True),
    ("extra", {"a": 1, "b": 0}, {"a": 1}, True, False, False, False),
    ("both empty", {}, {}, False, False, True, False),
    ("one empty", {"a": 1}, {}, True, False, False, False),
]


def test_vector_clocks(spark):
    side = lambda k: spark.createDataFrame([(c[0], n, x) for c in CLOCKS for n, x in c[k].items()], "key string, node_id string, cnt long")
    got = {r["key"]: (r["a_descends"], r["b_descends"], r["conflict_compat"], r["conflict_true"]) for r in clock.compare(side(1), side(2)).collect()}
    assert got == {c[0]: c[3:] for c in CLOCKS if c[0] != "both empty"}
    maps = spark.createDataFrame([c[:3] for c in CLOCKS], "key string, a map<string,long>, b map<string,long>")
    verdicts = maps.select("key", clock.descends_maps(F.col("a"), F.col("b")).alias("x"), clock.descends_maps(F.col("b"), F.col("a")).alias("y")).collect()
    assert {r["key"]: (r["x"], r["y"]) for r in verdicts} == {c[0]: c[3:5] for c in CLOCKS}
    row = maps.filter("key = 'concurrent'").select(clock.merge_maps(F.col("a"), F.col("b")).alias("m"), clock.increment_map(F.col("a"), "c").alias("i"), clock.increment_map(F.col("a"), "a").alias("j")).first()
    assert (row["m"], row["i"], row["j"]) == ({"a": 2, "b": 2}, {"a": 2, "b": 1, "c": 1}, {"a": 3, "b": 1})


def descends(a, b):
    return all(a.get(n, 0) >= c for n, c in b.items()) and any(n not in b or c > b[n] for n, c in a.items())


def test_vector_clock_fold(spark):
    rnd = random.Random(6)
    names = ["n0", "n1", "n2"]
    writes = [(f"k{rnd.randrange(2)}", rnd.choice(names[:2]), s, None if rnd.random() < 0.3 else {n: rnd.randrange(6) for n in rnd.sample(names, rnd.randrange(3))}) for s in range(80)]
    clocks, want = {}, {}
    for key, node, seq, client in writes:
        own = clocks.setdefault((node, key), {})
        neither = client is not None and not descends(own, client) and not descends(client, own)
        want[seq] = (neither, neither and own != client)
        for n, c in (client or {}).items():
            own[n] = max(own.get(n, 0), c)
        own[node] = own.get(node, 0) + 1
        want[seq] += (own[node],)
    log = spark.createDataFrame(writes, "key string, node_id string, seq long, client map<string,long>")
    got = clock.fold_writes(log).collect()
    assert {r["seq"]: (r["conflict_compat"], r["conflict_true"], r["own_count"]) for r in got} == want


def beats(spark, *each):
    return spark.createDataFrame([(node, t) for node, times in enumerate(each) for t in times], "node long, ms long")


def test_phi(spark):
    rnd = random.Random(1)
    steady = [1000 + 10 * k + rnd.randrange(3) for k in range(16)]
    table = beats(spark, [1000], steady)
    soon = {r["node"]: r["phi"] for r in detect.phi(table, steady[-1] + 10).collect()}
    late = {r["node"]: r["phi"] for r in detect.phi(table, steady[-1] + 200).collect()}
    assert 0 not in soon and soon[1] < 8 < late[1]
    assert detect.dead(detect.phi(table, steady[-1] + 200)).count() == 1
    few = detect.phi(beats(spark, [1, 2, 3]), 100000).first()
    assert few["n"] == 2 and few["phi"] == 0
    early = detect.phi(table, steady[-1]).first()
    assert early["phi_monotone"] < 1 < early["phi"]


def cached(rows, capacity):
    """node -> reads, hits, misses, by playing caches through."""
    caches, count = {}, {}
    for node, key, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        cache, c = caches.setdefault(node, OrderedDict()), count.setdefault(node, [0, 0, 0])
        c[0] += 1
        c[1 if key in cache else 2] += 1
        cache[key] = True
        cache.move_to_end(key)
        if len(cache) > capacity:
            cache.popitem(last=False)
    return {n: tuple(c) for n, c in count.items()}


def test_least_recently_used(spark):
    rows = [("key1", 1), ("key2", 2), ("key1", 3), ("key3", 4), ("key1", 5), ("key2", 6)]
    access = spark.createDataFrame([(0, int(k[3:]), t, t) for k, t in rows], "node long, key long, ms long, event_id long")
    assert tuple(detect.cache_hits(access, 2).first()) == (0, 6, 2, 4)
    plan = detect.cache_hits(access, 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("block", [7, 64])
def test_least_recently_used_equals_brute_force(spark, block):
    """Hot keys, long scans that empty the cache, a node with fewer keys than places, ties in time; small blocks."""
    rnd = random.Random(block)
    rows = [(0, rnd.choice([rnd.randrange(5), rnd.randrange(60)]), 10 * k // 3, k) for k in range(400)]
    rows += [(1, k % 30 if k % 100 < 60 else 99, 50_000 * k, k) for k in range(300)]
    rows += [(2, rnd.randrange(3), k, k) for k in range(50)] + [(3, k, k, k) for k in range(40)] + [(4, 1, 5, 1)]
    access = spark.createDataFrame(rows, "node long, key long, ms long, event_id long")
    for capacity in (1, 4, 25):
        got = {r["node"]: (r["reads"], r["hits"], r["misses"]) for r in detect.cache_hits(access, capacity, block).collect()}
        assert got == cached(rows, capacity)


def test_presence_messages(spark):
    rows = [(1, "NODE_ALIVE:node_a:77"), (2, "NODE_ALIVE:node_a:x"), (3, "NODE_ALIVE:node_a"), (4, "hello"), (5, "NODE_ALIVE:a:b:c"), (6, "NODE_ALIVE:me:1"), (7, None)]
    got = detect.parse_presence(spark.createDataFrame(rows, "id long, message string"), own="me")
    assert {tuple(r) for r in got.collect()} == {(1, "node_a", 77), (2, "node_a", 0)}


def test_tables_round_trip(spark, tmp_path):
    rows = [(f"user_key_{k}", "v" * 335, 1710000000 + k, 0, "node_1", k % 2) for k in range(3000)]
    entries = spark.createDataFrame(rows, LOG + ", sst_id long")
    lsm.write_tables(entries, f"{tmp_path}/sst")
    back = spark.read.parquet(f"{tmp_path}/sst")
    assert sorted(tuple(r[c] for c in entries.columns) for r in back.collect()) == sorted(rows)
    found = back.filter("key = 'user_key_7' AND sst_id = 1")
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 1 and "EqualTo(key,user_key_7)" in plan and "PartitionFilters: [isnotnull(sst_id" in plan
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < sum(len(r[1]) for r in rows)


def test_bloom_has_no_false_negatives(spark):
    rows = [(f"k{k}", k % 3) for k in range(300)]
    tables = spark.createDataFrame(rows, "key string, sst_id long")
    probed = lsm.bloom_probe(tables.select("key"), lsm.bloom_build(tables))
    maybe = {(r["key"], r["sst_id"]) for r in probed.filter("maybe").collect()}
    assert set(rows) <= maybe and len(maybe) < 2 * len(rows)


def test_wal_round_trip(spark, log, tmp_path):
    own = Store(spark, f"{tmp_path}/store", "node_1")
    assert own.log().count() == 0
    own.rewrite_log()
    own.append(log([("key_A", "value_A", 100, 1, "node1")]))
    own.append(log([("key_B", "value_B", 105, 2, "node1"), ("key_A", "x" * 1000, 101, 0, "node1")]))
    assert own.log().count() == 3 and state(lsm.replay(own.log())) == {"key_A": "x" * 1000, "key_B": "value_B"}
    own.rewrite_log()
    assert own.log().count() == 2 and state(own.log()) == {"key_A": "x" * 1000, "key_B": "value_B"}
    own.append(log([("key_B", TOMBSTONE, 106, 0, "node1")]))
    own.rewrite_log()
    assert state(own.log()) == {"key_A": "x" * 1000, "key_B": TOMBSTONE} and len(list((tmp_path / "store" / "wal" / "node_id=node_1").glob("v=*"))) == 1


def test_store(spark, log, tmp_path):
    """Flush hands the memory table over, few keys stay; four tables are merged, removed, and a namesake's aren't touched."""
    own, other = Store(spark, f"{tmp_path}/store", "node_1"), Store(spark, f"{tmp_path}/store", "node_10")
    few = own.flush(log([("a", "1", 1, 0, "n"), ("a", "2", 2, 0, "n"), ("b", "1", 1, 0, "n")]), 1)
    assert few.count() == 3 and own.table_ids() == [] and own.read().count() == 0
    other.flush(log([(f"z{k}", "o", 1, 0, "n") for k in range(5)]), 1)
    parts = [COMPACTION[:1], COMPACTION[1:2], COMPACTION[2:4], COMPACTION[4:]]
    for k, part in enumerate(parts, 1):
        rest = own.flush(log([*part, *[(f"fill{k}{j}", "v", 5, 0, "n") for j in range(30)]]), k)
        assert rest.count() == 0
        assert own.compact(100) is (k == 4)
    want = {"key1": "new_val", "key2": "keep_me"} | {f"fill{k}{j}": "v" for k in range(1, 5) for j in range(30)}
    assert own.table_ids() == [100] and state(own.read()) == want and other.table_ids() == [1] and other.read().count() == 5
    keys = own.read().select("key")
    probed = lsm.bloom_probe(keys.unionByName(keys.select(F.concat("key", F.lit("?")).alias("key"))), own.read_filters(), lsm.COMPACT_BITS).filter("maybe")
    found = {r["key"] for r in probed.collect()}
    assert set(want) <= found and len(found) < 1.3 * len(want)
    with pytest.raises(ValueError):
        for k in range(101, 104):
            own.flush(log([(f"x{k}{j}", "v", 5, 0, "n") for j in range(3)]), k)
        own.compact(101)


def test_table_files_are_ranges_of_keys(spark, tmp_path):
    rows = [(f"k{k:05d}", "v", 1, 0, "n", k % 2) for k in range(4000)]
    lsm.write_tables(spark.createDataFrame(rows, LOG + ", sst_id long"), f"{tmp_path}/sst")
    spans = lsm.read_tables(spark, f"{tmp_path}/sst").groupBy("sst_id", F.input_file_name().alias("f")).agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("sst_id", "a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]) if x["sst_id"] == y["sst_id"])


def by_walking(keys, points, n, full=frozenset()):
    """The first n different nodes from each key's hash on, by walking the sorted points."""
    line = sorted(points)
    out = {}
    for k in keys:
        h = int(md5(k.encode()).hexdigest()[:15], 16)
        at = next((i for i, (p, _) in enumerate(line) if p >= h), 0)
        order = list(dict.fromkeys(line[(at + i) % len(line)][1] for i in range(len(line))))
        out[k] = ([x for x in order if x not in full] + [x for x in order if x in full])[:n]
    return out


def ring_points(names, vnodes):
    made = {}
    for x in names:
        for v in [f"{x}#{v}" for v in range(vnodes)] if vnodes else [x]:
            p = int(md5(v.encode()).hexdigest()[:15], 16)
            made[p] = max(x, made.get(p, x))
    return list(made.items())


def listed(df):
    of = {}
    for r in df.collect():
        of.setdefault(r["key"], {})[r["rank"]] = r["node_id"]
    return {k: [x[i] for i in sorted(x)] for k, x in of.items()}


@pytest.mark.parametrize("n_nodes, vnodes", [(1000, 256), (4, 2), (7, None), (2, None), (40, 3)])
def test_ring_equals_walking(spark, peers, n_nodes, vnodes):
    names = [f"node_{k}" for k in range(n_nodes)]
    keys = [f"user_{k}" for k in range(200)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    got = listed(ring.replicas(frame, peers(names), 3, vnodes))
    assert got == by_walking(keys, ring_points(names, vnodes), 3)


def test_bounded_ring_equals_walking(spark):
    keys = [f"user_{k}" for k in range(100)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    for loads in ([100] * 2 + [0], [10, 300, 20, 400, 30, 500, 600], [5] * 9, [1000] + [0] * 60, [0] + [1000] * 60):
        names = {f"n{k}": x for k, x in enumerate(loads)}
        mean = -(-sum(loads) // len(loads))
        full = {k for k, x in names.items() if x >= max(math.ceil(1.25 * mean), 5)}
        got = listed(ring.bounded(frame, spark.createDataFrame(list(names.items()), "node_id string, load long"), 3))
        assert got == by_walking(keys, ring_points(names, None), 3, full)


def test_hints_over_many_runs(spark, peers):
    """Failures in the first, a middle, the last run and none; queues with gaps."""
    rnd = random.Random(2)
    stops = {"a": 0, "b": 9000, "c": 29_999, "d": None, "e": 12_288}
    rows = [(t, s) for t in stops for s in sorted(rnd.sample(range(30_000), 300) + ([stops[t]] if stops[t] is not None else []))]
    rows = sorted(set(rows))
    queue = spark.createDataFrame(rows, "target string, seq long")
    ok = ~F.coalesce(*[F.when((F.col("target") == t) & (F.col("seq") >= s) & ((F.col("seq") == s) | (F.col("seq") % 3 == 0)), True) for t, s in stops.items() if s is not None], F.lit(False))
    got = {r["target"]: (r["delivered"], r["remaining"]) for r in quorum.deliver(queue, peers(list(stops)), ok).collect()}
    want = {}
    for t, stop in stops.items():
        own = [s for x, s in rows if x == t]
        done = [s for s in own if stop is None or s < stop]
        want[t] = (len(done), len(own) - len(done))
    assert got == want


def test_read_quorum(log):
    answers = {"A": log([("k", "old", 1, 0, "n"), ("only", "x", 1, 0, "n")]), "B": log([("k", "new", 3, 0, "n"), ("k", "newer", 4, 0, "n")])}
    assert state(quorum.coordinated_get(answers, 2)) == {"k": "newer"} and state(quorum.coordinated_get(answers, 1)) == {"k": "newer", "only": "x"}


def test_digest_scopes(log):
    memory, tables = log([("a", "x", 5, 0, "n")]), log([("a", "y", 7, 0, "n"), ("b", "y", 1, 0, "n")])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(merkle.digest(memory, tables)) == [("a", 7), ("b", 1)] and rows(merkle.digest(memory, tables, scope="memtable")) == [("a", 5)]
    with pytest.raises(ValueError):
        merkle.digest(memory, scope="other")


def test_writes_at_a_node(spark):
    rows = [("n1", "k", 1, None, "a", 5, 0), ("n1", "k", 2, {"n2": 1}, "b", 4, 0), ("n1", "k", 3, {"n1": 2, "n2": 1}, "c", 6, 0)]
    frame = spark.createDataFrame(rows, "node_id string, key string, seq long, client map<string,long>, value string, physical_time long, logical_counter long")
    got = {r["seq"]: (r["applied"], r["own_count"], r["conflict_true"], len(r["bits"])) for r in clock.write_local(frame).collect()}
    assert got == {1: (True, 1, False, 3), 2: (False, 2, True, 3), 3: (True, 3, False, 3)}


def test_upsert_and_json(spark):
    frame = spark.createDataFrame([("delete", "x"), ("set", "y")], "op string, value string")
    assert [r[0] for r in frame.select(lww.upsert(F.col("op"), F.col("value"))).collect()] == [TOMBSTONE, "y"]
    made = spark.createDataFrame([("a\"b", 1, 2, "n")], "value string, physical_time long, logical_counter long, node_id string").select(state_json().alias("j"), now_ms().alias("t")).first()
    assert json.loads(made["j"]) == {"value": 'a"b', "timestamp": {"physical_time": 1, "logical_counter": 2, "node_id": "n"}}
    assert abs(made["t"] / 1000 - time.time()) < 600


def test_presence_registers_peers(spark):
    sent = detect.presence(spark.createDataFrame([("b", 7), ("c", 8)], "node_id string, root long")).withColumn("id", F.lit(1).cast("bigint"))
    later = spark.createDataFrame([(2, "NODE_ALIVE:b:9")], "id long, message string")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "node_id string, root long")
    got = {r["node_id"]: r["root"] for r in detect.register(known, sent.unionByName(later)).collect()}
    assert got == {"a": 1, "b": 9, "c": 8}


def test_the_dead_are_evicted(spark):
    steady = [1000 + 10 * k for k in range(16)]
    scored = detect.phi(beats(spark, steady, [t + 300 for t in steady]), steady[-1] + 310)
    peers = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "node_id long, ip string")
    assert {r["node_id"] for r in detect.evict(peers, scored).collect()} == {1, 2}
