"""DuckDB SQL for the registered queries, on the same Parquet tables."""

from __future__ import annotations


def h60(x: str) -> str:
    """The first 60 bits of the MD5 of a string."""
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


RING = 1 << 60
LOG = """log AS (
  SELECT 'user_' || user_id AS key, CASE WHEN event_type = 'error' THEN '__TOMBSTONE__' ELSE event_type || ':' || event_id END AS value,
         epoch_us(ts) // 1000 AS physical_time, CAST(0 AS BIGINT) AS logical_counter, 'node_' || (event_id % 3) AS node_id, event_id AS seq
  FROM events)"""
LINES = """log AS (
  SELECT 'order_' || l_orderkey AS key, CASE WHEN l_returnflag = 'R' THEN '__TOMBSTONE__' ELSE 'part_' || l_partkey END AS value,
         epoch_us(l_shipdate) // 1000 AS physical_time, CAST(l_linenumber AS BIGINT) AS logical_counter, 'supp_' || l_suppkey AS node_id
  FROM lineitem)"""
PEERS = "peers AS (SELECT 'node_' || r_regionkey AS node_id, r_regionkey NOT IN (2, 4) AS alive FROM region)"


def latest(source: str, name: str) -> str:
    """A state: the last row of each key of a log."""
    order = "physical_time DESC, logical_counter DESC, node_id DESC, value DESC"
    return f"{name} AS (SELECT key, value, physical_time, logical_counter, node_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"


def replica(name: str) -> str:
    return f"log_{name} AS (SELECT * FROM log WHERE {h60(f"'{name}' || seq")} % 10 < 8), {latest(f'log_{name}', f'state_{name}')}"


ENTRY = h60("concat_ws('|', key, value, physical_time, logical_counter, node_id)")
BUCKET = f"{h60('key')} % 16"
STATE = f"{LOG}, {latest('log', 'state')}"
A_B = f"{LOG}, {replica('A')}, {replica('B')}"
A_B_C = f"{A_B}, {replica('C')}"


def merkle(name: str) -> str:
    return f"m_{name} AS (SELECT {BUCKET} AS bucket, bit_xor({ENTRY}) AS hash FROM state_{name} GROUP BY 1)"


def repaired(own: str, other: str) -> str:
    """repaired_X: a replica's state once it has pulled what the other has newer, key by key."""
    columns = ", ".join(f"CASE WHEN a.key IS NULL OR b.physical_time > a.physical_time THEN b.{c} ELSE a.{c} END AS {c}" for c in ("value", "physical_time", "logical_counter", "node_id"))
    return f"repaired_{own} AS (SELECT key, {columns} FROM state_{own} a FULL JOIN state_{other} b USING (key))"


DIFF = f"""{merkle('A')}, {merkle('B')}, diff AS (
  SELECT bucket, coalesce(a.hash, 0) AS hash_a, coalesce(b.hash, 0) AS hash_b FROM m_A a FULL JOIN m_B b USING (bucket) WHERE coalesce(a.hash, 0) <> coalesce(b.hash, 0))"""


def ring(name: str, points: str, full: str = "") -> str:
    """name(key, rank, node_id): all nodes ranked by the clockwise way to their next point."""
    return f"""{name}_points AS ({points}), {name}_ring AS (SELECT point, max(node_id) AS node_id FROM {name}_points GROUP BY point),
{name}_keys AS (SELECT key, {h60('key')} AS h FROM (SELECT DISTINCT key FROM {{keys}})),
{name}_dist AS (SELECT key, node_id, min(CASE WHEN point >= h THEN point - h ELSE point - h + {RING} END) AS dist FROM {name}_keys, {name}_ring GROUP BY ALL),
{name} AS (SELECT key, rank, node_id FROM (SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY {full} dist, node_id) AS rank FROM {name}_dist) WHERE rank <= 3)"""


VNODES = f"SELECT node_id, {h60("node_id || '#' || v")} AS point FROM peers, range(256) t(v)"
SIMPLE = f"SELECT node_id, {h60('node_id')} AS point FROM peers"
PLACED = f"{PEERS}, {ring('placed', VNODES).format(keys='log')}"
LOADS = f"""{PLACED}, loads AS (
  SELECT p.node_id, CAST(count(key) AS BIGINT) AS load FROM peers p LEFT JOIN (SELECT * FROM placed WHERE rank = 1) USING (node_id) GROUP BY p.node_id)"""
CAPACITY = """capacity AS (
  SELECT CAST(ceil(sum(load) / count(*)) AS BIGINT) AS avg_load, CAST(greatest(ceil(1.25 * ceil(sum(load) / count(*))), 5) AS BIGINT) AS capacity FROM loads)"""
ACKS = """SELECT key, count(*) AS replicas, count(*) FILTER (alive) AS acks, least(2, count(*)) AS required,
  CASE WHEN count(*) FILTER (alive) >= least(2, count(*)) THEN 'success' ELSE 'failed' END AS status FROM placed JOIN peers USING (node_id) GROUP BY key"""
HINTS = "hints AS (SELECT node_id AS target, seq, key, value FROM placed JOIN peers USING (node_id) JOIN log USING (key) WHERE NOT alive)"
ANSWERS = "answers AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS replica FROM state_{n}" for n in "ABC") + f"), {latest('answers', 'best')}"
TABLES = "tables AS (SELECT *, physical_time // 604800000 AS sst_id FROM log)"
FLUSH = """flushed AS (SELECT sst_id, key, value, physical_time, logical_counter, node_id FROM (
  SELECT *, count(*) OVER (PARTITION BY sst_id) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY sst_id, key ORDER BY physical_time DESC, logical_counter DESC, node_id DESC, value DESC) AS rn FROM tables) WHERE rn = 1) WHERE n >= 3)"""
BITS = "bits AS (SELECT DISTINCT sst_id, bit FROM (SELECT sst_id, ({0} + i * {1}) % 1024 AS bit FROM (SELECT DISTINCT sst_id, key FROM tables), range(3) t(i)))".format(h60("key"), h60("key || '*'"))


def clocks(name: str) -> str:
    return f"clock_{name} AS (SELECT key, node_id, count(*) AS cnt FROM log_{name} GROUP BY key, node_id)"


COMPARED = f"""{A_B}, {clocks('A')}, {clocks('B')}, compared AS (
  SELECT key, NOT bool_or(coalesce(b.cnt, 0) > coalesce(a.cnt, 0)) AND (bool_or(coalesce(a.cnt, 0) > coalesce(b.cnt, 0)) OR bool_or(b.cnt IS NULL)) AS a_descends,
         NOT bool_or(coalesce(a.cnt, 0) > coalesce(b.cnt, 0)) AND (bool_or(coalesce(b.cnt, 0) > coalesce(a.cnt, 0)) OR bool_or(a.cnt IS NULL)) AS b_descends,
         bool_or(a.cnt IS DISTINCT FROM b.cnt) AS differ
  FROM clock_A a FULL JOIN clock_B b USING (key, node_id) GROUP BY key)"""
BEATS = "beats AS (SELECT user_id AS node, epoch_us(ts) // 1000 AS ms FROM events)"
GAPS = "gaps AS (SELECT * FROM (SELECT node, ms, ms - lag(ms) OVER (PARTITION BY node ORDER BY ms) AS gap_ms FROM beats) WHERE gap_ms IS NOT NULL)"
PHI = f"""{BEATS}, {GAPS}, stats AS (
  SELECT node, count(*) AS n, avg(gap_ms / 1000.0) AS mean_s, greatest(sqrt(var_pop(gap_ms / 1000.0)), 0.001) AS sd_s, (1706659200000 - max(ms)) / 1000.0 AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ms DESC) AS back FROM gaps) WHERE back <= 100 GROUP BY node),
steps AS (SELECT *, (t - mean_s) / sd_s AS y FROM stats),
tails AS (SELECT *, exp(-y * (1.5976 + 0.070566 * y * y)) AS e FROM steps),
upper AS (SELECT *, CASE WHEN isinf(e) THEN CAST('nan' AS DOUBLE) ELSE e / (1 + e) END AS u FROM tails),
chances AS (SELECT *, CASE WHEN t > mean_s THEN u ELSE 1 - u END AS p FROM upper),
phi AS (SELECT node, n, mean_s, sd_s,
  CASE WHEN n < 10 THEN 0.0 ELSE -log10(greatest(CASE WHEN isnan(p) THEN 1e-12 ELSE p END, 1e-12)) END AS phi,
  CASE WHEN n < 10 THEN 0.0 ELSE -log10(greatest(CASE WHEN isnan(u) THEN 1.0 ELSE u END, 1e-12)) END AS phi_monotone FROM chances)"""
ACCESS = """access AS (SELECT event_id % 3 AS node, user_id AS key, row_number() OVER (PARTITION BY event_id % 3 ORDER BY epoch_us(ts) // 1000, event_id) AS pos FROM events),
linked AS (SELECT *, lag(pos) OVER w AS before, coalesce(lead(pos) OVER w, 1000000000000) AS after FROM access WINDOW w AS (PARTITION BY node, key ORDER BY pos)),
reach AS (SELECT a.node, a.pos, a.before, count(b.pos) AS others FROM linked a LEFT JOIN linked b ON a.node = b.node AND b.pos > a.before AND b.pos < a.pos AND b.after > a.pos GROUP BY ALL)"""


def hits(capacity: int) -> str:
    return f"cache AS (SELECT node, count(*) AS reads, count(*) FILTER (before IS NOT NULL AND others < {capacity}) AS hits, count(*) FILTER (before IS NULL OR others >= {capacity}) AS misses FROM reach GROUP BY node)"


CLOCKED = f"""{LOG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY seq) AS i, seq % 4 > 0 AS told FROM log),
each AS (SELECT l.node_id, key, seq, i, told, n.n, CASE WHEN told AND n.n = 'node_' || seq % 3 THEN seq % 5 WHEN told AND n.n = 'node_' || (seq + 1) % 3 THEN seq % 7 END AS k
  FROM numbered l, (SELECT 'node_' || x AS n FROM range(3) t(x)) n),
lines AS (SELECT *, max(k) OVER b AS k_before, max(k - (i - 1)) OVER b AS ahead_before, max(k - (i - 1)) OVER u AS ahead FROM each
  WINDOW b AS (PARTITION BY node_id, key, n ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY node_id, key, n ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rows_ AS (SELECT *, CASE WHEN n <> node_id THEN k_before WHEN i > 1 THEN i - 1 + greatest(0, coalesce(ahead_before, 0)) END AS had, CASE WHEN n = node_id THEN i + greatest(0, coalesce(ahead, 0)) END AS has FROM lines),
met AS (SELECT node_id, key, seq, max(has) AS own_count, bool_or(told) AS told, bool_or(had IS DISTINCT FROM k) AS differ,
  NOT bool_or(k IS NOT NULL AND k > coalesce(had, 0)) AND bool_or(had IS NOT NULL AND (k IS NULL OR had > k)) AS node_descends,
  NOT bool_or(had IS NOT NULL AND had > coalesce(k, 0)) AND bool_or(k IS NOT NULL AND (had IS NULL OR k > had)) AS client_descends FROM rows_ GROUP BY node_id, key, seq)"""
HEARD = """messages AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'NODE_ALIVE:node_' || event_id % 5 || ':abc' WHEN 1 THEN 'NODE_ALIVE:node_' || event_id % 5
  WHEN 2 THEN 'HELLO:node_' || event_id % 5 || ':' || event_id ELSE 'NODE_ALIVE:node_' || event_id % 5 || ':' || event_id END AS message FROM events UNION ALL SELECT -1, 'NODE_ALIVE:node_new:77'),
parts AS (SELECT id, string_split(substr(message, 12), ':') AS p FROM messages WHERE starts_with(message, 'NODE_ALIVE:')),
heard AS (SELECT id, p[1] AS node_id, coalesce(TRY_CAST(p[2] AS BIGINT), 0) AS root FROM parts WHERE len(p) = 2 AND p[1] <> 'node_0')"""
ASKED = "asked AS (SELECT unnest(['user_1', 'user_2', 'user_3', 'user_5', 'user_8', 'user_13', 'user_100000000', 'nobody']) AS key)"
FLAT = "key, value, physical_time, logical_counter, node_id"

ORACLE_SQL = {
    "lww_latest": f"WITH {STATE} SELECT {FLAT} FROM state",
    "lww_latest_lineitem": f"WITH {LINES}, {latest('log', 'state')} SELECT {FLAT} FROM state",
    "state_scan": f"WITH {STATE} SELECT key, value, physical_time FROM state WHERE value <> '__TOMBSTONE__'",
    "tombstones": f"WITH {STATE} SELECT key, physical_time FROM state WHERE value = '__TOMBSTONE__'",
    "point_get": f"""WITH {STATE}, {ASKED} SELECT key, CASE WHEN value IS NULL THEN 'not_found' WHEN value = '__TOMBSTONE__' THEN 'deleted' ELSE 'found' END AS status,
  CASE WHEN value <> '__TOMBSTONE__' THEN value END AS value FROM asked LEFT JOIN state USING (key)""",
    "lww_merge": f"WITH {A_B}, both_logs AS (SELECT * FROM log_A UNION ALL SELECT * FROM log_B), {latest('both_logs', 'state')} SELECT key, value, physical_time FROM state",
    "hlc_order": f"WITH {LINES} SELECT key, row_number() OVER (PARTITION BY key ORDER BY physical_time, logical_counter, node_id, value) AS pos, value FROM log",
    "write_path": f"""WITH {LOG}, seen AS (SELECT key, row(physical_time, logical_counter, node_id) AS c,
    max(row(physical_time, logical_counter, node_id)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM log)
SELECT key, count(*) AS writes, count(*) FILTER (best IS NULL OR c > best) AS accepted, count(*) FILTER (best IS NOT NULL AND c <= best) AS rejected FROM seen GROUP BY key""",
    "key_count": f"WITH {STATE} SELECT count(*) AS n_keys FROM state",
    "node_loads": f"WITH {LOG}, {LOADS} SELECT node_id, load FROM loads",
    "digest": f"WITH {STATE} SELECT key, physical_time FROM state",
    "digest_memtable": f"WITH {LOG}, memory AS (SELECT * FROM log WHERE seq % 10 = 9), {latest('memory', 'state')} SELECT key, physical_time FROM state",
    "merkle_buckets": f"WITH {STATE} SELECT {BUCKET} AS bucket, bit_xor({ENTRY}) AS hash FROM state GROUP BY 1",
    "merkle_root": f"WITH {STATE} SELECT bit_xor({ENTRY}) AS root, count(*) AS n_keys FROM state",
    "merkle_diff": f"WITH {A_B}, {DIFF} SELECT bucket, hash_a, hash_b FROM diff",
    "anti_entropy_pull": f"""WITH {A_B} SELECT key, b.physical_time AS remote_ts, a.physical_time AS local_ts FROM state_B b LEFT JOIN state_A a USING (key)
WHERE a.physical_time IS NULL OR b.physical_time > a.physical_time""",
    "delta_push": f"""WITH {A_B}, {DIFF} SELECT key, a.value, a.physical_time AS local_ts, coalesce(b.physical_time, 0) AS peer_ts FROM state_A a LEFT JOIN state_B b USING (key)
WHERE {h60('a.key')} % 16 IN (SELECT bucket FROM diff) AND a.physical_time > coalesce(b.physical_time, 0)""",
    "replica_convergence": f"""WITH {A_B}, {repaired('A', 'B')}, {repaired('B', 'A')}, l AS (SELECT {BUCKET} AS bucket, bit_xor({ENTRY}) AS hash FROM repaired_A GROUP BY 1), r AS (SELECT {BUCKET} AS bucket, bit_xor({ENTRY}) AS hash FROM repaired_B GROUP BY 1)
SELECT count(*) AS mismatched FROM l FULL JOIN r USING (bucket) WHERE coalesce(l.hash, 0) <> coalesce(r.hash, 0)""",
    "anti_entropy_repair": f"WITH {A_B}, {repaired('A', 'B')} SELECT key, value, physical_time FROM repaired_A",
    "ring_table": f"WITH {PEERS}, points AS ({VNODES}), r AS (SELECT point, max(node_id) AS node_id FROM points GROUP BY point) SELECT node_id, count(*) AS vnodes, min(point) AS min_hash, max(point) AS max_hash FROM r GROUP BY node_id",
    "ring_replicas": f"WITH {LOG}, {PLACED} SELECT key, rank, node_id FROM placed",
    "ring_replicas_simple": f"WITH {LOG}, {PEERS}, {ring('placed', SIMPLE).format(keys='log')} SELECT key, rank, node_id FROM placed",
    "ring_bounded": f"WITH {LOG}, {LOADS}, {CAPACITY}, {ring('bounded', SIMPLE, '(SELECT load >= capacity FROM loads l, capacity WHERE l.node_id = bounded_dist.node_id),').format(keys='log')} SELECT key, rank, node_id FROM bounded",
    "bounded_capacity": f"WITH {LOG}, {LOADS}, {CAPACITY} SELECT avg_load, capacity FROM capacity",
    "quorum_write": f"WITH {LOG}, {PLACED} {ACKS}",
    "quorum_delete": f"WITH {LOG}, deleted AS (SELECT * FROM log WHERE value = '__TOMBSTONE__'), {PEERS}, {ring('placed', VNODES).format(keys='deleted')} {ACKS}",
    "hints_pending": f"WITH {LOG}, {PLACED}, {HINTS} SELECT target, count(*) AS n FROM hints GROUP BY target",
    "hint_delivery": f"""WITH {LOG}, {PLACED}, {HINTS}, tried AS (SELECT *, {h60("'ok' || target || seq")} % 100 > 0 AS ok FROM hints),
prefix AS (SELECT *, bool_and(ok) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent FROM tried)
SELECT target, count(*) FILTER (sent) AS delivered, count(*) FILTER (NOT sent) AS remaining FROM prefix GROUP BY target""",
    "coordinated_get": f"WITH {A_B_C}, {ANSWERS} SELECT key, value, physical_time FROM best WHERE value <> '__TOMBSTONE__'",
    "coordinated_get_quorum": f"WITH {A_B_C}, {ANSWERS} SELECT key, value, physical_time FROM best WHERE value <> '__TOMBSTONE__' AND key IN (SELECT key FROM answers GROUP BY key HAVING count(*) >= 3)",
    "read_repair": f"WITH {A_B_C}, {ANSWERS} SELECT key, replica, a.physical_time AS replica_ts, b.physical_time AS fresh_ts FROM answers a JOIN best b USING (key) WHERE a.physical_time < b.physical_time",
    "read_repair_compat": f"""WITH {A_B_C}, {ANSWERS}, ran AS (SELECT key, replica, physical_time, max(physical_time) OVER (PARTITION BY key ORDER BY replica ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM answers)
SELECT key, replica, r.physical_time AS replica_ts, b.physical_time AS fresh_ts FROM ran r JOIN best b USING (key) WHERE before IS NULL OR r.physical_time <> before""",
    "bloom_build": f"WITH {LOG}, {TABLES}, {BITS} SELECT sst_id, bit FROM bits",
    "bloom_probe": f"""WITH {LOG}, {TABLES}, {BITS}, asked AS (SELECT DISTINCT key FROM log UNION ALL SELECT DISTINCT key || '?' FROM log), ids AS (SELECT DISTINCT sst_id FROM tables),
probed AS (SELECT key, sst_id, bool_and(({h60('key')} + i * {h60("key || '*'")}) % 1024 IN (SELECT bit FROM bits b WHERE b.sst_id = ids.sst_id)) AS maybe,
  any_value(key IN (SELECT key FROM tables x WHERE x.sst_id = ids.sst_id)) AS member FROM asked, ids, range(3) t(i) GROUP BY key, sst_id)
SELECT sst_id, count(*) AS asked, count(*) FILTER (member) AS members, count(*) FILTER (maybe) AS maybe, count(*) FILTER (maybe AND NOT member) AS false_positives, count(*) FILTER (member AND NOT maybe) AS missed FROM probed GROUP BY sst_id""",
    "sst_read": f"WITH {LOG}, {TABLES}, {FLUSH} SELECT sst_id, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM flushed GROUP BY sst_id",
    "sst_flush": f"WITH {LOG}, {TABLES}, {FLUSH} SELECT sst_id, {FLAT} FROM flushed",
    "sst_discovery": f"WITH {LOG}, {TABLES}, {FLUSH} SELECT sst_id, count(*) AS n FROM flushed WHERE sst_id % 2 = 0 GROUP BY sst_id",
    "compaction": f"WITH {LOG}, {TABLES}, {FLUSH}, {latest('flushed', 'state')} SELECT {FLAT} FROM state WHERE value <> '__TOMBSTONE__'",
    "wal_replay": f"WITH {STATE} SELECT {FLAT} FROM state",
    "wal_compact": f'WITH {LOG} SELECT count(*) AS "before", count(DISTINCT key) AS "after" FROM log',
    "vclock_state": f"WITH {LOG} SELECT key, node_id, count(*) AS cnt FROM log GROUP BY key, node_id",
    "vclock_merge": f"WITH {A_B}, {clocks('A')}, {clocks('B')} SELECT key, node_id, max(cnt) AS cnt FROM (SELECT * FROM clock_A UNION ALL SELECT * FROM clock_B) GROUP BY key, node_id",
    "vclock_descends": f"WITH {COMPARED} SELECT key, a_descends, b_descends FROM compared",
    "vclock_conflicts": f"WITH {COMPARED} SELECT key, NOT a_descends AND NOT b_descends AS conflict_compat, NOT a_descends AND NOT b_descends AND differ AS conflict_true FROM compared",
    "vclock_writes": f"WITH {CLOCKED} SELECT node_id, key, seq, own_count, told AND NOT node_descends AND NOT client_descends AS conflict_compat, told AND NOT node_descends AND NOT client_descends AND differ AS conflict_true FROM met",
    "write_local": f"""WITH {CLOCKED},
seen AS (SELECT node_id, key, row(physical_time, logical_counter, value) AS c, max(row(physical_time, logical_counter, value)) OVER (PARTITION BY node_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM log),
taken AS (SELECT node_id, count(*) FILTER (best IS NULL OR c > best) AS applied FROM seen GROUP BY node_id),
write_bits AS (SELECT node_id, count(DISTINCT ({h60('key')} + i * {h60("key || '*'")}) % 10000) AS bits FROM (SELECT DISTINCT node_id, key FROM log), range(3) t(i) GROUP BY node_id)
SELECT node_id, count(*) AS writes, any_value(applied) AS applied, count(*) FILTER (told AND NOT node_descends AND NOT client_descends) AS conflicts, count(DISTINCT key) AS keys, max(own_count) AS most_writes, any_value(bits) AS bits
FROM met JOIN taken USING (node_id) JOIN write_bits USING (node_id) GROUP BY node_id""",
    "heartbeat_intervals": f"WITH {BEATS}, {GAPS} SELECT node, ms, gap_ms FROM gaps",
    "phi_accrual": f"WITH {PHI} SELECT node, n, round(mean_s, 6) AS mean_s, round(sd_s, 6) AS sd_s, round(phi, 6) AS phi, round(phi_monotone, 6) AS phi_monotone FROM phi",
    "phi_dead": f"WITH {PHI} SELECT node FROM phi WHERE phi > 8",
    "membership": f"""WITH {PHI}, gossip AS (SELECT user_id AS node_id, epoch_us(ts) // 1000 AS ms, event_id % 1000 AS key_count FROM events WHERE user_id <> 0),
newest AS (SELECT node_id, max(row(ms, key_count)) AS m FROM gossip GROUP BY node_id)
SELECT node_id, m[1] AS last_seen, m[2] AS load, CASE WHEN phi > 8 THEN 'Dead' ELSE 'Alive' END AS status FROM newest LEFT JOIN phi ON node = node_id""",
    "eviction": f"""WITH {PHI}, newest AS (SELECT user_id AS node_id, max(row(epoch_us(ts) // 1000, event_id % 1000)) AS m FROM events WHERE user_id <> 0 GROUP BY user_id)
SELECT node_id, m[1] AS last_seen, m[2] AS load FROM newest LEFT JOIN phi ON node = node_id WHERE phi IS NULL OR phi <= 8""",
    "peer_registry": f"""WITH {HEARD} SELECT node_id, coalesce(h.root, p.root) AS root FROM (SELECT 'node_' || r_regionkey AS node_id, CAST(0 AS BIGINT) AS root FROM region) p
FULL JOIN (SELECT node_id, arg_max(root, row(id, root)) AS root FROM heard GROUP BY node_id) h USING (node_id)""",
    "discovery_parse": """WITH messages AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'NODE_ALIVE:node_' || event_id % 5 || ':abc' WHEN 1 THEN 'NODE_ALIVE:node_' || event_id % 5
  WHEN 2 THEN 'HELLO:node_' || event_id % 5 || ':' || event_id ELSE 'NODE_ALIVE:node_' || event_id % 5 || ':' || event_id END AS message FROM events),
parts AS (SELECT id, string_split(substr(message, 12), ':') AS p FROM messages WHERE starts_with(message, 'NODE_ALIVE:'))
SELECT id, p[1] AS node_id, coalesce(TRY_CAST(p[2] AS BIGINT), 0) AS root FROM parts WHERE len(p) = 2 AND p[1] <> 'node_0'""",
    "peer_choice": f"""WITH {PEERS}, rounds AS (SELECT i AS round, 'node_' || i % 5 AS own FROM range(1000) t(i))
SELECT round, arg_min(node_id, row({h60("concat_ws('|', round, node_id)")}, node_id)) AS node_id FROM rounds, peers WHERE own <> node_id GROUP BY round""",
    "lru_hits": f"WITH {ACCESS}, {hits(40)} SELECT node, reads, hits, misses FROM cache",
    "metrics_counts": f"WITH {ACCESS}, {hits(100)} SELECT CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses FROM cache",
    "watch_changes": f"""WITH {LOG}, moved AS (SELECT physical_time // 3600000 AS hour, {ENTRY} AS h, key, physical_time, logical_counter, node_id, value FROM log),
steps AS (SELECT hour, xor(h, coalesce(lag(h) OVER (PARTITION BY key ORDER BY physical_time, logical_counter, node_id, value), 0)) AS x FROM moved),
hours AS (SELECT hour, bit_xor(x) AS x FROM steps GROUP BY hour), roots AS (SELECT hour, bit_xor(x) OVER (ORDER BY hour) AS root FROM hours)
SELECT hour, root, root <> lag(root, 1, 0) OVER (ORDER BY hour) AS changed FROM roots""",
    "stream_lww": f"WITH {STATE} SELECT {FLAT} FROM state",
    "stream_state_feed": f"""WITH {STATE}, roots AS (SELECT bit_xor({ENTRY}) AS root FROM state)
SELECT key, '{{"value":"' || value || '","timestamp":{{"physical_time":' || physical_time || ',"logical_counter":' || logical_counter || ',"node_id":"' || node_id || '"}}}}' AS register, root FROM state, roots""",
    "stream_detectors": f"""WITH {BEATS}, last_gaps AS (SELECT * FROM (SELECT node, ms, ms - lag(ms) OVER (PARTITION BY node ORDER BY ms) AS gap, row_number() OVER (PARTITION BY node ORDER BY ms DESC) AS back FROM beats) WHERE back <= 100)
SELECT node, count(gap) AS n, max(ms) AS last_ms, round(avg(gap), 6) AS mean_ms FROM last_gaps GROUP BY node""",
    "stream_watch": f"WITH {LOG} SELECT key, seq FROM log",
}
