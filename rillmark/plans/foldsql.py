"""The ordered folds as DuckDB recursive queries: one step per row of each key, with the state in columns."""

from __future__ import annotations

from rillmark.plans.queries import _LOG

QTA_RESERVE = """WITH RECURSIVE e AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS tenant, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT tenant, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS r, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS d, 0::BIGINT AS g FROM (SELECT DISTINCT tenant FROM e) UNION ALL
  SELECT tenant, i, n, r, a + CASE WHEN r IS NULL THEN n % 2 ELSE 0 END, b + CASE WHEN r IS NULL THEN n % 7 * 100 ELSE 0 END, c + CASE WHEN r IS NULL THEN n % 11 * 1000 ELSE 0 END, d + CASE WHEN r IS NULL THEN n % 3 ELSE 0 END, g + CASE WHEN r IS NULL THEN n % 5 ELSE 0 END
  FROM (SELECT f.tenant, e.i, e.n, a, b, c, d, g, CASE WHEN a + n % 2 > 40 THEN 'connections' WHEN b + n % 7 * 100 > 20000 THEN 'memory_bytes' WHEN c + n % 11 * 1000 > 300000 THEN 'disk_bytes' WHEN d + n % 3 > 60 THEN 'tasks' WHEN g + n % 5 > 110 THEN 'background_tasks' END AS r FROM f JOIN e ON e.tenant = f.tenant AND e.i = f.i + 1))
 SELECT tenant, seq, r AS rejected_by FROM f WHERE i > 0"""

_DIMENSIONS = {"connections": (2, 5), "memory_bytes": (700, 4000), "disk_bytes": (11_000, 60_000), "tasks": (3, 12), "background_tasks": (5, 20)}
QTA_LEDGER = f"""WITH RECURSIVE e AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS tenant, o_orderkey AS n, o_orderkey % 4 = 1 AS rel, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT tenant, 0::BIGINT AS i, 0::BIGINT AS seq, true AS ok, {', '.join(f'0::BIGINT AS {k}' for k in _DIMENSIONS)} FROM (SELECT DISTINCT tenant FROM e) UNION ALL
  SELECT tenant, i, n, ok, {', '.join(f'CASE WHEN NOT ok THEN {k} WHEN rel THEN greatest({k} - n % {m}, 0) ELSE {k} + n % {m} END' for k, (m, _) in _DIMENSIONS.items())}
  FROM (SELECT f.tenant, e.i, e.n, rel, {', '.join(_DIMENSIONS)}, rel OR ({' AND '.join(f'{k} + n % {m} <= {most}' for k, (m, most) in _DIMENSIONS.items())}) AS ok FROM f JOIN e ON e.tenant = f.tenant AND e.i = f.i + 1))
 SELECT tenant, seq, ok, {', '.join(f'{k} AS used_{k}' for k in _DIMENSIONS)} FROM f WHERE i > 0"""

QTA_MOVES = """WITH RECURSIVE e AS (SELECT o_orderkey % 8 AS node, o_orderkey AS n, CASE WHEN o_orderkey % 13 = 0 THEN 'reset' WHEN o_orderkey % 3 = 0 THEN 'finish' ELSE 'start' END AS kind, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT node, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::BOOLEAN AS started, 0::BIGINT AS active, 0::BIGINT AS spent FROM (SELECT DISTINCT node FROM e) UNION ALL
  SELECT node, i, n, started, CASE WHEN started THEN active + 1 WHEN kind = 'finish' THEN greatest(active - 1, 0) ELSE active END, CASE WHEN started THEN spent + n % 100 WHEN kind = 'reset' THEN 0 ELSE spent END
  FROM (SELECT f.node, e.i, e.n, kind, active, spent, CASE WHEN kind = 'start' THEN active < 3 AND spent + n % 100 <= 200 END AS started FROM f JOIN e ON e.node = f.node AND e.i = f.i + 1))
 SELECT node, seq, started, active FROM f WHERE i > 0"""

REP_SHIP = """WITH RECURSIVE e AS (SELECT CAST(o_orderkey % 16 AS INTEGER) AS part, o_orderkey AS n, row_number() OVER w AS i, row_number() OVER w - CASE WHEN o_orderkey % 17 = 3 THEN 1 WHEN o_orderkey % 19 = 4 THEN 2 ELSE 0 END AS at_, o_orderkey % 23 = 5 AS old FROM orders WINDOW w AS (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey)),
 f AS (SELECT part, 0::BIGINT AS i, 0::BIGINT AS seq, '' AS outcome, NULL::BIGINT AS last FROM (SELECT DISTINCT part FROM e) UNION ALL
  SELECT part, i, n, o, CASE WHEN o = 'applied' THEN at_ ELSE last END FROM (SELECT f.part, e.i, e.n, at_, last, CASE WHEN old THEN 'fenced' WHEN at_ < last THEN 'stale' WHEN at_ = last THEN 'duplicate' WHEN at_ <> last + 1 THEN 'gap' ELSE 'applied' END AS o FROM f JOIN e ON e.part = f.part AND e.i = f.i + 1))
 SELECT 's' AS stream, part, seq, outcome FROM f WHERE i > 0"""

_RECURSIVE_LOG = _LOG.replace("WITH ", "WITH RECURSIVE ", 1)
BAT_INGRESS = _RECURSIVE_LOG + """, e AS MATERIALIZED (SELECT stream, part, off, bytes FROM log),
 f AS (SELECT DISTINCT stream, part, -1::BIGINT AS off, 0::BIGINT AS batch, 0::BIGINT AS mine, 0::BIGINT AS n, 0::BIGINT AS size FROM e UNION ALL
  SELECT stream, part, off, batch + CASE WHEN full_ THEN 1 ELSE 0 END, batch, CASE WHEN full_ THEN 0 ELSE n + 1 END, CASE WHEN full_ THEN 0 ELSE size + bytes END
  FROM (SELECT f.stream, f.part, e.off, f.batch, f.n, f.size, e.bytes, f.n + 1 >= 20 OR f.size + e.bytes >= 2000 AS full_ FROM f JOIN e ON e.stream = f.stream AND e.part = f.part AND e.off = f.off + 1))
 SELECT stream, part, off, mine AS batch FROM f WHERE off >= 0"""

SNK_QUEUE = _RECURSIVE_LOG + """, e AS MATERIALIZED (SELECT stream, part, off, bytes FROM log),
 f AS (SELECT DISTINCT stream, part, -1::BIGINT AS off, 0::BIGINT AS batch, true AS taken, 0::BIGINT AS n, 0::BIGINT AS size FROM e UNION ALL
  SELECT stream, part, off, batch + CASE WHEN taken AND next THEN 1 ELSE 0 END, taken, CASE WHEN NOT taken THEN n WHEN next THEN 1 ELSE n + 1 END, CASE WHEN NOT taken THEN size WHEN next THEN bytes ELSE size + bytes END
  FROM (SELECT f.stream, f.part, e.off, f.batch, f.n, f.size, e.bytes, e.bytes <= 2000 AS taken, f.n >= 20 OR f.size + e.bytes > 2000 AS next FROM f JOIN e ON e.stream = f.stream AND e.part = f.part AND e.off = f.off + 1))
 SELECT stream, part, off, CASE WHEN taken THEN batch END AS batch FROM f WHERE off >= 0"""

REP_ROLES = """WITH RECURSIVE e AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS region, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT region, 0::BIGINT AS i, 0::BIGINT AS seq, true AS ok, 0::BIGINT AS token, 'standby' AS role FROM (SELECT DISTINCT region FROM e) UNION ALL
  SELECT region, i, k, ok, token + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN NOT ok THEN role WHEN k % 4 = 1 THEN 'fenced' WHEN k % 4 = 2 THEN 'standby' ELSE 'primary' END
  FROM (SELECT f.region, e.i, e.k, token, role, CASE k % 4 WHEN 0 THEN k % 5 = token WHEN 3 THEN k % 5 = token AND k % 20 <= 10 ELSE true END AS ok FROM f JOIN e ON e.region = f.region AND e.i = f.i + 1))
 SELECT region, seq, ok, token, role FROM f WHERE i > 0"""

PLC_PHASES = """WITH RECURSIVE e AS (SELECT l_orderkey AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS seq, l_returnflag = 'A' AS back, l_partkey % 5 <> 0 AND l_suppkey % 10 + 3 >= 6 AS ready, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice * 100)) AS i FROM lineitem),
 f AS (SELECT id, 0::BIGINT AS i, 0::BIGINT AS seq, true AS ok, 1::INTEGER AS p FROM (SELECT DISTINCT id FROM e) UNION ALL
  SELECT id, i, seq, ok, CAST(CASE WHEN back THEN CASE WHEN ok THEN 6 ELSE p END WHEN p < 5 AND ok THEN p + 1 ELSE p END AS INTEGER) FROM (SELECT f.id, e.i, e.seq, back, p, CASE WHEN back THEN p <= 2 WHEN p IN (2, 3) THEN ready ELSE true END AS ok FROM f JOIN e ON e.id = f.id AND e.i = f.i + 1))
 SELECT id, seq, ok, ['add_replica', 'catching_up', 'transfer_leadership', 'remove_replica', 'complete', 'rolled_back'][p] AS phase FROM f WHERE i > 0"""

ORD_CREDIT = """WITH RECURSIVE e AS (SELECT user_id % 100 AS consumer, event_id AS seq, event_id % 5 = 0 AS given, event_id // 5 % 4 + 1 AS c, CASE WHEN event_id % 5 = 0 THEN 40 ELSE strlen(props) END AS bytes, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) AS i FROM events),
 f AS (SELECT consumer, 0::BIGINT AS i, 0::BIGINT AS seq, true AS given, NULL::BIGINT AS taker, [0, 0, 0, 0]::BIGINT[] AS n, [0, 0, 0, 0]::BIGINT[] AS size FROM (SELECT DISTINCT consumer FROM e) UNION ALL
  SELECT consumer, i, seq, given, taker, list_transform(n, lambda x, k: x + CASE WHEN given AND k = c THEN 3 WHEN NOT given AND k = taker THEN -1 ELSE 0 END), list_transform(size, lambda x, k: x + CASE WHEN given AND k = c THEN bytes WHEN NOT given AND k = taker THEN -bytes ELSE 0 END)
  FROM (SELECT f.consumer, e.i, e.seq, e.given, e.c, e.bytes, f.n, f.size, CASE WHEN NOT e.given THEN CAST(list_filter([1, 2, 3, 4], lambda k: f.n[k] >= 1 AND f.size[k] >= e.bytes)[1] AS BIGINT) END AS taker FROM f JOIN e ON e.consumer = f.consumer AND e.i = f.i + 1))
 SELECT consumer, seq, taker - 1 AS connection FROM f WHERE i > 0 AND NOT given"""

PLC_TRANSFERS = """WITH RECURSIVE e AS (SELECT CAST(c_nationkey AS VARCHAR) AS cluster, c_mktsegment AS stream, CAST(c_custkey AS INTEGER) AS part, CAST(c_custkey % 6 + 1 AS INTEGER) AS src, [CAST((c_custkey + 1) % 6 + 1 AS INTEGER), CAST((c_custkey + 3) % 6 + 1 AS INTEGER)] AS others, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS i FROM customer),
 f AS (SELECT cluster, 0::BIGINT AS i, '' AS stream, 0::INTEGER AS part, 0::INTEGER AS src, NULL::INTEGER AS dst, [1, 2, 3, 4, 5, 6]::INTEGER[] AS leads FROM (SELECT DISTINCT cluster FROM e) UNION ALL
  SELECT cluster, i, stream, part, src, d, list_transform(leads, lambda x, k: x + CASE WHEN d IS NULL THEN 0 WHEN k = d THEN 1 WHEN k = src THEN -1 ELSE 0 END)
  FROM (SELECT *, CASE WHEN leads[best] < leads[src] THEN best END AS d FROM (SELECT f.cluster, e.i, e.stream, e.part, e.src, f.leads, list_sort(list_transform(list_filter(others, lambda x: x <> 2 AND x <> e.src), lambda x: {'l': f.leads[x], 'n': x}))[1].n AS best FROM f JOIN e ON e.cluster = f.cluster AND e.i = f.i + 1)))
 SELECT cluster, stream, part, src, dst FROM f WHERE i > 0 AND dst IS NOT NULL"""

GRP_GENERATIONS = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS group_id, event_id AS seq, epoch_us(ts) // 1000 AS at_, CASE event_type WHEN 'signup' THEN 'join' WHEN 'purchase' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'heartbeat' END AS kind, event_id % 10 + 1 AS m, event_id % 9 = 0 AS old, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT group_id, 0::BIGINT AS i, 0::BIGINT AS seq, '' AS outcome, 0::BIGINT AS generation, list_transform(range(10), lambda x: NULL::BIGINT) AS seen FROM (SELECT DISTINCT group_id FROM e) UNION ALL
  SELECT group_id, i, seq, outcome, g + CASE WHEN outcome = 'ok' AND kind <> 'heartbeat' THEN 1 ELSE 0 END, list_transform(live, lambda x, k: CASE WHEN outcome <> 'ok' OR k <> m THEN x WHEN kind = 'leave' THEN NULL ELSE at_ END)
  FROM (SELECT *, generation + CASE WHEN len(list_filter(live, lambda x: x IS NOT NULL)) < len(list_filter(seen, lambda x: x IS NOT NULL)) THEN 1 ELSE 0 END AS g, CASE WHEN kind = 'join' THEN 'ok' WHEN old AND generation + CASE WHEN len(list_filter(live, lambda x: x IS NOT NULL)) < len(list_filter(seen, lambda x: x IS NOT NULL)) THEN 1 ELSE 0 END <> 0 THEN 'stale' WHEN live[m] IS NULL THEN 'unknown' ELSE 'ok' END AS outcome
   FROM (SELECT f.group_id, e.i, e.seq, e.at_, e.kind, e.m, e.old, f.generation, f.seen, list_transform(f.seen, lambda x: CASE WHEN e.at_ - x < 604800000 THEN x END) AS live FROM f JOIN e ON e.group_id = f.group_id AND e.i = f.i + 1)))
 SELECT group_id, seq, outcome, generation, list_transform(list_filter(range(1, 11), lambda k: seen[k] IS NOT NULL), lambda k: 'm' || (k - 1)) AS members FROM f WHERE i > 0"""

#: A broker's share of disk differs from the others' by more than moves change, so the fullest is the greatest id.
PLC_MOVES = """WITH e AS (SELECT CAST(c_nationkey AS VARCHAR) AS cluster, c_mktsegment AS stream, CAST(c_custkey AS INTEGER) AS part, [CAST((c_custkey + i) % 6 + 1 AS INTEGER) FOR i IN [0, 1, 3]] AS r FROM customer),
 m AS (SELECT *, list_max(r) AS src FROM e), d AS (SELECT *, list_min(list_filter([1, 3, 4, 5, 6]::INTEGER[], lambda n: NOT list_contains(r, n) AND (n % 3 = src % 3 OR len(list_distinct(list_transform(r, lambda x: x % 3))) >= 2))) AS dst FROM m)
 SELECT cluster, stream, part, src, dst FROM d WHERE dst < src"""

#: The steps of a transaction lie within 40 keys, so the state holds the present one's producers, and of the others how many are live.
#: A step before any begin of its transaction is unknown whatever came before, and takes no turn.
TXN_FOLD = """WITH RECURSIVE r AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS p, CAST(o_orderkey AS BIGINT) AS seq, ['begin', 'write', 'write', 'prepare', 'commit', 'write', 'abort'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS kind, CAST(o_orderkey // 40 AS BIGINT) AS txn, CAST(o_orderkey // 2000 AS BIGINT) AS epoch, CAST(o_orderkey * 10 AS BIGINT) AS ts, CAST(o_orderkey % 5 AS BIGINT) AS part, CAST(o_orderkey % 50 AS BIGINT) AS bytes FROM orders),
 u AS (SELECT *, bool_or(kind = 'begin') OVER (PARTITION BY p, txn ORDER BY seq ROWS UNBOUNDED PRECEDING) AS begun FROM r), e AS (SELECT * EXCLUDE (begun), row_number() OVER (ORDER BY seq) AS i FROM u WHERE begun),
 f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS producer, 0::BIGINT AS seq, ''::VARCHAR AS outcome, -1::BIGINT AS cur, 0::BIGINT AS live, list_transform(range(50), lambda x: 0::BIGINT) AS epochs, list_transform(range(50), lambda x: 0::BIGINT) AS lives,
   []::STRUCT(p BIGINT, epoch BIGINT, status VARCHAR, deadline BIGINT, n BIGINT, bytes BIGINT, parts BIGINT[])[] AS known UNION ALL
  SELECT i, p, seq, outcome, txn, live - gone + started - ended, CASE WHEN bump THEN list_transform(epochs, lambda x, j: CASE WHEN j = p + 1 THEN epoch ELSE x END) ELSE epochs END,
   CASE WHEN bump OR started + ended > 0 THEN list_transform(lives, lambda x, j: CASE WHEN j = p + 1 THEN x - gone + started - ended ELSE x END) ELSE lives END,
   CASE WHEN started > 0 THEN list_append(kn, {'p': p, 'epoch': epoch, 'status': 'open', 'deadline': ts + 5000, 'n': 0::BIGINT, 'bytes': 0::BIGINT, 'parts': []::BIGINT[]}) WHEN outcome <> 'ok' OR kind = 'begin' THEN kn
    ELSE list_transform(kn, lambda x: CASE WHEN x.p <> p THEN x WHEN kind = 'write' THEN {'p': x.p, 'epoch': x.epoch, 'status': x.status, 'deadline': x.deadline, 'n': x.n + 1, 'bytes': x.bytes + bytes, 'parts': list_distinct(list_append(x.parts, part))}
     ELSE {'p': x.p, 'epoch': x.epoch, 'status': CASE kind WHEN 'prepare' THEN 'prepared' WHEN 'commit' THEN 'committed' ELSE 'aborted' END, 'deadline': x.deadline, 'n': x.n, 'bytes': x.bytes, 'parts': x.parts} END) END
  FROM (SELECT *, CASE WHEN kind = 'begin' AND me IS NULL AND outcome = 'ok' THEN 1 ELSE 0 END AS started, CASE WHEN kind IN ('commit', 'abort') AND outcome = 'ok' THEN 1 ELSE 0 END AS ended
   FROM (SELECT *, CASE WHEN kind = 'begin' THEN CASE WHEN me IS NOT NULL THEN CASE WHEN me.epoch = epoch THEN 'ok' ELSE 'reused' END WHEN epoch < epochs[p + 1] THEN 'fenced' WHEN live - gone >= 100 THEN 'too many' ELSE 'ok' END
     WHEN me IS NULL THEN 'unknown' WHEN kind = 'abort' THEN CASE WHEN me.status IN ('open', 'prepared') THEN 'ok' ELSE 'terminal' END WHEN ts > me.deadline THEN 'timed out'
     WHEN kind = 'commit' THEN CASE WHEN me.status = 'prepared' THEN 'ok' ELSE 'not prepared' END WHEN me.status <> 'open' THEN 'not open' WHEN kind = 'prepare' THEN 'ok'
     WHEN me.n >= 5 THEN 'messages' WHEN me.bytes + bytes > 150 THEN 'bytes' WHEN len(list_distinct(list_append(me.parts, part))) > 3 THEN 'partitions' ELSE 'ok' END AS outcome
    FROM (SELECT *, kind = 'begin' AND me IS NULL AND epoch > epochs[p + 1] AS bump, CASE WHEN kind = 'begin' AND me IS NULL AND epoch > epochs[p + 1] THEN lives[p + 1] ELSE 0 END AS gone
     FROM (SELECT *, list_filter(kn, lambda x: x.p = p)[1] AS me FROM (SELECT e.*, live, epochs, lives, CASE WHEN cur = txn THEN known ELSE [] END AS kn FROM f JOIN e ON e.i = f.i + 1))))))
 SELECT producer, seq, outcome FROM f WHERE i > 0 UNION ALL SELECT p, seq, 'unknown' FROM u WHERE NOT begun"""
