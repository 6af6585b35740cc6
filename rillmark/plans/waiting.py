"""Queries of shared commits, waiting fetches, stream timers and versioned keys; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import sealing
from rillmark.operators import waiting
from rillmark.plans.queries import _LOG, _log
from rillmark.sources import events as ev
from rillmark.streaming import log as stream

_FLUSH_MS = 6 * 3_600_000


def bat_shared_commits(s, d):
    """Flushes that appended messages share, by partition."""
    return waiting.shared_commits(_log(s, d).select("stream", "part", F.col("ts_ms").alias("at_ms")), _FLUSH_MS)


BAT_SHARED_COMMITS = (
    _LOG.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", st AS (SELECT stream, part, min(ts_ms) AS started_ms FROM log GROUP BY 1, 2 UNION ALL
  SELECT st.stream, st.part, min(ts_ms) FROM st JOIN log ON log.stream = st.stream AND log.part = st.part AND ts_ms > started_ms + {_FLUSH_MS} GROUP BY 1, 2, started_ms)
 SELECT stream, part, started_ms, started_ms + {_FLUSH_MS} AS flushed_ms, count(*) AS waiters FROM log JOIN st USING (stream, part) WHERE ts_ms BETWEEN started_ms AND started_ms + {_FLUSH_MS} GROUP BY 1, 2, 3"""
)

_TOPICS = ("click", "purchase", "signup", "error")


def dlv_waiting_fetch(s, d):
    """Events as fetches by ten connections of five consumers that wait for another type's next event, one a consumer at a time."""
    e = ev.table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    fetches = e.select(
        F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("event_id") % 4 + 1).cast("int")).alias("topic"), (F.col("user_id") % 5).alias("consumer"), (F.col("user_id") % 10).alias("connection"),
        F.col("event_id").alias("id"), F.col("ts_ms").alias("at_ms"), (F.col("event_id") % 8 * 50_000).alias("wait_ms"))
    return waiting.admitted(waiting.woken(fetches, e.select(F.col("event_type").alias("topic"), "ts_ms")), 1)


DLV_WAITING_FETCH = f"""WITH RECURSIVE m AS (SELECT event_type AS topic, epoch_us(ts) // 1000 AS ts_ms FROM events), q AS (SELECT {list(_TOPICS)}[CAST(event_id % 4 + 1 AS INTEGER)] AS topic, user_id % 5 AS consumer, user_id % 10 AS connection, event_id AS id, epoch_us(ts) // 1000 AS at_ms, event_id % 8 * 50000 AS wait_ms FROM events),
 w AS (SELECT consumer, connection, id, at_ms, wait_ms, min(ts_ms) AS woken_ms FROM q LEFT JOIN m ON m.topic = q.topic AND ts_ms > at_ms AND ts_ms <= at_ms + wait_ms GROUP BY ALL),
 e AS (SELECT *, coalesce(woken_ms, at_ms + wait_ms) AS stop, row_number() OVER (PARTITION BY consumer ORDER BY at_ms, id) AS i FROM w),
 f AS (SELECT consumer, 0::BIGINT AS i, 0::BIGINT AS id, ''::VARCHAR AS outcome, 0::BIGINT AS ended_ms, NULL::BIGINT AS busy, 0::BIGINT AS until FROM (SELECT DISTINCT consumer FROM e) UNION ALL
  SELECT consumer, i, id, outcome, CASE WHEN outcome IN ('woken', 'timed_out') THEN stop ELSE at_ms END, CASE WHEN outcome IN ('woken', 'timed_out') THEN connection ELSE busy END, CASE WHEN outcome IN ('woken', 'timed_out') THEN stop ELSE until END
  FROM (SELECT e.*, busy, until, CASE WHEN wait_ms > 300000 THEN 'wait_too_long' WHEN wait_ms = 0 THEN 'at_once' WHEN until > at_ms AND busy = connection THEN 'connection_waits' WHEN until > at_ms THEN 'consumer_full' WHEN woken_ms IS NULL THEN 'timed_out' ELSE 'woken' END AS outcome FROM f JOIN e ON e.consumer = f.consumer AND e.i = f.i + 1))
 SELECT consumer, id, outcome, ended_ms FROM f WHERE i > 0"""


def stm_timers(s, d):
    """A stream of orders as leases, acknowledged by their items' shipping: those that run out, once both streams are past them."""
    # The files of one table aren't in the order of time: one batch takes them all, so that none is late.
    leases = stream.read(s, d, "orders", 1 << 30).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    acks = stream.read(s, d, "lineitem", 1 << 30).select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    got = stream.drained(waiting.run_out(leases, acks, "500 DAYS 12 HOURS", "10 days"), "timers")
    return got.select(F.col("id").alias("o_orderkey"), F.unix_millis("at").alias("leased_ms"))


STM_TIMERS = """SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS leased_ms FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 500 DAY + INTERVAL 12 HOUR)
 AND o_orderdate + INTERVAL 500 DAY + INTERVAL 12 HOUR < least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 10 DAY"""

_RING = {v: bytes(range(v, v + 32)) for v in (1, 2, 3)}


def enc_versions(s, d):
    """Payloads sealed under three keys: read with a ring that has lost the first, and some under another user's name."""
    e = ev.table(s, d, "events").select("event_id", "props", F.col("user_id").cast("string").cast("binary").alias("aad"))
    nonce = F.unhex(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 24))
    sealed = e.select("event_id", "aad", sealing.seal(F.col("props").cast("binary"), _RING, nonce, F.col("aad"), (F.col("event_id") % 3 + 1).cast("int")).alias("sealed"))
    said = F.when(F.col("event_id") % 10 == 4, F.lit(b"somebody")).otherwise(F.col("aad"))
    return sealed.select("event_id", F.col("sealed.key_version").alias("key_version"), sealing.unseal(F.col("sealed"), {v: k for v, k in _RING.items() if v > 1}, said).cast("string").alias("props"))


ENC_VERSIONS = "SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS key_version, CASE WHEN event_id % 3 > 0 AND event_id % 10 <> 4 THEN props END AS props FROM events"

ALL = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (bat_shared_commits, dlv_waiting_fetch, stm_timers, enc_versions)}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items()}
