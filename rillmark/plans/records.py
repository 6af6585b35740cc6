"""Queries of budgets, registries, storage and metrics; SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import subjects
from rillmark.operators import consumption, ledgers, lifecycle, routing
from rillmark.plans import foldsql
from rillmark.plans.control import BROKERS
from rillmark.plans.queries import _LOG, _MSG, AGE, NOW, PATTERNS, _log, _messages, _like
from rillmark.sources import events as ev

TRACE = "^[0-9A-Fa-f]{2}-[0-9A-Fa-f]{32}-[0-9A-Fa-f]{16}-[0-9A-Fa-f]{2}$"


def flt_traceparent(s, d):
    """Which trace headers are valid: 55 characters, dashes at their places, hex elsewhere."""
    k = F.sha2(F.col("o_orderkey").cast("string"), 256)
    header = F.concat(F.lit("00-"), F.substring(k, 1, 32), F.when(F.col("o_orderkey") % 5 == 0, "_").otherwise("-"), F.substring(k, 33, 16), F.lit("-01"))
    return ev.table(s, d, "orders").select("o_orderkey", header.rlike(TRACE).alias("ok"))


FLT_TRACEPARENT = "SELECT o_orderkey, o_orderkey % 5 <> 0 AS ok FROM orders"


def flt_assigned_partitions(s, d):
    """Rows of the partitions that a group has given to one member."""
    mine = consumption.assigned(8, ev.table(s, d, "region").select(F.lit("g").alias("grp"), F.col("r_name").alias("member")), "range").filter("member = 'ASIA'")
    return _log(s, d).join(mine.select("part"), "part", "left_semi").groupBy("stream", "part").agg(F.count("*").alias("n"))


FLT_ASSIGNED_PARTITIONS = _LOG + ", m AS (SELECT list_sort(list(DISTINCT r_name)) AS m FROM region) SELECT stream, part, count(*) AS n FROM log, m WHERE m[part * len(m) // 8 + 1] = 'ASIA' GROUP BY 1, 2"


def flt_below_floor(s, d):
    """Rows that age retention has let go."""
    return lifecycle.age_floor(_log(s, d), NOW, AGE).filter("off < floor").select("stream", "part", "off")


FLT_BELOW_FLOOR = _LOG + f", f AS (SELECT stream, part, coalesce(min(CASE WHEN {NOW} - ts_ms <= {AGE} THEN off END), max(off) + 1) AS fl FROM log GROUP BY 1, 2) SELECT stream, part, off FROM log JOIN f USING (stream, part) WHERE off < fl"


def ret_released_bytes(s, d):
    """Bytes that retention gives back to each tenant."""
    return lifecycle.age_floor(_log(s, d), NOW, AGE).filter("off < floor").groupBy(F.split_part("subject", F.lit("/"), F.lit(2)).alias("tenant")).agg(F.sum("bytes").alias("released"))


RET_RELEASED_BYTES = FLT_BELOW_FLOOR.replace("SELECT stream, part, off FROM log JOIN", "SELECT event_type AS tenant, CAST(sum(bytes) AS BIGINT) AS released FROM log JOIN") + " GROUP BY 1"


def vw_projection(s, d):
    """A view of one pattern's messages, keyed by subject."""
    rows = _log(s, d).filter(subjects.matches(F.col("subject"), "events/purchase/**"))
    return lifecycle.view(rows, "subject", "payload").select("subject", "payload", "off")


VW_PROJECTION = _LOG + f" SELECT subject, arg_max(payload, part::BIGINT * 1000000000 + off) AS payload, CAST(arg_max(off, part::BIGINT * 1000000000 + off) AS BIGINT) AS off FROM log WHERE {_like('events/purchase/**')} GROUP BY 1"


def ord_page_status(s, d):
    """A page's bounds for each stream: total, count, and where the next page begins (null at the end)."""
    total = _log(s, d).groupBy("stream").agg(F.count("*").alias("total"))
    count = F.greatest(F.least(F.lit(100), F.col("total") - 200), F.lit(0))
    return total.select("stream", "total", count.alias("n"), F.when(F.col("total") > 300, 300).cast("long").alias("next_offset"))


ORD_PAGE_STATUS = _LOG + ", t AS (SELECT stream, count(*) AS total FROM log GROUP BY 1) SELECT stream, total, greatest(least(100, total - 200), 0) AS n, CAST(CASE WHEN total > 300 THEN 300 END AS BIGINT) AS next_offset FROM t"


def ord_turn(s, d):
    """One push turn of each of four nodes, 64 deliveries or 5,000 bytes."""
    ready = _log(s, d).select((F.col("user_id") % 4).alias("node"), F.col("event_type").alias("consumer"), "seq", "bytes")
    return ledgers.turn(ready, 64, 5000).select("node", "consumer", "seq")


ORD_TURN = _LOG + ", w AS (SELECT user_id % 4 AS node, event_type AS consumer, seq, count(*) OVER x AS n, sum(bytes) OVER x AS b FROM log WINDOW x AS (PARTITION BY user_id % 4 ORDER BY event_type, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT node, consumer, seq FROM w WHERE n < 64 AND coalesce(b, 0) < 5000"


def dlv_scheduled_due(s, d):
    """The first messages that have come due, oldest first, within a bound per user."""
    w = Window.partitionBy("user_id").orderBy("at_ms", "seq")
    due = _messages(s, d).select("user_id", "seq", (F.col("ts_ms") + F.col("seq") % 7 * 86_400_000).alias("at_ms")).filter(F.col("at_ms") <= NOW - AGE)
    return due.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("user_id", "seq", "at_ms")


DLV_SCHEDULED_DUE = f"WITH {_MSG}, d AS (SELECT user_id, seq, ts_ms + seq % 7 * 86400000 AS at_ms FROM msg) SELECT user_id, seq, at_ms FROM d WHERE at_ms <= {NOW - AGE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_ms, seq) <= 3"


def dlv_replay(s, d):
    """The dead letters left after a replay takes some; what is replayed starts with attempt 1."""
    dead = _messages(s, d).filter("seq % 7 >= 5").select("seq", (F.col("seq") % 7 + 1).alias("attempt"))
    replayed = dead.filter("seq % 2 = 0").select("seq", F.lit(1).cast("long").alias("attempt"), F.lit("replayed").alias("state"))
    return dead.join(replayed, "seq", "left_anti").withColumn("state", F.lit("dead")).unionByName(replayed)


DLV_REPLAY = f"WITH {_MSG} SELECT seq, CASE WHEN seq % 2 = 0 THEN 1 ELSE seq % 7 + 1 END AS attempt, CASE WHEN seq % 2 = 0 THEN 'replayed' ELSE 'dead' END AS state FROM msg WHERE seq % 7 >= 5"


def dlv_auto_ack(s, d):
    """Cursors where a dropped row counts as acknowledged."""
    return consumption.committed(_log(s, d), F.lit(True), (F.col("off") % 97 != 96) | (F.col("event_type") == "view"))


DLV_AUTO_ACK = _LOG + ", g AS (SELECT stream, part, min(CASE WHEN off % 97 = 96 AND event_type <> 'view' THEN off END) AS gap FROM log GROUP BY 1, 2) SELECT g.stream, g.part, coalesce(max(CASE WHEN gap IS NULL OR off < gap THEN off END) + 1, 0) AS committed FROM g JOIN log ON g.stream = log.stream AND g.part = log.part GROUP BY 1, 2"


def grp_moved(s, d):
    """Partitions that change hands when a group goes from range to round robin."""
    members = ev.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("grp"), F.col("n_name").alias("member"))
    before, after = (consumption.assigned(16, members, how) for how in ("range", "robin"))
    return after.join(before, ["grp", "part", "member"], "left_anti").select("grp", "part", "member")


GRP_MOVED = "WITH m AS (SELECT 'g' || n_regionkey AS grp, list_sort(list(DISTINCT n_name)) AS m FROM nation GROUP BY 1), p AS (SELECT grp, m, CAST(unnest(range(16)) AS INTEGER) AS part FROM m) SELECT grp, part, m[part % len(m) + 1] AS member FROM p WHERE m[part % len(m) + 1] <> m[part * len(m) // 16 + 1]"


def txn_prune(s, d):
    """Finished transactions that a checkpoint drops: all but the greatest ids, 16 for each that may be open, 64 at least."""
    done = ev.table(s, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("txn"))
    return ledgers.pruned(done, 5)


TXN_PRUNE = "SELECT o_orderkey AS txn FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) > 80"


def jn_dangling(s, d):
    """References whose row is gone or says otherwise."""
    refs = ev.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 3).alias("epoch"))
    held = ev.table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 - F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("held"))
    both = refs.join(held, "l_orderkey", "left")
    return both.filter(F.col("held").isNull() | (F.col("held") != F.col("epoch"))).select("l_orderkey", "l_linenumber", F.when(F.col("held").isNull(), "missing").otherwise("differs").alias("why"))


JN_DANGLING = "SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'differs' END AS why FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' WHERE o_orderkey IS NULL OR o_orderkey % 10 = 0"


def jn_mesh_peers(s, d):
    """Messages to forward, by peer: those that any of its interests matches, once."""
    peers = [("p1", "events/click/*"), ("p1", "events/*/7"), ("p2", "events/view/**"), ("p3", "nothing/**")]
    return routing.fan_out(_messages(s, d), peers).select("subscriber", "seq").distinct().groupBy(F.col("subscriber").alias("peer")).agg(F.count("*").alias("n"))


JN_MESH_PEERS = f"WITH {_MSG} SELECT * FROM (SELECT 'p1' AS peer, count(*) AS n FROM msg WHERE {_like('events/click/*')} OR {_like('events/*/7')} UNION ALL SELECT 'p2', count(*) FROM msg WHERE {_like('events/view/**')}) WHERE n > 0"


def jn_publish_allowed(s, d):
    """Messages by whether their user's allow-list has a matching pattern: even users may publish clicks and views."""
    some = subjects.matches(F.col("subject"), "events/click/*") | subjects.matches(F.col("subject"), "events/view/**")
    return _messages(s, d).groupBy("event_type", (some & (F.col("user_id") % 2 == 0)).alias("allowed")).agg(F.count("*").alias("n"))


JN_PUBLISH_ALLOWED = f"WITH {_MSG} SELECT event_type, event_type IN ('click', 'view') AND user_id % 2 = 0 AS allowed, count(*) AS n FROM msg GROUP BY 1, 2"


def jn_filter_streams(s, d):
    """The streams that each filter may touch."""
    rows = [(f, stream) for _, f in PATTERNS for stream, p in ev.BINDINGS if subjects.overlap(p, f)]
    return s.createDataFrame(rows, "filter string, stream string").distinct()


JN_FILTER_STREAMS = "SELECT * FROM (VALUES ('**', 'purchases'), ('**', 'telemetry'), ('events/click/*', 'telemetry'), ('events/purchase/**', 'purchases'), ('events/view/7', 'telemetry'), ('events/*/7', 'purchases'), ('events/*/7', 'telemetry'), ('events/**', 'purchases'), ('events/**', 'telemetry'), ('events/*', 'purchases'), ('events/*', 'telemetry')) AS t(filter, stream)"


def pt_sticky(s, d):
    """Round robin of what has no key, by a stream's running number."""
    w = Window.partitionBy("stream").orderBy("seq")
    return ev.bound(_messages(s, d)).filter("key is null").select("seq", "stream", ((F.row_number().over(w) - 1) % 8).alias("part"))


PT_STICKY = f"WITH {_MSG} SELECT seq, stream, CAST((row_number() OVER (PARTITION BY stream ORDER BY seq) - 1) % 8 AS INTEGER) AS part FROM msg WHERE key IS NULL"


def pt_expansion(s, d):
    """The partition count in force at each message; a message from an older epoch must refresh."""
    at = F.when(F.col("seq") >= 5000, 3).when(F.col("seq") >= 500, 2).otherwise(1)
    e = _messages(s, d).select("seq", at.alias("epoch"), (F.col("seq") % 3 + 1).alias("known"))
    return e.select("seq", "epoch", F.expr("shiftleft(4, epoch)").alias("partitions"), (F.col("known") < F.col("epoch")).alias("refresh"))


PT_EXPANSION = f"WITH {_MSG}, e AS (SELECT seq, CASE WHEN seq >= 5000 THEN 3 WHEN seq >= 500 THEN 2 ELSE 1 END AS epoch FROM msg) SELECT seq, epoch, CAST(4 << epoch AS INTEGER) AS partitions, seq % 3 + 1 < epoch AS refresh FROM e"


def _schemas(s, d) -> DataFrame:
    """Parts as schema versions of their brands; every seventh is deleted."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = ev.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.row_number().over(w).alias("version"), (F.col("p_partkey") % 7 == 0).alias("deleted"))


_SCHEMAS = "v AS (SELECT p_partkey AS id, p_brand AS subject, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS version, p_partkey % 7 = 0 AS deleted FROM part)"


def sch_versions(s, d):
    """The active versions of each subject: number, count with deleted ones, newest."""
    active = F.when(~F.col("deleted"), F.col("version"))
    return _schemas(s, d).groupBy("subject").agg(F.count(active).alias("active"), F.count("*").alias("numbered"), F.max(active).alias("newest"))


SCH_VERSIONS = f"WITH {_SCHEMAS} SELECT subject, count(*) FILTER (NOT deleted) AS active, count(*) AS numbered, max(version) FILTER (NOT deleted) AS newest FROM v GROUP BY 1"


def sch_lookup(s, d):
    """What each message's schema id leads to: ok, inactive, or another subject."""
    m = ev.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), F.col("l_partkey") % 11 == 0)
    m = m.toDF("l_orderkey", "l_linenumber", "id", "foreign")
    return m.join(_schemas(s, d).filter("not deleted"), "id", "left").select("l_orderkey", "l_linenumber", F.when(F.col("subject").isNull(), "inactive").when(F.col("foreign"), "other subject").otherwise("ok").alias("found"))


SCH_LOOKUP = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 OR p_partkey IS NULL THEN 'inactive' WHEN l_partkey % 11 = 0 THEN 'other subject' ELSE 'ok' END AS found FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"


def agg_quota_status(s, d):
    """Used, limit and rejections by tenant and dimension."""
    o = ev.table(s, d, "orders").groupBy((F.col("o_custkey") % 20).alias("tenant")).agg(F.count("*").alias("tasks"), F.sum(F.col("o_orderkey") % 7).alias("disk_bytes"))
    used = o.select("tenant", F.expr("stack(2, 'tasks', tasks, 'disk_bytes', disk_bytes) AS (dimension, used)"))
    limit = F.when(F.col("dimension") == "tasks", 90).otherwise(250).cast("long")
    return used.select("tenant", "dimension", "used", limit.alias("limit_"), F.greatest(F.col("used") - limit, F.lit(0)).alias("over"))


AGG_QUOTA_STATUS = "WITH o AS (SELECT o_custkey % 20 AS tenant, count(*) AS tasks, CAST(sum(o_orderkey % 7) AS BIGINT) AS disk_bytes FROM orders GROUP BY 1), u AS (SELECT tenant, 'tasks' AS dimension, tasks AS used, 90::BIGINT AS limit_ FROM o UNION ALL SELECT tenant, 'disk_bytes', disk_bytes, 250 FROM o) SELECT *, greatest(used - limit_, 0) AS over FROM u"


def agg_metrics(s, d):
    """The log's gauges and counters in long form: name, labels, value."""
    g = _log(s, d).groupBy("stream", "part").agg(F.count("*").alias("log_messages"), F.sum("bytes").alias("log_bytes"), (F.max("off") + 1).alias("log_next_offset"), F.count("key").alias("log_keyed"), F.max("ts_ms").alias("log_last_ms"))
    long = g.unpivot(["stream", "part"], [c for c in g.columns if c.startswith("log_")], "name", "value")
    return long.select("name", F.concat_ws(",", F.concat(F.lit("stream="), "stream"), F.concat(F.lit("part="), F.col("part").cast("string"))).alias("labels"), "value")


AGG_METRICS = _LOG + ", g AS (SELECT stream, part, count(*) AS log_messages, CAST(sum(bytes) AS BIGINT) AS log_bytes, max(off) + 1 AS log_next_offset, count(key) AS log_keyed, max(ts_ms) AS log_last_ms FROM log GROUP BY 1, 2), l AS (UNPIVOT g ON log_messages, log_bytes, log_next_offset, log_keyed, log_last_ms INTO NAME name VALUE value) SELECT name, 'stream=' || stream || ',part=' || part AS labels, value FROM l"


def src_tiered(s, d):
    """Local rows, and remote ones where none is local."""
    rows = _log(s, d).select("stream", "part", "off", "payload")
    local, remote = rows.filter("off % 3 <> 0").withColumn("tier", F.lit("local")), rows.filter("off % 2 = 0").withColumn("tier", F.lit("remote"))
    return local.unionByName(remote.join(local, ["stream", "part", "off"], "left_anti"))


SRC_TIERED = _LOG + " SELECT stream, part, off, payload, CASE WHEN off % 3 <> 0 THEN 'local' ELSE 'remote' END AS tier FROM log WHERE off % 3 <> 0 OR off % 2 = 0"


def snk_orphans(s, d):
    """Stored objects that no manifest names, with the bytes that cleaning frees."""
    stored = ev.table(s, d, "part").select(F.concat(F.lit("seg-"), F.col("p_partkey").cast("string")).alias("path"), F.octet_length("p_name").cast("long").alias("bytes"))
    named = ev.table(s, d, "lineitem").filter("l_partkey % 9 <> 4").select(F.concat(F.lit("seg-"), F.col("l_partkey").cast("string")).alias("path")).distinct()
    return stored.join(named, "path", "left_anti")


SNK_ORPHANS = "SELECT 'seg-' || p_partkey AS path, CAST(strlen(p_name) AS BIGINT) AS bytes FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 9 <> 4)"


def wal_replay(s, d):
    """Consumers after upserts and deletes, with their highest acknowledged order: the last record of a consumer decides."""
    o = ev.table(s, d, "orders").select((F.col("o_custkey") % 300).alias("consumer"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "delete").when(F.col("o_orderstatus") == "F", "ack").otherwise("upsert").alias("kind"))
    state = o.groupBy("consumer").agg(F.max(F.when(F.col("kind") == "upsert", F.col("seq"))).alias("defined"), F.max(F.when(F.col("kind") == "delete", F.col("seq"))).alias("gone"), F.max(F.when(F.col("kind") == "ack", F.col("seq"))).alias("acked"))
    return state.filter("defined > coalesce(gone, -1)").select("consumer", "defined", F.when(F.col("acked") > F.coalesce("gone", F.lit(-1)), F.col("acked")).alias("acked"))


WAL_REPLAY = "WITH s AS (SELECT o_custkey % 300 AS consumer, max(o_orderkey) FILTER (o_orderstatus = 'O') AS defined, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), -1) AS gone, max(o_orderkey) FILTER (o_orderstatus = 'F') AS acked FROM orders GROUP BY 1) SELECT consumer, defined, CASE WHEN acked > gone THEN acked END AS acked FROM s WHERE defined > gone"


def rbc_bindings(s, d):
    """Role bindings after replacements and revocations: the last change of a (subject, tenant), with its generation."""
    o = ev.table(s, d, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_custkey") % 7).alias("tenant"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "revoke").otherwise("bind").alias("kind"), F.col("o_orderpriority").alias("role"))
    last = o.groupBy("subject", "tenant").agg(F.max_by(F.struct("kind", "role"), "seq").alias("c"), F.count("*").alias("generation"))
    return last.filter("c.kind = 'bind'").select("subject", "tenant", "c.role", "generation")


RBC_BINDINGS = "SELECT o_custkey AS subject, o_custkey % 7 AS tenant, arg_max(o_orderpriority, o_orderkey) AS role, count(*) AS generation FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'"


def bat_ingress(s, d):
    """The log in batches of at most 20 records that close at 2,000 bytes."""
    return ledgers.ingress_batches(_log(s, d).select("stream", "part", "off", "bytes"), 20, 2000)


def snk_queue(s, d):
    """The log in a sink's batches of at most 20 records and 2,000 bytes."""
    return ledgers.connector_batches(_log(s, d).select("stream", "part", "off", "bytes"), 20, 2000)


def ord_credit(s, d):
    """Events as messages and grants of 100 consumers with four connections."""
    grant = F.col("event_id") % 5 == 0
    e = ev.table(s, d, "events").select((F.col("user_id") % 100).cast("long").alias("consumer"), F.col("event_id").cast("long").alias("seq"), F.when(grant, "grant").otherwise("message").alias("kind"), (F.col("event_id") / 5 % 4).cast("long").alias("connection"), F.lit(3).cast("long").alias("messages"), F.when(grant, 40).otherwise(F.octet_length("props")).cast("long").alias("bytes"))
    return ledgers.credited(e)


def qta_ledger(s, d):
    """Orders as reservations and releases of 100 tenants."""
    n = F.col("o_orderkey")
    kind = F.when(n % 4 == 1, "release").otherwise("reserve")
    rows = ev.table(s, d, "orders").select((F.col("o_custkey") % 100).cast("string").alias("tenant"), n.cast("long").alias("seq"), kind.alias("kind"), *[(n % m).cast("long").alias(c) for c, m in zip(ledgers.DIMENSIONS, (2, 700, 11_000, 3, 5))])
    return ledgers.quota_ledger(rows, {"connections": 5, "memory_bytes": 4000, "disk_bytes": 60_000, "tasks": 12, "background_tasks": 20})


def qta_moves(s, d):
    """Orders as moves that eight nodes start and finish, in windows."""
    n = F.col("o_orderkey")
    kind = F.when(n % 13 == 0, "reset").when(n % 3 == 0, "finish").otherwise("start")
    return ledgers.throttled(ev.table(s, d, "orders").select((n % 8).cast("long").alias("node"), n.cast("long").alias("seq"), kind.alias("kind"), (n % 100).cast("long").alias("bytes")), 3, 200)


def txn_fold(s, d):
    """Orders as steps of transactions of 50 producers."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("begin", "write", "write", "prepare", "commit", "write", "abort"))), (k % 7 + 1).cast("int"))
    rows = ev.table(s, d, "orders").select((F.col("o_custkey") % 50).cast("long").alias("producer"), k.cast("long").alias("seq"), kind.alias("kind"), F.floor(k / 40).alias("txn"), F.floor(k / 2000).alias("epoch"), (k * 10).cast("long").alias("ts_ms"), (k % 5).alias("partition"), (k % 50).alias("bytes"))
    return ledgers.transactions(rows, max_messages=5, max_bytes=150, max_partitions=3, max_duration_ms=5000, max_open=100)


def rep_roles(s, d):
    """Orders as role changes of 25 regions with guessed tokens."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("promote", "fence", "demote", "failover"))), (k % 4 + 1).cast("int"))
    return ledgers.region_roles(ev.table(s, d, "orders").select((F.col("o_custkey") % 25).cast("string").alias("region"), k.cast("long").alias("seq"), kind.alias("kind"), (k % 5).cast("long").alias("token"), (k % 20).cast("long").alias("lag")), 10)


def plc_phases(s, d):
    """Line items as progress reports of moves."""
    k = F.round(F.col("l_extendedprice") * 100)  # seldom the same twice in an order; there the SQL leaves the order open
    return ledgers.move_phases(ev.table(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), k.cast("long").alias("seq"), F.when(F.col("l_returnflag") == "A", "rollback").otherwise("advance").alias("kind"), (F.col("l_partkey") % 5 != 0).alias("quorum"), (F.col("l_suppkey") % 10 + 3).alias("match_offset"), F.lit(6).alias("high_watermark")))


def plc_transfers(s, d):
    """Customers as partitions of clusters by nation; the first replica leads."""
    k = F.col("c_custkey")
    replicas = F.array(*[((k + i) % 6 + 1).cast("int") for i in (0, 1, 3)])
    rows = ev.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_mktsegment").alias("stream"), k.cast("int").alias("part"), replicas.alias("replicas"), F.get(replicas, F.lit(0)).alias("leader"))
    return ledgers.leader_transfers(rows, [b | {"leaders": b["node"]} for b in BROKERS])


ALL = {
    f.__name__: (f, globals().get(f.__name__.upper()) or getattr(foldsql, f.__name__.upper(), None))
    for f in (flt_traceparent, flt_assigned_partitions, flt_below_floor, ret_released_bytes, vw_projection, ord_page_status, ord_turn, dlv_scheduled_due, dlv_replay, dlv_auto_ack, grp_moved, txn_prune, jn_dangling, jn_mesh_peers, jn_publish_allowed, jn_filter_streams, pt_sticky, pt_expansion, sch_versions, sch_lookup, agg_quota_status, agg_metrics, src_tiered, snk_orphans, wal_replay, rbc_bindings, bat_ingress, snk_queue, ord_credit, qta_ledger, qta_moves, txn_fold, rep_roles, plc_phases, plc_transfers)
}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
