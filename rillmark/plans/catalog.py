"""Queries of functions, names, routing to leaders, fenced groups, registrations, storage layout, middleware; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import hashing, scalars, workload
from rillmark.operators import budgets, compatibility, consumption, delivery, lifecycle, metadata, middleware, replay, routing, state
from rillmark.plans.control import _LEASES, DLV_NEXT_PULL, _leases, _pending
from rillmark.plans.queries import _FNV, _LOG, _MSG, _PRODUCERS, _TXN, NOW, _log, _messages, _producers, _samples, _txn
from rillmark.sources import events as ev
from rillmark.sources import storage

SEED, WRAP = 42, "18446744073709551616::HUGEINT"


def fn_workload(s, d):
    """A load generator's subject and key for each sequence."""
    k = F.col("o_orderkey")
    return ev.table(s, d, "orders").select("o_orderkey", workload.selected_subject("bench", k, 1000, SEED).alias("subject"), workload.selected_subject("bench", k, 7, SEED, "sequential").alias("in_turn"), workload.selected_key(k, 50, SEED).alias("key"))


FN_WORKLOAD = f"""WITH a AS (SELECT o_orderkey, xor(o_orderkey, {SEED})::HUGEINT AS v FROM orders), b AS (SELECT o_orderkey, xor(v, v // 4096) AS v FROM a), c AS (SELECT o_orderkey, xor(v, v * 33554432 % {WRAP}) AS v FROM b),
 e AS (SELECT o_orderkey, xor(v, v // 134217728) * {workload.MULTIPLIER}::HUGEINT % {WRAP} AS v FROM c) SELECT o_orderkey, 'bench/' || (v % 1000) AS subject, 'bench/' || (o_orderkey % 7) AS in_turn, 'key-' || (v % 50) AS key FROM e"""


def fn_pacing(s, d):
    return ev.table(s, d, "orders").select("o_orderkey", workload.pacing_delay_ns(F.col("o_orderkey"), 3, 700, 4).alias("delay_ns"), workload.pacing_delay_ns(F.col("o_orderkey"), 3, 0, 4).alias("pause_ns"))


FN_PACING = "SELECT o_orderkey, greatest(CAST(o_orderkey::HUGEINT * 3000000000 // 700 AS BIGINT), o_orderkey * 4000000) AS delay_ns, o_orderkey * 4000000 AS pause_ns FROM orders"


def fn_ack_subject(s, d):
    """Acknowledgement addresses, some of them spoiled, and what they are read as."""
    k = F.col("o_orderkey")
    made = workload.ack_subject(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), k, k * 2)
    spoiled = F.when(k % 5 == 0, F.concat(made, F.lit("/x"))).when(k % 5 == 1, F.replace(made, F.lit("_ACK"), F.lit("ACK"))).when(k % 5 == 2, F.concat(made, F.lit("z"))).otherwise(made)
    read = workload.parsed_ack_subject(F.col("subject"))
    return ev.table(s, d, "orders").select(spoiled.alias("subject")).select("subject", read["consumer"].alias("consumer"), read["seq"].alias("seq"), read["delivery"].alias("delivery"))


FN_ACK_SUBJECT = """WITH a AS (SELECT o_orderkey AS k, '_ACK/c' || o_custkey || '/' || o_orderkey || '/' || (o_orderkey * 2) AS m, 'c' || o_custkey AS c FROM orders)
 SELECT CASE k % 5 WHEN 0 THEN m || '/x' WHEN 1 THEN replace(m, '_ACK', 'ACK') WHEN 2 THEN m || 'z' ELSE m END AS subject, CASE WHEN k % 5 > 2 THEN c END AS consumer, CASE WHEN k % 5 > 2 THEN k END AS seq, CASE WHEN k % 5 > 2 THEN k * 2 END AS delivery FROM a"""


def fn_saturating(s, d):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return ev.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", workload.saturating_add(a, b, 5000).alias("added"), workload.saturating_sub(a, b).alias("taken"))


FN_SATURATING = "SELECT l_orderkey, l_linenumber, least(l_orderkey + l_partkey, 5000) AS added, greatest(l_orderkey - l_partkey, 0) AS taken FROM lineitem"


def fn_duration(s, d):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d"))), (k % 5 + 1).cast("int"))
    return ev.table(s, d, "orders").select("o_orderkey", scalars.duration_ms(F.concat(k.cast("string"), unit)).alias("ms"))


FN_DURATION = "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 1000 WHEN 2 THEN o_orderkey * 60000 WHEN 3 THEN o_orderkey * 3600000 END AS BIGINT) AS ms FROM orders"


def fn_crc32(s, d):
    return ev.table(s, d, "events").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


FN_CRC32 = "SELECT event_id, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(props, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x // 2, 3988292384 * (x % 2)))), 4294967295::BIGINT) AS BIGINT) AS crc FROM events"


def flt_message(s, d):
    """Which messages may be published, of subjects, reply addresses and header names that are sometimes wrong."""
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    subject, reply, name = pick(6, "a/b", "a>b/c", "a/*/c", "/a", "a b/c", "a"), pick(4, None, "in/box", "in box", ""), pick(5, "h", "h:x", "", "x y", "H-1")
    headers = F.array(F.struct(name.alias("name"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("v"))).alias("values")))
    return ev.table(s, d, "part").select("p_partkey", workload.valid_message(subject, reply, headers).alias("ok"))


FLT_MESSAGE = "SELECT p_partkey, p_partkey % 6 IN (0, 1, 5) AND p_partkey % 4 IN (0, 1) AND p_partkey % 5 IN (0, 4) AND p_partkey % 7 <> 0 AS ok FROM part"


def flt_names(s, d):
    n = F.element_at(F.array(*map(F.lit, ("ab", "_ab", "a.b", "a b", "", "é", "a" * 129))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return ev.table(s, d, "part").select("p_partkey", workload.valid_identifier(n).alias("identifier"), workload.valid_view_name(n).alias("view"))


FLT_NAMES = "SELECT p_partkey, p_partkey % 7 IN (0, 5, 6) AS identifier, p_partkey % 7 IN (0, 1, 2) AS view FROM part"


def pt_state_shard(s, d):
    """The shard that owns each user's state, by kind, and each partition's."""
    u = _messages(s, d).select("user_id").distinct()
    name, part = F.col("user_id").cast("string"), F.col("user_id") % 100
    return u.select("user_id", *[workload.state_shard(k, name, 16).alias(k) for k in ("consumer", "producer", "tenant")], workload.state_shard("partition", F.lit("telemetry"), 16, part).alias("partition"))


_BYTES = "list_reduce(list_concat([14695981039346656037::HUGEINT], {0}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
PT_STATE_SHARD = "WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, " + ", ".join(f"CAST({_FNV.format(f"'{k}:' || user_id")} % 16 AS INTEGER) AS {k}" for k in ("consumer", "producer", "tenant")) + ", CAST(" + _BYTES.format("list_concat(list_transform(string_split('telemetry', ''), lambda c: ascii(c)::HUGEINT), [0::HUGEINT, 0, 0, user_id % 100])") + " % 16 AS INTEGER) AS partition FROM u"


def pt_leaders(s, d):
    """A client's routing: each message's partition, and the node that leads it at first."""
    nodes = F.array(*[F.lit(n).cast("long") for n in (11, 22, 33)])
    part = hashing.partition_of(F.coalesce("key", "subject"), 8)
    leaders = s.range(8).select(F.col("id").cast("int").alias("part"), F.get(nodes, (F.col("id") % 3).cast("int")).alias("leader"))
    return _messages(s, d).select("seq", part.alias("part")).join(leaders, "part").groupBy("leader", "part").agg(F.count("*").alias("n"))


PT_LEADERS = _LOG + " SELECT CAST((part % 3 + 1) * 11 AS BIGINT) AS leader, part, count(*) AS n FROM log GROUP BY ALL"


def prj_envelope(s, d):
    """Log rows as envelopes and from these as a connector's records; what the broker put into headers stays behind."""
    headers = F.array(F.struct(F.lit("Trace-Id").alias("name"), F.col("seq").cast("string").alias("value")), F.struct(F.lit("x-EPOCH").alias("name"), F.lit("3").alias("value")))
    envelope = F.struct("stream", "part", "off", "subject", "key", "payload", scalars.without_headers(headers, ["X-Epoch"]).alias("headers"))
    e = _log(s, d).select(envelope.alias("e"))
    return e.select("e.stream", "e.part", "e.off", "e.subject", "e.key", "e.payload", F.array_join(F.transform("e.headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ",").alias("headers"))


PRJ_ENVELOPE = _LOG + " SELECT stream, part, off, subject, key, payload, 'Trace-Id=' || seq AS headers FROM log"


def rbc_snapshot(s, d):
    """What one tenant's scope holds: its bindings by role, with the role's permissions."""
    b = ev.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.when(F.col("c_custkey") % 3 == 0, "admin").when(F.col("c_custkey") % 3 == 1, "reader").otherwise("gone").alias("role")).agg(F.count("*").alias("bindings"))
    roles = s.createDataFrame([("admin", "read,write"), ("reader", "read"), ("unused", "none")], "role string, permissions string")
    return b.join(roles, "role", "left")


RBC_SNAPSHOT = "SELECT CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'reader' ELSE 'gone' END AS role, count(*) AS bindings, CASE c_custkey % 3 WHEN 0 THEN 'read,write' WHEN 1 THEN 'read' END AS permissions FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey % 3"


def aud_status(s, d):
    """Each tenant's audit records: how many, their bytes, the oldest and newest kept."""
    return _messages(s, d).groupBy(F.col("event_type").alias("tenant")).agg(F.count("*").alias("records"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("seq").alias("oldest"), F.max("seq").alias("newest"))


AUD_STATUS = f"WITH {_MSG} SELECT event_type AS tenant, count(*) AS records, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, min(seq) AS oldest, max(seq) AS newest FROM msg GROUP BY 1"


def agg_producers(s, d):
    """Remembered entries per producer and epoch, with the last sequence."""
    return state.deduplicated(_producers(s, d), 8).groupBy("producer", "epoch").agg(F.count("*").alias("entries"), F.max("sequence").alias("last"))


AGG_PRODUCERS = f"WITH p AS ({_PRODUCERS}) SELECT producer, epoch, least(count(*), 8) AS entries, max(sequence) AS last FROM p GROUP BY 1, 2"


def rep_committed(s, d):
    """Records that a majority holds."""
    log = _log(s, d)
    marks = log.groupBy("stream", "part").agg((F.max("off") - 3).alias("mark"))
    return log.join(marks, ["stream", "part"]).filter("off <= mark").groupBy("stream", "part").agg(F.count("*").alias("n"), F.max("off").alias("last"))


REP_COMMITTED = _LOG + ", m AS (SELECT stream, part, max(off) - 3 AS mark FROM log GROUP BY 1, 2) SELECT log.stream, log.part, count(*) AS n, max(off) AS last FROM log JOIN m ON log.stream = m.stream AND log.part = m.part AND off <= mark GROUP BY 1, 2"


def _commits(s, d) -> DataFrame:
    """Line items as commits of offsets by members of one group: generation, member, part."""
    return ev.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 16).cast("int").alias("part"), (F.lit(7) - F.when(F.col("l_suppkey") % 10 == 3, 1).otherwise(0)).cast("long").alias("generation"), F.get(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "nobody"))), (F.col("l_partkey") % 16 / 6).cast("int")).alias("member"), (F.col("l_orderkey") % 1000).alias("offset"))


def grp_commit_fenced(s, d):
    """Commits that count: of the present generation, by the partition's owner, above what is committed (0 never is)."""
    owners = consumption.assigned(16, ev.table(s, d, "region").select(F.lit("g").alias("grp"), F.col("r_name").alias("member")), "range").select("part", F.col("member").alias("owner"))
    return consumption.fenced_commits(_commits(s, d), owners, 7).groupBy("part", "outcome").agg(F.count("*").alias("n"), F.max("offset").alias("offset"))


GRP_COMMIT_FENCED = """WITH m AS (SELECT list_sort(list(DISTINCT r_name)) AS m FROM region), c AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_partkey % 16 AS INTEGER) AS part, l_suppkey % 10 <> 3 AS now, ['AFRICA', 'AMERICA', 'ASIA', 'nobody'][CAST(l_partkey % 16 // 6 + 1 AS INTEGER)] AS member, l_orderkey % 1000 AS offset_ FROM lineitem),
 o AS (SELECT c.*, now AND member = m[part * len(m) // 16 + 1] AS mine FROM c, m), r AS (SELECT *, coalesce(max(CASE WHEN mine THEN offset_ END) OVER (PARTITION BY part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
 SELECT part, CASE WHEN NOT now THEN 'stale generation' WHEN NOT mine THEN 'not the owner' WHEN offset_ > before THEN 'committed' ELSE 'unchanged' END AS outcome, count(*) AS n, max(offset_) AS "offset" FROM r GROUP BY 1, 2"""


def grp_sticky(s, d):
    """Partitions after a rebalance that moves as few as it can: before, every fifth had no owner and the others went round."""
    return budgets.sticky_assignment(_members(s, d), 16, lambda p, n: None if p % 5 == 4 else (p * p) % n)


def _members(s, d) -> DataFrame:
    return ev.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("grp"), F.col("n_name").alias("member"))


GRP_STICKY = """WITH RECURSIVE m AS (SELECT 'g' || n_regionkey AS grp, list_sort(list(DISTINCT n_name)) AS m FROM nation GROUP BY 1),
 f AS (SELECT grp, m, -1 AS part, list_transform(m, lambda x: 0) AS loads, 0 AS who FROM m UNION ALL
  SELECT grp, m, part + 1, list_transform(loads, lambda x, i: x + CASE WHEN i = w THEN 1 ELSE 0 END), w FROM (SELECT *, CASE WHEN (part + 1) % 5 <> 4 AND loads[CAST(((part + 1) * (part + 1)) % len(m) + 1 AS INTEGER)] < CAST(ceil(16 / len(m)) AS INTEGER) THEN CAST(((part + 1) * (part + 1)) % len(m) + 1 AS INTEGER) ELSE list_position(loads, list_min(loads)) END AS w FROM f WHERE part < 15))
 SELECT grp, part, m[who] AS member FROM f WHERE part >= 0"""


def grp_expand(s, d):
    """Requests for partition counts: a group only grows, and not above a limit."""
    rows = ev.table(s, d, "orders").select((F.col("o_custkey") % 40).alias("grp"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 97 + 1).alias("asked"))
    return consumption.expanded(rows, 90)


GRP_EXPAND = """WITH r AS (SELECT o_custkey % 40 AS grp, o_orderkey AS seq, o_orderkey % 97 + 1 AS asked FROM orders), b AS (SELECT *, coalesce(max(CASE WHEN asked <= 90 THEN asked END) OVER (PARTITION BY grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM r)
 SELECT grp, seq, CASE WHEN asked < before THEN 'decrease' WHEN asked > 90 THEN 'quota' WHEN asked = before THEN 'unchanged' ELSE 'expanded' END AS outcome, CASE WHEN asked BETWEEN before AND 90 THEN asked ELSE before END AS partitions FROM b"""


def cur_delivered(s, d):
    """The furthest offset delivered to each consumer, as it moves."""
    w = Window.partitionBy("stream", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _log(s, d).select("stream", "part", "seq", F.max(F.col("off") - F.col("seq") % 3).over(w).alias("delivered"))


CUR_DELIVERED = _LOG + " SELECT stream, part, seq, max(off - seq % 3) OVER (PARTITION BY stream, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS delivered FROM log"


def cur_ack_window(s, d):
    """Acknowledgements out of order with room for four beyond the committed offset."""
    a = ev.table(s, d, "events").select((F.col("user_id") % 50).cast("long").alias("consumer"), F.col("event_id").cast("long").alias("seq"), F.floor(F.col("event_id") / 60).cast("long").alias("base"), (F.col("event_id") % 7).cast("long").alias("jump"))
    return budgets.ack_window(a.select("consumer", "seq", (F.row_number().over(Window.partitionBy("consumer").orderBy("seq")) - 1 - F.col("jump") + 2 * (F.col("jump") % 3)).cast("long").alias("off")), 4)


CUR_ACK_WINDOW = """WITH RECURSIVE a AS (SELECT user_id % 50 AS consumer, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 - event_id % 7 + 2 * (event_id % 7 % 3) AS off FROM events),
 f AS (SELECT consumer, 0::BIGINT AS i, -1::BIGINT AS seq, ''::VARCHAR AS outcome, 0::BIGINT AS committed, []::BIGINT[] AS acked FROM (SELECT DISTINCT consumer FROM a) UNION ALL
  SELECT consumer, i, seq, outcome, c2, list_filter(acks, lambda x: x >= c2) FROM (SELECT *, CASE WHEN outcome = 'acked' AND list_contains(acks, committed) THEN coalesce(list_min(list_filter(list_transform(acks, lambda x: x + 1), lambda x: x > committed AND NOT list_contains(acks, x))), committed) ELSE committed END AS c2
   FROM (SELECT f.consumer, a.i, a.seq, f.committed, CASE WHEN off < f.committed THEN 'stale' WHEN list_contains(acked, off) OR len(acked) < 4 OR off = f.committed THEN 'acked' ELSE 'window' END AS outcome, CASE WHEN off >= f.committed AND (list_contains(acked, off) OR len(acked) < 4 OR off = f.committed) THEN list_distinct(list_append(acked, off)) ELSE acked END AS acks FROM f JOIN a ON a.consumer = f.consumer AND a.i = f.i + 1)))
 SELECT consumer, seq, outcome, committed FROM f WHERE i > 0"""


def dlv_nack(s, d):
    """Deadlines after a refusal: the delay asked for, else the retry policy's for the next attempt; too long a delay is an error."""
    asked = F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("seq") % 5 * 1000)
    policy = scalars.retry_delay(F.col("attempt") + 1, 100, 3000)
    ok = _leases(s, d).withColumn("asked", asked).filter("asked <= 3000")
    return ok.select("consumer", "seq", (F.lit(NOW) + F.when(F.col("asked") == 0, policy).otherwise(F.col("asked"))).alias("deadline_ms"))


DLV_NACK = f"{_LEASES}, a AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 5 * 1000 END AS asked FROM leases) SELECT consumer, seq, {NOW} + CASE WHEN asked = 0 THEN least(3000, 100 * (1::BIGINT << attempt)) ELSE asked END AS deadline_ms FROM a WHERE asked <= 3000"


def dlv_jitter(s, d):
    attempt = F.col("o_orderkey") % 20 + 1
    return ev.table(s, d, "orders").select("o_orderkey", workload.jittered(scalars.retry_delay(attempt, 100, 30_000), attempt, 20, 30_000).alias("delay"))


DLV_JITTER = "WITH a AS (SELECT o_orderkey, o_orderkey % 20 + 1 AS n, least(30000, 100 * (1::BIGINT << (o_orderkey % 20))) AS delay FROM orders) SELECT o_orderkey, greatest(0, least(30000, delay + (n * 1664525 + 1013904223) % (delay * 20 // 100 * 2 + 1) - delay * 20 // 100)) AS delay FROM a"


def dlv_grant(s, d):
    """Leases that one round of pulls grants."""
    return delivery.granted(delivery.next_pull(_leases(s, d), _pending(s, d), NOW, 100), NOW, 30_000, 7000)


DLV_GRANT = DLV_NEXT_PULL.replace("SELECT * FROM t WHERE seq IS NOT NULL", f"SELECT consumer, seq, 7000 + row_number() OVER (ORDER BY consumer) AS delivery_id, attempt, {NOW + 30_000} AS deadline_ms FROM t WHERE seq IS NOT NULL")


def qta_work(s, d):
    """Orders as starts and ends of work in three classes, each with a budget of records, bytes and concurrency."""
    n = F.col("o_orderkey")
    rows = ev.table(s, d, "orders").select((F.col("o_custkey") % 40).cast("long").alias("class"), n.cast("long").alias("seq"), F.when(n % 3 == 0, "release").otherwise("reserve").alias("kind"), (n % 11).cast("long").alias("records"), (n % 101).cast("long").alias("bytes"))
    return budgets.work_classes(rows, 30, 250, 4)


QTA_WORK = """WITH RECURSIVE e AS (SELECT o_custkey % 40 AS class, o_orderkey AS seq, o_orderkey % 3 = 0 AS rel, o_orderkey % 11 AS r, o_orderkey % 101 AS b, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT class, 0::BIGINT AS i, 0::BIGINT AS seq, false AS ok, 0::BIGINT AS records, 0::BIGINT AS bytes, 0::BIGINT AS concurrency FROM (SELECT DISTINCT class FROM e) UNION ALL
  SELECT class, i, seq, ok, CASE WHEN NOT ok THEN records WHEN rel THEN greatest(records - r, 0) ELSE records + r END, CASE WHEN NOT ok THEN bytes WHEN rel THEN greatest(bytes - b, 0) ELSE bytes + b END, CASE WHEN NOT ok THEN concurrency WHEN rel THEN greatest(concurrency - 1, 0) ELSE concurrency + 1 END
  FROM (SELECT f.class, e.i, e.seq, rel, r, b, records, bytes, concurrency, rel OR (records + r <= 30 AND bytes + b <= 250 AND concurrency + 1 <= 4) AS ok FROM f JOIN e ON e.class = f.class AND e.i = f.i + 1))
 SELECT class, seq, ok, records, bytes, concurrency FROM f WHERE i > 0"""


def sch_register(s, d):
    """Parts as registrations of JSON schemas under brands: what is compatible with the last one gets the next version."""
    k = F.col("p_partkey")
    rows = ev.table(s, d, "part").select(F.col("p_brand").alias("subject"), k.cast("long").alias("seq"), _json_definition(k).alias("definition"))
    return budgets.registered(rows).select("subject", "seq", "version")


def _json_definition(r):
    return F.concat(F.lit('{"required":['), F.when(r % 2 == 0, '"a"').otherwise('"a","b"'), F.lit('],"properties":{"a":{},"b":{'), F.when(r % 3 == 0, '"default":1').otherwise(""), F.lit("}}}"))


SCH_REGISTER = """WITH RECURSIVE e AS (SELECT p_brand AS subject, p_partkey AS seq, p_partkey % 2 = 1 AS req, p_partkey % 3 = 0 AS def, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
 f AS (SELECT subject, 0::BIGINT AS i, 0::BIGINT AS seq, false AS ok, NULL::BOOLEAN AS req, 0::BIGINT AS version FROM (SELECT DISTINCT subject FROM e) UNION ALL
  SELECT subject, i, seq, ok, CASE WHEN ok THEN nreq ELSE req END, version + CASE WHEN ok THEN 1 ELSE 0 END FROM (SELECT f.subject, e.i, e.seq, f.req, f.version, e.req AS nreq, f.req IS NULL OR NOT e.req OR f.req OR e.def AS ok FROM f JOIN e ON e.subject = f.subject AND e.i = f.i + 1))
 SELECT subject, seq, CASE WHEN ok THEN version END AS version FROM f WHERE i > 0"""


def sch_avro(s, d):
    """Avro records: a field may go only if none had it, and one that comes needs a default."""
    record = lambda r: F.concat(F.lit('{"type":"record","name":"r","fields":[{"name":"a","type":"int"}'), F.when(r % 2 == 1, F.concat(F.lit(',{"name":"b","type":"int"'), F.when(r % 3 == 0, ',"default":0').otherwise(""), F.lit("}"))).otherwise(""), F.lit("]}"))
    k = F.col("o_orderkey")
    return ev.table(s, d, "orders").select("o_orderkey", compatibility.compatible(F.lit("backward"), F.lit("avro"), record(k), F.lit("avro"), record(F.floor(k / 4))).alias("ok"))


SCH_AVRO = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey // 4) % 2 = 1 ELSE (o_orderkey // 4) % 2 = 0 OR (o_orderkey // 4) % 3 = 0 END AS ok FROM orders"


def sch_protobuf(s, d):
    """Protobuf messages: a number keeps its type and name."""
    message = lambda r: F.concat(F.lit("message M { int32 a = 1; "), F.when(r % 2 == 1, F.concat(F.lit("string "), F.when(r % 3 == 0, "c").otherwise("b"), F.lit(" = 2; "))).otherwise(""), F.lit("}"))
    k = F.col("o_orderkey")
    return ev.table(s, d, "orders").select("o_orderkey", compatibility.compatible(F.lit("backward"), F.lit("protobuf"), message(k), F.lit("protobuf"), message(F.floor(k / 4))).alias("ok"))


SCH_PROTOBUF = "SELECT o_orderkey, o_orderkey % 2 = 0 OR ((o_orderkey // 4) % 2 = 1 AND (o_orderkey % 3 = 0) = ((o_orderkey // 4) % 3 = 0)) AS ok FROM orders"


def src_replay(s, d):
    """The log written by stream and partition and replayed in order, with a torn last row left out."""
    path = storage.written_log(_log(s, d).select("stream", "part", "off", "seq", "subject", "payload"), "replay")
    return storage.replayed(s, path).select("stream", "part", "off", "seq")


SRC_REPLAY = _LOG + " SELECT stream, part, off, seq FROM log"


def src_assigned(s, d):
    """Only the folders of assigned partitions are opened."""
    path = storage.written_log(_log(s, d).select("stream", "part", "off", "seq", "subject", "payload"), "assigned")
    return storage.replayed(s, path, [("telemetry", 1), ("telemetry", 3), ("purchases", 0)]).groupBy("stream", "part").agg(F.count("*").alias("n"), F.max("off").alias("last"))


SRC_ASSIGNED = _LOG + " SELECT stream, part, count(*) AS n, max(off) AS last FROM log WHERE (stream = 'telemetry' AND part IN (1, 3)) OR (stream = 'purchases' AND part = 0) GROUP BY 1, 2"


def src_subject_offsets(s, d):
    """The offsets of one partition whose subjects match."""
    path = storage.written_log(_log(s, d).select("stream", "part", "off", "seq", "subject", "payload"), "subjects")
    return storage.matching_offsets(s, path, "telemetry", 2, "events/click/*")


SRC_SUBJECT_OFFSETS = _LOG + " SELECT off FROM log WHERE stream = 'telemetry' AND part = 2 AND event_type = 'click'"


def vw_apply(s, d):
    """Updates in the order they arrive; one whose offset is behind its partition's is late and changes nothing."""
    rows = _log(s, d).withColumn("arrival", F.col("seq") + F.when(F.col("seq") % 9 == 0, 60).otherwise(0))
    return lifecycle.applied(rows, "arrival").groupBy("stream", "part").agg(F.count("*").alias("applied"), F.max("off").alias("position"))


VW_APPLY = _LOG + ", a AS (SELECT *, seq + CASE WHEN seq % 9 = 0 THEN 60 ELSE 0 END AS arrival FROM log), b AS (SELECT *, max(off) OVER (PARTITION BY stream, part ORDER BY arrival, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT stream, part, count(*) AS applied, max(off) AS position FROM b WHERE top IS NULL OR off >= top GROUP BY 1, 2"


def vw_snapshot(s, d):
    """A view from its last checkpoint and the deltas after it: the same as a rebuild."""
    rows = ev.table(s, d, "orders").select((F.col("o_custkey") % 200).alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value"), F.col("o_orderkey").alias("off"))
    return lifecycle.restored(rows, 64).select("key", "value", "off")


VW_SNAPSHOT = "SELECT o_custkey % 200 AS key, arg_max(o_orderstatus, o_orderkey) AS value, max(o_orderkey) AS off FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'"


def cmp_superseded(s, d):
    """Rows that later ones of their key replace, and how often that starts a physical compaction."""
    return lifecycle.superseded(_log(s, d)).groupBy("stream", "part").agg(F.count("*").alias("superseded"), F.floor(F.count("*") / 64).alias("compactions"))


CMP_SUPERSEDED = _LOG + ", b AS (SELECT stream, part, off, lead(off) OVER (PARTITION BY stream, part, key ORDER BY off) AS later FROM log WHERE key IS NOT NULL) SELECT stream, part, count(*) AS superseded, count(*) // 64 AS compactions FROM b WHERE later IS NOT NULL GROUP BY 1, 2"


def _checked(m: dict):
    if m["user_id"] % 11 == 0:
        raise ValueError("no")
    if m["user_id"] % 5 == 0:
        return "reject", {}, []
    return "continue", {"payload": m["payload"].upper()}, [{"subject": "audit", "payload": m["subject"]}]


def _moved(m: dict):
    return ("drop", {}, []) if m["user_id"] % 7 == 0 else ("continue", {"subject": m["subject"] + "/seen"}, [])


def udf_pipeline(s, d):
    """Two modules over clicks and everything: rejections, drops, changes, additions, and failures that let messages pass."""
    registry = middleware.Registry()
    registry.install([middleware.Module("check", "ingress", "events/click/*", _checked, "open"), middleware.Module("move", "ingress", "events/**", _moved)])
    registry.install([])
    registry.rollback()
    return middleware.applied(_messages(s, d).select("seq", "subject", "payload", "user_id"), registry, "ingress").select("seq", "subject", "payload", "decision", "generation", F.size("emitted").alias("emitted"))


UDF_PIPELINE = f"""WITH {_MSG}, a AS (SELECT *, event_type = 'click' AS c, event_type = 'click' AND user_id % 11 = 0 AS failed, event_type = 'click' AND user_id % 11 <> 0 AND user_id % 5 = 0 AS rejected FROM msg)
 SELECT seq, CASE WHEN failed OR rejected OR user_id % 7 = 0 THEN subject ELSE subject || '/seen' END AS subject, CASE WHEN c AND NOT failed AND NOT rejected THEN upper(payload) ELSE payload END AS payload, CASE WHEN failed THEN 'continue' WHEN rejected THEN 'reject' WHEN user_id % 7 = 0 THEN 'drop' ELSE 'continue' END AS decision, 1::BIGINT AS generation, CASE WHEN c AND NOT failed AND NOT rejected THEN 1 ELSE 0 END AS emitted FROM a"""


def jn_large_index(s, d):
    """3,000 subjects against 10,000 mixed patterns: how many match each."""
    n = F.col("id")
    subjects = s.range(3000).select(n.alias("seq"), F.concat(F.lit("s"), (n % 97).cast("string"), F.lit("/t"), (n % 1009).cast("string"), F.lit("/u"), (n % 31).cast("string")).alias("subject"))
    patterns = [(f"p{i}", (f"s{i % 97}/t{i % 1009}/u{i % 31}", f"s{i % 97}/*/u{i % 31}", f"s{i % 97}/t{i % 1009}/**")[i % 3]) for i in range(10_000)]
    return routing.fan_out(subjects, patterns).groupBy("seq").agg(F.count("*").alias("n"))


JN_LARGE_INDEX = """WITH s AS (SELECT range AS seq, range % 97 AS a, range % 1009 AS b, range % 31 AS c FROM range(3000)), p AS (SELECT range % 3 AS k, range % 97 AS a, range % 1009 AS b, range % 31 AS c FROM range(10000))
 SELECT seq, count(*) AS n FROM s JOIN p ON s.a = p.a AND (k = 1 OR s.b = p.b) AND (k = 2 OR s.c = p.c) GROUP BY 1"""

def agg_consumer_load(s, d):
    """Each consumer's pending messages, those in flight, and the lag that both make."""
    held = _leases(s, d).groupBy("consumer").agg(F.count("*").alias("in_flight"))
    waiting = _pending(s, d).groupBy("consumer").agg(F.count("*").alias("pending"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return held.join(waiting, "consumer", "full").select("consumer", n("in_flight").alias("in_flight"), n("pending").alias("pending"), (n("in_flight") + n("pending")).alias("lag"))


AGG_CONSUMER_LOAD = f"{_LEASES}, a AS (SELECT consumer, 1 AS f, 0 AS p FROM leases UNION ALL SELECT consumer, 0, 1 FROM pending) SELECT consumer, CAST(sum(f) AS BIGINT) AS in_flight, CAST(sum(p) AS BIGINT) AS pending, count(*) AS lag FROM a GROUP BY 1"


def agg_rates(s, d):
    """Messages and MiB a second over all, by role, and by role and client; no time gives no rate."""
    t = state.throughput(_samples(s, d))
    per = lambda c, unit: F.round(F.when(F.col("elapsed") > 0, F.col(c) / unit * 1_000_000 / F.col("elapsed")).otherwise(0.0), 4)
    return t.select("role", "client", per("ops", 1).alias("messages_s"), per("bytes", 1 << 20).alias("mib_s"))


AGG_RATES = "SELECT l_returnflag AS role, l_linestatus AS client, round(count(*) * 1000000.0e0 / max(l_extendedprice), 4) AS messages_s, round(sum(l_quantity) / 1048576.0e0 * 1000000 / max(l_extendedprice), 4) AS mib_s FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))"


def agg_latency_buckets(s, d):
    """A cumulative histogram in long form, with its sum and count."""
    v = F.col("elapsed")
    sums = _samples(s, d).agg(F.round(F.sum(v), 2).alias("sum"), F.count("*").cast("double").alias("count"))
    return state.histogram(_samples(s, d), v).select("le", F.col("n").cast("double").alias("value")).unionByName(sums.select(F.expr("stack(2, 'sum', sum, 'count', count) as (le, value)")))


AGG_LATENCY_BUCKETS = "SELECT unnest(['9', '99', '999', '9999', '99999', '+Inf', 'sum', 'count']) AS le, unnest([count(*) FILTER (e <= 9), count(*) FILTER (e <= 99), count(*) FILTER (e <= 999), count(*) FILTER (e <= 9999), count(*) FILTER (e <= 99999), count(*), round(sum(e), 2), count(*)]::DOUBLE[]) AS value FROM (SELECT l_extendedprice AS e FROM lineitem)"


def jn_allow_list(s, d):
    """Messages by whether their client's allow-list, a table of patterns, has one that matches."""
    patterns = [("c0", "events/click/*"), ("c0", "events/view/**"), ("c1", "events/view/**"), ("c1", "events/purchase/**"), ("c2", "events/*/7"), ("c3", "events/click/*")]
    m = _messages(s, d).withColumn("client", F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")))
    allowed = routing.fan_out(m, patterns).filter("subscriber = client").select("seq").distinct().withColumn("_ok", F.lit(True))
    return m.join(allowed, "seq", "left").groupBy("client", F.coalesce("_ok", F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"))


JN_ALLOW_LIST = f"""WITH {_MSG}, a AS (SELECT 'c' || (user_id % 5) AS client, CASE user_id % 5 WHEN 0 THEN event_type IN ('click', 'view') WHEN 1 THEN event_type IN ('view', 'purchase') WHEN 2 THEN user_id = 7 WHEN 3 THEN event_type = 'click' ELSE false END AS allowed FROM msg)
 SELECT client, allowed, count(*) AS n FROM a GROUP BY ALL"""


def pt_epochs(s, d):
    """The partition count in force at each message, from a table of changes: the last one at or before it."""
    changes = s.createDataFrame([(0, 1, 4), (300, 2, 8), (700, 3, 16)], "seq long, epoch long, partitions long")
    at = Window.partitionBy("stream").orderBy("seq", "_m").rowsBetween(Window.unboundedPreceding, 0)
    m = ev.bound(_messages(s, d)).select("stream", "seq", F.lit(None).cast("long").alias("epoch"), F.lit(None).cast("long").alias("partitions"), F.lit(1).alias("_m"))
    streams = s.createDataFrame([("purchases",), ("telemetry",)], "stream string")
    both = m.unionByName(streams.crossJoin(F.broadcast(changes)).withColumn("_m", F.lit(0)))  # two streams, three changes
    filled = both.select("stream", "seq", "_m", *[F.last(c, True).over(at).alias(c) for c in ("epoch", "partitions")])
    return filled.filter("_m = 1").select("stream", "seq", "epoch", "partitions", (F.col("seq") % 3 + 1 < F.col("epoch")).alias("refresh"))


PT_EPOCHS = f"WITH {_MSG}, c(at_, epoch, partitions) AS (VALUES (0, 1, 4), (300, 2, 8), (700, 3, 16)) SELECT stream, seq, CAST(epoch AS BIGINT) AS epoch, CAST(partitions AS BIGINT) AS partitions, seq % 3 + 1 < epoch AS refresh FROM msg ASOF JOIN c ON msg.seq >= c.at_"


def dlv_dead_admin(s, d):
    """Dead letters by consumer after old ones were purged: how many, the oldest, and the one that is read first."""
    dead = _leases(s, d).filter("attempt >= 4").select("consumer", "seq", "attempt", "deadline_ms")
    return delivery.dead_letters(dead, NOW - 2000).groupBy("consumer").agg(F.count("*").alias("n"), F.min("deadline_ms").alias("oldest"), F.min(F.struct("deadline_ms", "seq")).getField("seq").alias("first"))


DLV_DEAD_ADMIN = f"{_LEASES} SELECT consumer, count(*) AS n, min(deadline_ms) AS oldest, arg_min(seq, (deadline_ms, seq)) AS first FROM leases WHERE attempt >= 4 AND deadline_ms >= {NOW} - 2000 GROUP BY 1"


def ret_acks(s, d):
    """Cursors that retention overtakes: they move to the floor, count a gap, and forget acknowledgements below it."""
    floors = lifecycle.age_floor(_log(s, d), NOW, 12 * 86_400_000).groupBy("stream", "part").agg(F.first("floor").alias("floor"), F.max("off").alias("top"))
    cursors = floors.select("stream", "part", F.floor(F.col("top") / 3).alias("committed"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.floor(F.col("top") * i / 6)).alias("acked"))
    return consumption.floors_applied(cursors, floors.select("stream", "part", "floor"))


RET_ACKS = _LOG + f", f AS (SELECT stream, part, max(off) AS top, coalesce(min(CASE WHEN {NOW} - ts_ms <= {12 * 86_400_000} THEN off END), max(off) + 1) AS fl FROM log GROUP BY 1, 2) SELECT stream, part, greatest(top // 3, fl) AS committed, CAST(CASE WHEN top // 3 < fl THEN 1 ELSE 0 END AS BIGINT) AS gaps, len(list_filter([top // 6, top * 2 // 6, top * 3 // 6, top * 4 // 6, top * 5 // 6, top], lambda x: x >= greatest(top // 3, fl))) AS acked FROM f"


def vw_watch_status(s, d):
    """Watchers of a view that keeps 500 changes: what each still gets, or that its cursor has expired."""
    watchers = ev.table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 40).cast("long").alias("since"))
    first, last = F.greatest(F.max("seq") - 499, F.lit(1)), F.max("seq")
    window = _messages(s, d).agg(first.alias("first"), last.alias("last"))
    return lifecycle.watched(watchers, window).select("n_nationkey", "expired", "changes")


VW_WATCH_STATUS = f"WITH {_MSG}, w AS (SELECT greatest(max(seq) - 499, 1) AS first, max(seq) AS last FROM msg) SELECT n_nationkey, n_nationkey * 40 + 1 < first AS expired, CASE WHEN n_nationkey * 40 + 1 >= first THEN greatest(last - n_nationkey * 40, 0) END AS changes FROM nation, w"


def jn_catalog(s, d):
    """Streams that can't be in one catalog: a name twice, or two whose patterns may match one subject."""
    return routing.catalog_errors(s, [("a", "orders/**"), ("b", "orders/*/created"), ("a", "x"), ("c", "y/z"), ("d", "/bad"), ("e", "y/*/q")])


JN_CATALOG = "SELECT * FROM (VALUES ('a', 'duplicate'), ('a', 'overlap b'), ('d', 'invalid')) AS t(stream, error)"


def wal_state(s, d):
    """Orders as the twelve kinds of records: what a replay leaves of messages, consumers, deliveries, dead letters, producers and groups."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, (1, 5, 3, 4, 2, 6, 12, 8, 9, 10, 11, 7, 1, 3, 4, 2, 8))), (k % 17 + 1).cast("int"))
    msg = F.when(k % 17 == 2, k - 2).when(k % 17 == 3, k - 3).when(k % 17 == 13, k - 1).when(k % 17 == 14, k - 2).when(F.col("kind").isin(8, 9), k % 50).otherwise(k)
    # half of the consumers have no cursor and are never deleted
    consumer = F.when(F.col("kind").isin(6, 12, 7), F.col("o_custkey") % 10).otherwise(F.col("o_custkey") % 20)
    records = ev.table(s, d, "orders").withColumn("kind", kind).select(k.alias("ord"), "kind", consumer.alias("consumer"), msg.alias("msg"))
    return replay.summary(records, F.col("consumer") % 3 == F.col("msg") % 3)


WAL_STATE = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS cu, [1, 5, 3, 4, 2, 6, 12, 8, 9, 10, 11, 7, 1, 3, 4, 2, 8][CAST(o_orderkey % 17 + 1 AS INTEGER)] AS kind FROM orders),
 r AS (SELECT k AS ord, kind, CASE WHEN kind IN (6, 12, 7) THEN cu % 10 ELSE cu % 20 END AS consumer, CASE WHEN k % 17 = 2 THEN k - 2 WHEN k % 17 = 3 THEN k - 3 WHEN k % 17 = 13 THEN k - 1 WHEN k % 17 = 14 THEN k - 2 WHEN kind IN (8, 9) THEN k % 50 ELSE k END AS msg FROM o),
 g AS (SELECT consumer, coalesce(max(ord) FILTER (kind = 7), -1) AS gone FROM r GROUP BY 1), st AS (SELECT r.consumer, min(ord) AS start FROM r JOIN g ON r.consumer = g.consumer WHERE kind = 2 AND ord > gone GROUP BY 1),
 live AS (SELECT st.consumer, start, (SELECT min(ord) FROM r WHERE r.consumer = st.consumer AND kind IN (6, 12) AND ord > start) AS cursor_ FROM st),
 told AS (SELECT r.consumer, msg, bool_or(kind = 4) AS acked FROM r JOIN live ON r.consumer = live.consumer WHERE kind IN (3, 4) AND ord > start GROUP BY ALL),
 want AS (SELECT DISTINCT live.consumer, msg FROM r JOIN live ON ord > start AND (cursor_ IS NULL OR ord < cursor_) AND live.consumer % 3 = msg % 3 WHERE kind IN (1, 5)),
 dl AS (SELECT coalesce(want.consumer, told.consumer) AS c, coalesce(want.msg, told.msg) AS msg, CASE WHEN acked THEN 'acked' WHEN NOT acked THEN 'in_flight' ELSE 'pending' END AS state FROM want FULL JOIN told ON want.consumer = told.consumer AND want.msg = told.msg)
 SELECT state AS entity, count(*) AS n, max(msg) AS last FROM dl GROUP BY 1 UNION ALL SELECT 'messages', count(DISTINCT msg), max(ord) FROM r WHERE kind IN (1, 5) UNION ALL SELECT 'consumers', count(*), max(start) FROM live
 UNION ALL SELECT 'dead_letters', count(*), max(ord) FROM (SELECT msg, arg_max(kind, ord) AS kind, max(ord) AS ord FROM r WHERE kind IN (8, 9) GROUP BY 1) WHERE kind = 8 UNION ALL SELECT 'producer_sequences', count(DISTINCT (consumer, msg)), max(ord) FROM r WHERE kind = 10 UNION ALL SELECT 'groups', count(DISTINCT consumer), max(ord) FROM r WHERE kind = 11"""


def rep_registrations(s, d):
    """Brokers' registrations: refused by protocol, identity or an older incarnation; else with a session, and updates or a snapshot."""
    k = F.col("o_orderkey")
    rows = ev.table(s, d, "orders").select(k.alias("seq"), F.when(k % 31 == 0, 1).otherwise(2).alias("version"), (F.col("o_custkey") % 12).alias("broker"), F.floor((k + k % 13 * 40) / 500).alias("incarnation"), (k % 90).alias("last_revision"))
    return consumption.registrations(rows, version=2, first_revision=40, revision=75)


REP_REGISTRATIONS = """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 2 END AS version, o_custkey % 12 AS broker, (o_orderkey + o_orderkey % 13 * 40) // 500 AS incarnation, o_orderkey % 90 AS last_revision FROM orders),
 v AS (SELECT *, CASE WHEN version <> 2 THEN 'unsupported' WHEN broker = 0 OR incarnation = 0 THEN 'invalid' END AS bad FROM r), p AS (SELECT *, max(CASE WHEN bad IS NULL THEN incarnation END) OVER (PARTITION BY broker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
 o AS (SELECT *, coalesce(bad, CASE WHEN incarnation < before THEN 'stale' ELSE 'accepted' END) AS outcome FROM p)
 SELECT seq, broker, outcome, CASE WHEN outcome = 'accepted' THEN count(*) FILTER (outcome = 'accepted') OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS session, outcome = 'accepted' AND before IS NOT NULL AS fenced, CASE WHEN outcome = 'accepted' THEN last_revision + 1 < 40 END AS snapshot, CASE WHEN outcome = 'accepted' THEN CASE WHEN last_revision + 1 < 40 THEN 1 ELSE greatest(75 - last_revision, 0) END END AS updates FROM o"""


def src_message_ids(s, d):
    """What a source publishes its records under, so that a repeated poll is no news: a hash of their offset, and its generation."""
    h = hashing.fnv1a(F.concat(F.lit("offset-"), F.col("event_id").cast("string")))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return ev.table(s, d, "events").select("event_id", F.concat(F.lit("source-"), half(h["hi"]), half(h["lo"]), F.lit("-7")).alias("message_id"))


SRC_MESSAGE_IDS = f"WITH h AS (SELECT event_id, {_FNV.format("'offset-' || event_id")} AS h FROM events) SELECT event_id, 'source-' || lpad(lower(to_base(CAST(h // 4294967296 AS BIGINT), 16)), 8, '0') || lpad(lower(to_base(CAST(h % 4294967296 AS BIGINT), 16)), 8, '0') || '-7' AS message_id FROM h"


def _gauges(df: DataFrame, labels: list[str], names: list[str]) -> DataFrame:
    """Columns as (name, labels, value)."""
    text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels]) if labels else F.lit("")
    return df.select(text.alias("labels"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["labels"], names, "name", "value").select("name", "labels", "value")


def agg_exposition(s, d):
    """Gauges and counters of partitions, consumers, producers, transactions, tenants, views and latencies, in long form."""
    log = _log(s, d)
    parts = log.groupBy("stream", "part").agg(F.count("*").alias("partition_messages"), F.sum("bytes").alias("partition_bytes"), (F.max("off") + 1).alias("partition_high_watermark"), F.min("ts_ms").alias("partition_oldest_ms"), F.max("ts_ms").alias("partition_newest_ms"), F.countDistinct("key").alias("partition_keys"), F.max("bytes").alias("partition_largest_record"))
    leases, waiting = _leases(s, d), _pending(s, d)
    held = leases.groupBy("consumer").agg(F.count("*").alias("consumer_in_flight"), F.count_if(F.col("retry_waiting")).alias("consumer_retry_waiting"), F.max("attempt").alias("consumer_max_attempt"), F.count_if(F.col("attempt") >= 4).alias("consumer_dead_letters"), F.count_if(F.col("deadline_ms") <= NOW).alias("consumer_leases_due"))
    late = waiting.groupBy("consumer").agg(F.count("*").alias("consumer_pending"), F.greatest(NOW - F.min("scheduled_ms"), F.lit(0)).alias("consumer_oldest_due_ms"), F.count_if(F.col("scheduled_ms") > NOW).alias("consumer_scheduled"))
    tenants = log.groupBy(F.col("event_type").alias("tenant")).agg(F.sum("bytes").alias("tenant_disk_bytes"), F.count("*").alias("tenant_messages"), F.countDistinct("user_id").alias("tenant_users"))
    producers = _producers(s, d).groupBy("epoch").agg(F.countDistinct("producer").alias("producers"), F.max("sequence").alias("producer_last_sequence"))
    states = state.transaction_states(_txn(s, d), NOW).groupBy("state").agg(F.count("*").alias("transactions"))
    buckets = state.histogram(_samples(s, d), F.col("elapsed")).select("le", F.col("n").alias("latency_bucket"))
    out = _gauges(log.agg(F.count("*").alias("messages_total"), F.sum("bytes").alias("bytes_total"), F.countDistinct("subject").alias("subjects"), F.countDistinct("stream").alias("streams"), F.countDistinct("stream", "part").alias("partitions")), [], ["messages_total", "bytes_total", "subjects", "streams", "partitions"])
    for df, labels in ((parts, ["stream", "part"]), (held, ["consumer"]), (late, ["consumer"]), (tenants, ["tenant"]), (producers, ["epoch"]), (states, ["state"]), (buckets, ["le"])):
        out = out.unionByName(_gauges(df, labels, [c for c in df.columns if c not in labels]))
    return out


def _long(table: str, labels: list[str], names: list[str]) -> str:
    text = " || ',' || ".join(f"'{c}=' || {c}" for c in labels) or "''"
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {text} AS labels, CAST({n} AS DOUBLE) AS value FROM {table}" for n in names)


AGG_EXPOSITION = (
    _LOG + ", " + _LEASES.removeprefix("WITH ") + ", " + _TXN.replace("txn AS", "tx AS", 1).replace("FROM txn GROUP", "FROM tx GROUP")
    + f""", producers_ AS ({_PRODUCERS}), whole AS (SELECT count(*) AS messages_total, sum(bytes) AS bytes_total, count(DISTINCT subject) AS subjects, count(DISTINCT stream) AS streams, count(DISTINCT (stream, part)) AS partitions FROM log),
 pa AS (SELECT stream, part, count(*) AS partition_messages, sum(bytes) AS partition_bytes, max(off) + 1 AS partition_high_watermark, min(ts_ms) AS partition_oldest_ms, max(ts_ms) AS partition_newest_ms, count(DISTINCT key) AS partition_keys, max(bytes) AS partition_largest_record FROM log GROUP BY 1, 2),
 he AS (SELECT consumer, count(*) AS consumer_in_flight, count(*) FILTER (retry_waiting) AS consumer_retry_waiting, max(attempt) AS consumer_max_attempt, count(*) FILTER (attempt >= 4) AS consumer_dead_letters, count(*) FILTER (deadline_ms <= {NOW}) AS consumer_leases_due FROM leases GROUP BY 1),
 la AS (SELECT consumer, count(*) AS consumer_pending, greatest({NOW} - min(scheduled_ms), 0) AS consumer_oldest_due_ms, count(*) FILTER (scheduled_ms > {NOW}) AS consumer_scheduled FROM pending GROUP BY 1),
 te AS (SELECT event_type AS tenant, sum(bytes) AS tenant_disk_bytes, count(*) AS tenant_messages, count(DISTINCT user_id) AS tenant_users FROM log GROUP BY 1), pr AS (SELECT epoch, count(DISTINCT producer) AS producers, max(sequence) AS producer_last_sequence FROM producers_ GROUP BY 1),
 ts_ AS (SELECT state, count(*) AS transactions FROM states GROUP BY 1), bu AS (SELECT unnest(['9', '99', '999', '9999', '99999', '+Inf']) AS le, unnest([count(*) FILTER (l_extendedprice <= 9), count(*) FILTER (l_extendedprice <= 99), count(*) FILTER (l_extendedprice <= 999), count(*) FILTER (l_extendedprice <= 9999), count(*) FILTER (l_extendedprice <= 99999), count(*)]) AS latency_bucket FROM lineitem) """
    + " UNION ALL ".join(_long(t, labels, names.split()) for t, labels, names in (
        ("whole", [], "messages_total bytes_total subjects streams partitions"), ("pa", ["stream", "part"], "partition_messages partition_bytes partition_high_watermark partition_oldest_ms partition_newest_ms partition_keys partition_largest_record"),
        ("he", ["consumer"], "consumer_in_flight consumer_retry_waiting consumer_max_attempt consumer_dead_letters consumer_leases_due"), ("la", ["consumer"], "consumer_pending consumer_oldest_due_ms consumer_scheduled"),
        ("te", ["tenant"], "tenant_disk_bytes tenant_messages tenant_users"), ("pr", ["epoch"], "producers producer_last_sequence"), ("ts_", ["state"], "transactions"), ("bu", ["le"], "latency_bucket")))
)


def rep_metadata(s, d):
    """Orders as commands on eight partitions: new leaders, and commits by leaders that are sometimes old."""
    k = F.col("o_orderkey")
    n = lambda c: c.cast("long")
    none = F.lit(None)
    rows = ev.table(s, d, "orders").select(F.lit("s").alias("stream"), (k % 8).cast("int").alias("part"), n(k).alias("seq"), F.when(F.col("o_custkey") % 5 == 0, "leader").otherwise("commit").alias("kind"), n(F.col("o_custkey") % 4 + 1).alias("leader"), n(F.floor(F.col("o_custkey") / 4) % 6 + 1).alias("epoch"), n(F.floor(k / 8) % 3 + F.floor(k / 200)).alias("offset"), n(F.lit(0)).alias("checksum"), n(none).alias("generation"), none.cast("string").alias("phase"), none.cast("array<long>").alias("replicas"), none.cast("array<long>").alias("active"))
    return metadata.partition_commands(rows, [1, 2, 3], 1).drop("generation")


REP_METADATA = """WITH RECURSIVE e AS (SELECT CAST(o_orderkey % 8 AS INTEGER) AS part, o_orderkey AS seq, o_custkey % 5 = 0 AS lead_, o_custkey % 4 + 1 AS l, o_custkey // 4 % 6 + 1 AS ep, o_orderkey // 8 % 3 + o_orderkey // 200 AS off, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT part, 0::BIGINT AS i, 0::BIGINT AS seq, true AS ok, 1::BIGINT AS leader, 1::BIGINT AS epoch, 0::BIGINT AS nxt, NULL::BIGINT AS co, NULL::BIGINT AS cl, NULL::BIGINT AS ce FROM (SELECT DISTINCT part FROM e) UNION ALL
  SELECT part, i, seq, same OR moved OR again OR done, CASE WHEN moved THEN l ELSE leader END, CASE WHEN moved THEN ep ELSE epoch END, CASE WHEN done AND NOT again THEN off + 1 ELSE nxt END, CASE WHEN done THEN off ELSE co END, CASE WHEN done THEN l ELSE cl END, CASE WHEN done THEN ep ELSE ce END
  FROM (SELECT f.part, e.i, e.seq, leader, epoch, nxt, co, cl, ce, l, ep, off, lead_ AND l = leader AND ep = epoch AS same, lead_ AND NOT (l = leader AND ep = epoch) AND ep = epoch + 1 AND l <= 3 AS moved, NOT lead_ AND l = leader AND ep = epoch AND coalesce(co = off AND cl = l AND ce = ep, false) AS again,
   NOT lead_ AND l = leader AND ep = epoch AND NOT coalesce(co = off AND cl = l AND ce = ep, false) AND NOT coalesce(ep < ce, false) AND off = nxt AS done FROM f JOIN e ON e.part = f.part AND e.i = f.i + 1))
 SELECT 's' AS stream, part, seq, ok, leader, epoch, nxt AS next_offset FROM f WHERE i > 0"""


def rep_policies(s, d):
    """Policy snapshots of 30 scopes, of which late ones are refused."""
    return metadata.policies(ev.table(s, d, "orders").select((F.col("o_custkey") % 30).alias("scope"), F.col("o_orderkey").alias("seq"), F.floor((F.col("o_orderkey") + F.col("o_orderkey") % 7 * 300) / 400).alias("generation")))


REP_POLICIES = "WITH p AS (SELECT o_custkey % 30 AS scope, o_orderkey AS seq, (o_orderkey + o_orderkey % 7 * 300) // 400 AS generation FROM orders) SELECT *, coalesce(generation >= max(generation) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM p"


ALL = {
    f.__name__: (f, globals().get(f.__name__.upper()))
    for f in (fn_workload, fn_pacing, fn_ack_subject, fn_saturating, fn_duration, fn_crc32, flt_message, flt_names, pt_state_shard, pt_leaders, prj_envelope, rbc_snapshot, aud_status, agg_producers, rep_committed, grp_commit_fenced, grp_sticky, grp_expand, cur_delivered, cur_ack_window, dlv_nack, dlv_jitter, qta_work, sch_register, sch_avro, sch_protobuf, src_replay, src_assigned, src_subject_offsets, vw_apply, vw_snapshot, cmp_superseded, udf_pipeline, jn_large_index, agg_consumer_load, agg_rates, agg_latency_buckets, jn_allow_list, pt_epochs, dlv_dead_admin, ret_acks, vw_watch_status, jn_catalog, wal_state, rep_registrations, src_message_ids, agg_exposition, rep_metadata, rep_policies, dlv_grant)
}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
