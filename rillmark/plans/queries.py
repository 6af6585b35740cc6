"""Queries over the log made from ``events``, each with SQL that says the same for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import hashing, scalars, subjects
from rillmark.operators import consumption, lifecycle, routing, state
from rillmark.sources import events as ev

PATTERNS = [("all", "**"), ("clicks", "events/click/*"), ("buyers", "events/purchase/**"), ("one", "events/view/7"), ("seven", "events/*/7"), ("deep", "events/**"), ("none", "events/*")]
NOW, AGE, BYTES = 1706745600000, 12 * 86_400_000, 20_000

_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"
_MSG = """msg AS (SELECT 'events/' || event_type || '/' || user_id AS subject, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS key,
 epoch_us(ts) // 1000 AS ts_ms, props AS payload, event_id + 1 AS seq, user_id, event_type, value, CASE WHEN event_type = 'purchase' THEN 'purchases' ELSE 'telemetry' END AS stream FROM events)"""
_LOG = f"""WITH {_MSG}, prt AS (SELECT *, CAST({_FNV.format("coalesce(key, subject)")} % 8 AS INTEGER) AS part FROM msg),
 log AS (SELECT *, row_number() OVER (PARTITION BY stream, part ORDER BY seq) - 1 AS off,
 91 + 7 + length(stream) + length(subject) + CASE WHEN key IS NULL THEN 1 ELSE 5 + length(key) END + length(payload) AS bytes FROM prt)"""


def _log(spark, d) -> DataFrame:
    return ev.log(spark, d).withColumn("bytes", scalars.record_bytes(F.lit("default"), F.col("stream"), F.col("subject"), F.col("key"), F.col("payload")))


def _messages(spark, d) -> DataFrame:
    return ev.messages(ev.table(spark, d, "events"))


def _counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def _acked():
    return F.col("off") % 97 != 96


def _updates(spark, d):
    """Orders as view updates and producer sequences."""
    return ev.table(spark, d, "orders")


def _samples(spark, d):
    return ev.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("client"), F.col("l_quantity").alias("bytes"), F.col("l_extendedprice").alias("elapsed"))


def _producers(spark, d):
    from pyspark.sql import Window

    o = _updates(spark, d)
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").alias("producer"), (F.col("o_custkey") % 3).alias("epoch"), rank.cast("long").alias("sequence"), F.col("o_orderkey").alias("seq"), "o_orderstatus")


_PRODUCERS = "SELECT o_custkey AS producer, o_custkey % 3 AS epoch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence, o_orderkey AS seq, o_orderstatus FROM orders"


def _replicas(spark, d):
    return _log(spark, d).groupBy("stream", "part").agg(F.max("off").alias("m")).select("stream", "part", F.explode(F.array(F.col("m"), F.col("m") - 3, F.greatest(F.col("m") - 10, F.lit(0)))).alias("match_offset"))


def _txn(spark, d):
    o = _updates(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("commit", "abort", "prepare", "begin"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select((F.col("o_orderkey") % 500).alias("txn"), kind.alias("kind"), F.col("o_orderkey").alias("seq"), (F.lit(NOW) + (F.col("o_custkey") % 7 - 3) * 1000).cast("long").alias("deadline_ms"))


_TXN = f"""txn AS (SELECT o_orderkey % 500 AS txn, ['commit', 'abort', 'prepare', 'begin'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS kind, o_orderkey AS seq, {NOW} + (o_custkey % 7 - 3) * 1000 AS deadline_ms FROM orders),
 states AS (SELECT txn, CASE WHEN arg_max(kind, seq) IN ('commit', 'abort') THEN arg_max(kind, seq) WHEN max(deadline_ms) <= {NOW} THEN 'abort' ELSE arg_max(kind, seq) END AS state FROM txn GROUP BY txn)"""


def _roles(spark, d):
    c = ev.table(spark, d, "customer")
    bindings = c.select(F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("tenant"), F.when(F.col("c_custkey") % 3 == 0, "admin").otherwise("reader").alias("role"), F.when(F.col("c_custkey") % 5 == 0, F.lit(NOW - 1)).alias("expires_at_ms"))
    roles = spark.createDataFrame([("admin", ["read", "write"]), ("reader", ["read"])], "role string, permissions array<string>")
    requests = c.select(F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("tenant"), F.explode(F.array(F.lit("read"), F.lit("write"))).alias("permission"))
    return state.authorized(requests, bindings, roles, NOW)


def _like(pattern: str) -> str:
    return "regexp_matches(subject, '" + subjects.to_regex(pattern).replace("'", "''") + "')"


def _members(spark, d):
    return ev.table(spark, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("grp"), F.col("n_name").alias("member"))


_MEMBERS = "m AS (SELECT 'g' || n_regionkey AS grp, list_sort(list(DISTINCT n_name)) AS m FROM nation GROUP BY 1), p AS (SELECT grp, m, CAST(unnest(range(16)) AS INTEGER) AS part FROM m)"


def _audit(spark, d):
    from pyspark.sql import Window

    e = _messages(spark, d).withColumn("chain", F.col("user_id") % 16)
    e = e.withColumn("hash", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "subject", "payload"), 256))
    previous = F.lag("hash", 1, "").over(Window.partitionBy("chain").orderBy("seq"))
    chain = e.select("chain", F.col("seq").alias("sequence"), "hash", F.when(F.col("seq") % 101 == 0, "forged").otherwise(previous).alias("previous_hash"))
    return state.audit_breaks(chain).select("chain", "sequence")


def _rate(spark, d):
    e = _messages(spark, d).groupBy("event_type", F.floor(F.col("ts_ms") / 3_600_000).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("hour").rangeBetween(-5, 0)
    return e.select("event_type", "hour", "n", F.sum("n").over(w).alias("increase_6h"))


#: name: (query, SQL)
ALL = {
    "flt_pattern_exact": (lambda s, d: _messages(s, d).filter(subjects.matches(F.col("subject"), "events/view/7")).select("seq", "subject"), f"WITH {_MSG} SELECT seq, subject FROM msg WHERE subject = 'events/view/7'"),
    "flt_pattern_star": (lambda s, d: _messages(s, d).filter(subjects.matches(F.col("subject"), "events/click/*")).select("seq", "subject"), f"WITH {_MSG} SELECT seq, subject FROM msg WHERE {_like('events/click/*')}"),
    "flt_pattern_tail": (lambda s, d: _counted(_messages(s, d).filter(subjects.matches(F.col("subject"), "events/**")), "event_type"), f"WITH {_MSG} SELECT event_type, count(*) AS n FROM msg WHERE {_like('events/**')} GROUP BY 1"),
    "flt_subject_valid": (lambda s, d: ev.table(s, d, "part").select("p_partkey", subjects.valid_subject(F.regexp_replace("p_name", " ", "/")).alias("ok"), subjects.valid_pattern(F.concat(F.regexp_replace("p_name", " ", "/"), F.lit("/**"))).alias("pattern_ok")), f"SELECT p_partkey, regexp_matches(replace(p_name, ' ', '/'), '{subjects.SUBJECT}') AS ok, regexp_matches(replace(p_name, ' ', '/') || '/**', '{subjects.PATTERN}') AS pattern_ok FROM part"),
    "flt_size_limit": (lambda s, d: _log(s, d).filter("bytes > 140").select("stream", "part", "off", "bytes"), _LOG + " SELECT stream, part, off, bytes FROM log WHERE bytes > 140"),
    "flt_due": (lambda s, d: _messages(s, d).withColumn("headers", F.array(F.struct(F.lit("Scheduled-At").alias("name"), (F.col("ts_ms") + 1000 * F.col("user_id")).cast("string").alias("value")))).filter(F.expr("try_cast(headers[0].value AS bigint)").isNotNull() & (scalars.header(F.col("headers"), "scheduled-at").cast("long") <= NOW - 10 * 86_400_000)).select("seq"), f"WITH {_MSG} SELECT seq FROM msg WHERE ts_ms + 1000 * user_id <= {NOW - 10 * 86_400_000}"),
    "prj_sizes": (lambda s, d: _log(s, d).groupBy("stream", "part").agg(F.sum("bytes").alias("binary_bytes"), F.sum(scalars.quota_bytes(F.col("stream"), F.col("subject"), F.col("key"), F.col("payload"))).alias("quota_bytes")), _LOG + " SELECT stream, part, CAST(sum(bytes) AS BIGINT) AS binary_bytes, CAST(sum(128 + length(stream) + length(subject) + coalesce(length(key), 0) + length(payload)) AS BIGINT) AS quota_bytes FROM log GROUP BY 1, 2"),
    "prj_resident": (lambda s, d: _log(s, d).select("stream", "part", "off", "subject", "key", "ts_ms"), _LOG + " SELECT stream, part, off, subject, key, ts_ms FROM log"),
    "fn_hex_token": (lambda s, d: _messages(s, d).select("seq", scalars.hex_lower(F.col("subject")).alias("hex"), subjects.token(F.col("subject"), 1).alias("token"), F.sha2("payload", 256).alias("sha")), f"WITH {_MSG} SELECT seq, lower(hex(encode(subject))) AS hex, split_part(subject, '/', 2) AS token, sha256(payload) AS sha FROM msg"),
    "fn_position_key": (lambda s, d: _log(s, d).select("seq", scalars.position_key(F.col("stream"), F.col("part")).alias("position")), _LOG + " SELECT seq, stream || ':' || lpad(CAST(part AS VARCHAR), 10, '0') AS position FROM log"),
    "fn_work_share": (lambda s, d: ev.table(s, d, "nation").select("n_nationkey", scalars.work_share(1003, 25, F.col("n_nationkey")).alias("share")), "SELECT n_nationkey, CAST(40 + CASE WHEN n_nationkey < 3 THEN 1 ELSE 0 END AS BIGINT) AS share FROM nation"),
    "jn_pattern_fanout": (lambda s, d: _counted(routing.fan_out(_messages(s, d), PATTERNS), "subscriber"), f"WITH {_MSG}, pats AS (SELECT * FROM (VALUES {', '.join(f'''('{o}', '{subjects.to_regex(p)}')''' for o, p in PATTERNS)}) AS t(subscriber, re)) SELECT subscriber, count(*) AS n FROM msg JOIN pats ON regexp_matches(subject, re) GROUP BY 1"),
    "jn_interest": (lambda s, d: routing.interested(_messages(s, d), PATTERNS), f"WITH {_MSG}, pats AS (SELECT * FROM (VALUES {', '.join(f'''('{o}', '{subjects.to_regex(p)}')''' for o, p in PATTERNS)}) AS t(subscriber, re)) SELECT DISTINCT subscriber FROM msg JOIN pats ON regexp_matches(subject, re)"),
    "jn_stream_bind": (lambda s, d: _counted(ev.bound(_messages(s, d)), "stream", "event_type"), f"WITH {_MSG} SELECT stream, event_type, count(*) AS n FROM msg GROUP BY 1, 2"),
    "jn_unbound": (lambda s, d: _counted(ev.bound(_messages(s, d), [("purchases", "events/purchase/**")]).filter("stream is null"), "event_type"), f"WITH {_MSG} SELECT event_type, count(*) AS n FROM msg WHERE event_type <> 'purchase' GROUP BY 1"),
    "jn_binding_overlap": (lambda s, d: routing.binding_conflicts(s, [("a", "orders/**"), ("b", "orders/*/created"), ("c", "events/x"), ("d", "events/*")]), "SELECT * FROM (VALUES ('a', 'orders/**', 'b', 'orders/*/created'), ('c', 'events/x', 'd', 'events/*')) AS t(stream_a, pattern_a, stream_b, pattern_b)"),
    "jn_request_reply": (lambda s, d: _pairs(s, d), "SELECT q.conv_id, q.turn, a.turn AS reply_turn FROM conversations q LEFT JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'"),
    "pt_fnv_partition": (lambda s, d: _messages(s, d).select("seq", hashing.partition_of(F.coalesce("key", "subject"), 8).alias("part")), _LOG + " SELECT seq, part FROM log"),
    "pt_subject_token": (lambda s, d: _messages(s, d).select("seq", hashing.partition_of(F.coalesce("key", subjects.token(F.col("subject"), 2)), 16).alias("part")), f"WITH {_MSG} SELECT seq, CAST({_FNV.format('CAST(user_id AS VARCHAR)')} % 16 AS INTEGER) AS part FROM msg"),
    "pt_rendezvous": (lambda s, d: routing.rendezvous(s.range(8).select(F.lit("telemetry").alias("stream"), F.col("id").cast("int").alias("part")), ev.table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("node")), 3).select("part", "node", "rank"), f"WITH h AS (SELECT p.range AS part, r_regionkey AS node, {_FNV.format("'telemetry/' || p.range || '/' || r_regionkey")} AS h FROM range(8) p, region), k AS (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY h DESC, node) AS rank FROM h) SELECT CAST(part AS INTEGER) AS part, CAST(node AS INTEGER) AS node, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"),
    "win_offset_assign": (lambda s, d: _log(s, d).select("seq", "stream", "part", "off"), _LOG + " SELECT seq, stream, part, off FROM log"),
    "win_offset_gaps": (lambda s, d: lifecycle.offset_gaps(lifecycle.compacted(_log(s, d))).select("stream", "part", "off", "before"), _LOG + ", c AS (SELECT * FROM log WHERE key IS NULL UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY stream, part, key ORDER BY off DESC) AS r FROM log WHERE key IS NOT NULL) WHERE r = 1), g AS (SELECT stream, part, off, lag(off) OVER (PARTITION BY stream, part ORDER BY off) AS before FROM c) SELECT * FROM g WHERE off <> before + 1"),
    "ret_age_floor": (lambda s, d: lifecycle.age_floor(_log(s, d), NOW, AGE).select("stream", "part", "floor").distinct(), _LOG + f" SELECT stream, part, coalesce(min(CASE WHEN {NOW} - ts_ms <= {AGE} THEN off END), max(off) + 1) AS floor FROM log GROUP BY 1, 2"),
    "ret_bytes_floor": (lambda s, d: lifecycle.retained_by_bytes(_log(s, d), BYTES).groupBy("stream", "part").agg(F.min("off").alias("floor"), F.count("*").alias("n")), _LOG + f", r AS (SELECT *, sum(bytes) OVER (PARTITION BY stream, part ORDER BY off DESC ROWS UNBOUNDED PRECEDING) AS b FROM log) SELECT stream, part, min(off) AS floor, count(*) AS n FROM r WHERE b <= {BYTES} GROUP BY 1, 2"),
    "ret_combined_status": (lambda s, d: lifecycle.retention_status(_log(s, d), NOW, AGE, BYTES), _LOG + f""", f AS (SELECT stream, part, coalesce(min(CASE WHEN {NOW} - ts_ms <= {AGE} THEN off END), max(off) + 1) AS fl FROM log GROUP BY 1, 2),
 a AS (SELECT log.* FROM log JOIN f USING (stream, part) WHERE off >= fl), r AS (SELECT *, sum(bytes) OVER (PARTITION BY stream, part ORDER BY off DESC ROWS UNBOUNDED PRECEDING) AS b FROM a),
 k AS (SELECT stream, part, min(off) AS first, count(*) AS kn, sum(bytes) AS kb FROM r WHERE b <= {BYTES} GROUP BY 1, 2), w AS (SELECT stream, part, max(off) + 1 AS next_offset, count(*) AS n, sum(bytes) AS b FROM log GROUP BY 1, 2)
 SELECT stream, part, coalesce(first, next_offset) AS earliest, next_offset, coalesce(kn, 0) AS retained_messages, CAST(coalesce(kb, 0) AS BIGINT) AS retained_bytes, n - coalesce(kn, 0) AS deleted_messages, CAST(b - coalesce(kb, 0) AS BIGINT) AS deleted_bytes FROM w LEFT JOIN k USING (stream, part)"""),
    "cmp_latest_by_key": (lambda s, d: lifecycle.compacted(_log(s, d)).select("stream", "part", "off", "key"), _LOG + " SELECT stream, part, off, key FROM log WHERE key IS NULL UNION ALL SELECT stream, part, max(off) AS off, key FROM log WHERE key IS NOT NULL GROUP BY stream, part, key"),
    "cmp_partition_counts": (lambda s, d: _counted(lifecycle.compacted(_log(s, d)), "stream", "part"), _LOG + " SELECT stream, part, count(CASE WHEN key IS NULL THEN 1 END) + count(DISTINCT key) AS n FROM log GROUP BY 1, 2"),
    "vw_rebuild": (lambda s, d: lifecycle.view(_log(s, d).withColumn("k", F.coalesce("key", "subject")), "k", "payload").select("k", "payload", "stream", "part", "off"), _LOG + ", u AS (SELECT *, coalesce(key, subject) AS k, row_number() OVER (PARTITION BY coalesce(key, subject) ORDER BY stream DESC, part DESC, off DESC) AS r FROM log) SELECT k, payload, stream, part, off FROM u WHERE r = 1"),
    "vw_positions": (lambda s, d: _log(s, d).groupBy("stream", "part").agg(F.max("off").alias("position"), F.countDistinct("key").alias("entries")), _LOG + " SELECT stream, part, max(off) AS position, count(DISTINCT key) AS entries FROM log GROUP BY 1, 2"),
    "vw_watch": (lambda s, d: lifecycle.view_changes(_messages(s, d).withColumn("sequence", F.col("seq")), 100, 500).select("sequence", "subject"), f"WITH {_MSG} SELECT seq AS sequence, subject FROM msg WHERE seq > 100 AND seq > (SELECT max(seq) FROM msg) - 500"),
    "cur_start_positions": (lambda s, d: consumption.start_offsets(_log(s, d), NOW - AGE, 5), _LOG + f" SELECT stream, part, CAST(0 AS BIGINT) AS earliest, max(off) + 1 AS latest, CAST(0 AS BIGINT) AS committed, CAST(5 AS BIGINT) AS at_offset, coalesce(min(CASE WHEN ts_ms >= {NOW - AGE} THEN off END), max(off) + 1) AS at_time FROM log GROUP BY 1, 2"),
    "cur_committed_prefix": (lambda s, d: consumption.committed(_log(s, d), F.col("event_type") != "view", _acked()), _LOG + ", m AS (SELECT * FROM log WHERE event_type <> 'view'), g AS (SELECT stream, part, min(CASE WHEN off % 97 = 96 THEN off END) AS gap FROM m GROUP BY 1, 2) SELECT g.stream, g.part, coalesce(max(CASE WHEN gap IS NULL OR off < gap THEN off END) + 1, 0) AS committed FROM g JOIN m ON g.stream = m.stream AND g.part = m.part GROUP BY 1, 2"),
    "cur_retention_gap": (lambda s, d: consumption.gap_applied(_log(s, d).groupBy("stream", "part").agg(F.lit("c").alias("consumer"), F.floor(F.max("off") / 2).alias("committed")), lifecycle.age_floor(_log(s, d), NOW, AGE).select("stream", "part", "floor").distinct()), _LOG + f", f AS (SELECT stream, part, max(off) // 2 AS c, coalesce(min(CASE WHEN {NOW} - ts_ms <= {AGE} THEN off END), max(off) + 1) AS fl FROM log GROUP BY 1, 2) SELECT 'c' AS consumer, stream, part, greatest(c, fl) AS committed, CAST(CASE WHEN c < fl THEN 1 ELSE 0 END AS BIGINT) AS gaps FROM f"),
    "ord_fetch_greedy": (lambda s, d: consumption.fetched(_log(s, d).withColumn("consumer", F.col("event_type")), 50, 5000).select("consumer", "stream", "part", "off"), _LOG + ", w AS (SELECT *, event_type AS consumer, count(*) OVER x AS n, sum(bytes) OVER x AS b FROM log WINDOW x AS (PARTITION BY event_type ORDER BY stream, part, off ROWS UNBOUNDED PRECEDING)) SELECT consumer, stream, part, off FROM w WHERE n <= 50 AND b <= 5000"),
    "ord_page": (lambda s, d: _log(s, d).orderBy("stream", "part", "off").offset(100).limit(50).select("stream", "part", "off"), _LOG + " SELECT stream, part, off FROM log ORDER BY stream, part, off LIMIT 50 OFFSET 100"),
    "dlv_retry_delay": (lambda s, d: _messages(s, d).select("seq", scalars.retry_delay(F.col("seq") % 40 + 1, 100, 300_000).alias("delay")), f"WITH {_MSG} SELECT seq, CAST(least(300000, 100 * (1::BIGINT << CAST(least(seq % 40, 30) AS BIGINT))) AS BIGINT) AS delay FROM msg"),
    "dlv_queue_copies": (lambda s, d: _messages(s, d).select(F.concat(F.lit("queue-q-"), scalars.hex_lower(F.concat(F.lit("events/"), "event_type", F.lit("/*")))).alias("durable"), "seq").groupBy("durable").agg(F.countDistinct("seq").alias("n")), f"WITH {_MSG} SELECT 'queue-q-' || lower(hex(encode('events/' || event_type || '/*'))) AS durable, count(DISTINCT seq) AS n FROM msg GROUP BY 1"),
    "dlv_dead_letters": (lambda s, d: _log(s, d).withColumn("attempts", F.col("seq") % 7 + 1).filter("attempts >= 6").select("stream", "part", "off", "attempts", "payload"), _LOG + " SELECT stream, part, off, seq % 7 + 1 AS attempts, payload FROM log WHERE seq % 7 + 1 >= 6"),
    "grp_range": (lambda s, d: consumption.assigned(16, _members(s, d), "range"), f"WITH {_MEMBERS} SELECT grp, part, m[part * len(m) // 16 + 1] AS member FROM p"),
    "grp_round_robin": (lambda s, d: consumption.assigned(16, _members(s, d), "robin"), f"WITH {_MEMBERS} SELECT grp, part, m[part % len(m) + 1] AS member FROM p"),
    "grp_commit_max": (lambda s, d: _log(s, d).filter((F.col("seq") % 5 != 0) & (F.col("off") > 0)).groupBy("stream", "part").agg(F.max("off").alias("committed")), _LOG + " SELECT stream, part, max(off) AS committed FROM log WHERE seq % 5 <> 0 AND off > 0 GROUP BY 1, 2"),
    "idm_dedup": (lambda s, d: _counted(state.deduplicated(_producers(s, d).unionByName(_producers(s, d))), "epoch"), f"WITH p AS ({_PRODUCERS}) SELECT epoch, count(*) AS n FROM p GROUP BY 1"),
    "idm_gaps": (lambda s, d: state.sequence_gaps(_producers(s, d).filter("seq % 10 <> 3")).select("producer", "sequence"), f"WITH p AS ({_PRODUCERS}), q AS (SELECT *, lag(sequence) OVER (PARTITION BY producer, epoch ORDER BY sequence) AS b FROM p WHERE seq % 10 <> 3) SELECT producer, sequence FROM q WHERE sequence <> b + 1 OR (b IS NULL AND sequence > 1)"),
    "txn_states": (lambda s, d: _counted(state.transaction_states(_txn(s, d), NOW), "state"), f"WITH {_TXN} SELECT state, count(*) AS n FROM states GROUP BY 1"),
    "txn_visible": (lambda s, d: _counted(state.visible(_updates(s, d).withColumn("txn", F.col("o_orderkey") % 500), state.transaction_states(_txn(s, d), NOW)), "o_orderstatus"), f"WITH {_TXN} SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 500 IN (SELECT txn FROM states WHERE state = 'commit') GROUP BY 1"),
    "wal_cleanup": (lambda s, d: _messages(s, d).select("seq", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("c")).groupBy("seq").agg(F.bool_and(F.col("seq") % F.col("c") != 1).alias("ok")).filter("ok").select("seq"), f"WITH {_MSG} SELECT seq FROM msg WHERE seq % 2 <> 1 AND seq % 3 <> 1 AND seq % 5 <> 1"),
    "rbc_authorize": (lambda s, d: _counted(_roles(s, d), "tenant", "permission", "allowed"), f"SELECT c_mktsegment AS tenant, permission, c_custkey % 5 <> 0 AND (permission = 'read' OR c_custkey % 3 = 0) AS allowed, count(*) AS n FROM customer, (VALUES ('read'), ('write')) AS t(permission) GROUP BY 1, 2, 3"),
    "aud_chain": (lambda s, d: _audit(s, d), f"WITH {_MSG} SELECT user_id % 16 AS chain, seq AS sequence FROM msg WHERE seq % 101 = 0"),
    "rep_quorum_hw": (lambda s, d: state.high_watermarks(_replicas(s, d)), _LOG + " SELECT stream, part, max(off) - 3 AS high_watermark FROM log GROUP BY 1, 2"),
    "agg_histogram": (lambda s, d: state.histogram(_samples(s, d), F.col("elapsed")), "SELECT unnest(['9', '99', '999', '9999', '99999', '+Inf']) AS le, unnest([count(*) FILTER (elapsed <= 9), count(*) FILTER (elapsed <= 99), count(*) FILTER (elapsed <= 999), count(*) FILTER (elapsed <= 9999), count(*) FILTER (elapsed <= 99999), count(*)]) AS n FROM (SELECT l_extendedprice AS elapsed FROM lineitem)"),
    "agg_distribution": (lambda s, d: state.distribution(_samples(s, d), "elapsed", ["role"]), "WITH x AS (SELECT l_returnflag AS role, l_extendedprice AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) SELECT role, count(*) AS n, min(e) AS least, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS deviation, max(e) AS greatest, max(CASE WHEN i = ceil((c - 1) * 0.5) THEN e END) AS p5, max(CASE WHEN i = ceil((c - 1) * 0.95) THEN e END) AS p95, max(CASE WHEN i = ceil((c - 1) * 0.99) THEN e END) AS p99 FROM x GROUP BY role"),
    "agg_throughput_rollup": (lambda s, d: state.throughput(_samples(s, d)), "SELECT l_returnflag AS role, l_linestatus AS client, count(*) AS ops, sum(l_quantity) AS bytes, max(l_extendedprice) AS elapsed FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))"),
    "agg_rate_range": (lambda s, d: _rate(s, d), f"WITH {_MSG}, e AS (SELECT event_type, ts_ms // 3600000 AS hour, count(*) AS n FROM msg GROUP BY 1, 2) SELECT event_type, hour, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase_6h FROM e"),
    "agg_lag": (lambda s, d: consumption.lag(_log(s, d), _log(s, d).groupBy("stream", "part").agg(F.floor(F.max("off") / 2).alias("committed"))), _LOG + " SELECT stream, part, max(off) + 1 AS high, max(off) + 1 - max(off) // 2 AS lag FROM log GROUP BY 1, 2"),
    "agg_tenant_bytes": (lambda s, d: _log(s, d).groupBy(F.split_part("subject", F.lit("/"), F.lit(2)).alias("tenant")).agg(F.sum("bytes").alias("used")), _LOG + " SELECT event_type AS tenant, CAST(sum(bytes) AS BIGINT) AS used FROM log GROUP BY 1"),
    "src_point_read": (lambda s, d: _log(s, d).filter("stream = 'telemetry' and part = 3 and off = 10").select("seq", "subject", "payload"), _LOG + " SELECT seq, subject, payload FROM log WHERE stream = 'telemetry' AND part = 3 AND off = 10"),
    "snk_idempotent_append": (lambda s, d: _log(s, d).filter("seq % 2 = 0").join(_log(s, d).filter("seq % 3 = 0").select("stream", "part", "off"), ["stream", "part", "off"], "left_anti").select("stream", "part", "off"), _LOG + " SELECT stream, part, off FROM log WHERE seq % 2 = 0 AND seq % 3 <> 0"),
    "snk_incremental_diff": (lambda s, d: _files(s, d, 7).join(_files(s, d, 5), ["path", "sha"], "left_anti"), "SELECT DISTINCT 'seg-' || p_partkey AS path, sha256(p_name || '-' || (p_partkey % 7)) AS sha FROM part WHERE p_partkey % 7 <> p_partkey % 5"),
    "snk_restore_latest": (lambda s, d: _files(s, d, 7).withColumn("i", F.lit(0)).unionByName(_files(s, d, 5).withColumn("i", F.lit(1)).filter("path like '%1'")).groupBy("path").agg(F.max_by("sha", "i").alias("sha")), "SELECT 'seg-' || p_partkey AS path, sha256(p_name || '-' || CASE WHEN p_partkey % 10 = 1 THEN p_partkey % 5 ELSE p_partkey % 7 END) AS sha FROM part"),
    "snk_checkpoint_max": (lambda s, d: _log(s, d).groupBy("stream", "part").agg(F.max("off").alias("checkpoint")), _LOG + " SELECT stream, part, max(off) AS checkpoint FROM log GROUP BY 1, 2"),
}


def _pairs(s: SparkSession, d: str) -> DataFrame:
    c = ev.table(s, d, "conversations")
    requests = c.filter("role = 'user'").select("conv_id", "turn", F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("reply_to"))
    replies = c.filter("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("subject"), F.col("turn").alias("reply_turn"))
    return routing.request_reply(requests, replies).select("conv_id", "turn", "reply_turn")


def _files(s: SparkSession, d: str, n: int) -> DataFrame:
    p = ev.table(s, d, "part")
    return p.select(F.concat(F.lit("seg-"), F.col("p_partkey").cast("string")).alias("path"), F.sha2(F.concat("p_name", F.lit("-"), (F.col("p_partkey") % n).cast("string")), 256).alias("sha"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Bind, partition, number, compact, count."""
    return ALL["cmp_partition_counts"][0](s, d)


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items()}
