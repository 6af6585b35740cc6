"""Queries of delivery, replication, placement, schemas, alerts and streams; SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators import compatibility, delivery, folds
from rillmark.plans import foldsql
from rillmark.plans.queries import NOW
from rillmark.sources import events as ev
from rillmark.streaming import log as stream


def _leases(s, d) -> DataFrame:
    """Orders as leases of 50 consumers."""
    o = ev.table(s, d, "orders").filter("o_orderstatus <> 'O'")
    return o.select(
        (F.col("o_custkey") % 50).cast("long").alias("consumer"), F.col("o_orderkey").cast("long").alias("seq"), (F.col("o_orderkey") * 2 + 1).cast("long").alias("delivery_id"),
        (F.col("o_orderkey") % 5 + 1).cast("long").alias("attempt"), (F.lit(NOW) + (F.col("o_custkey") % 7 - 3) * 1000).cast("long").alias("deadline_ms"), (F.col("o_orderkey") % 11 == 0).alias("retry_waiting"))


def _pending(s, d) -> DataFrame:
    o = ev.table(s, d, "orders").filter("o_orderstatus = 'O'")
    return o.select((F.col("o_custkey") % 50).cast("long").alias("consumer"), F.col("o_orderkey").cast("long").alias("seq"), (F.lit(NOW) + F.col("o_orderkey") % 997 - 990).cast("long").alias("scheduled_ms"))


_LEASES = f"""WITH leases AS (SELECT o_custkey % 50 AS consumer, o_orderkey AS seq, o_orderkey * 2 + 1 AS delivery_id, o_orderkey % 5 + 1 AS attempt,
 {NOW} + (o_custkey % 7 - 3) * 1000 AS deadline_ms, o_orderkey % 11 = 0 AS retry_waiting FROM orders WHERE o_orderstatus <> 'O'),
 pending AS (SELECT o_custkey % 50 AS consumer, o_orderkey AS seq, {NOW} + o_orderkey % 997 - 990 AS scheduled_ms FROM orders WHERE o_orderstatus = 'O')"""


def dlv_expiry(s, d):
    """What becomes of due leases, with a retry delay of half a second for two sequences in three."""
    return delivery.expired(_leases(s, d), NOW, 4, F.col("seq") % 3 * 500).select("consumer", "seq", "outcome", "attempt_after", "deadline_after")


DLV_EXPIRY = f"""{_LEASES}, due AS (SELECT *, CASE WHEN NOT retry_waiting AND attempt >= 4 THEN 'terminal' WHEN NOT retry_waiting AND seq % 3 > 0 THEN 'retry_waiting' ELSE 'pending' END AS outcome FROM leases WHERE deadline_ms <= {NOW})
 SELECT consumer, seq, outcome, CASE WHEN retry_waiting OR outcome = 'terminal' THEN attempt ELSE attempt + 1 END AS attempt_after, CASE WHEN outcome = 'retry_waiting' THEN {NOW} + seq % 3 * 500 END AS deadline_after FROM due"""


def dlv_next_pull(s, d):
    """What each consumer gets next with room for 100 in flight."""
    return delivery.next_pull(_leases(s, d), _pending(s, d), NOW, 100)


DLV_NEXT_PULL = f"""{_LEASES}, c AS (SELECT consumer FROM leases UNION SELECT consumer FROM pending), late AS (SELECT consumer, min(seq) AS seq, arg_min(attempt, seq) AS attempt FROM leases WHERE deadline_ms <= {NOW} GROUP BY consumer),
 n AS (SELECT consumer, count(*) AS n FROM leases GROUP BY consumer), p AS (SELECT consumer, min(seq) AS seq FROM pending GROUP BY consumer),
 t AS (SELECT c.consumer, coalesce(late.seq, CASE WHEN coalesce(n.n, 0) < 100 THEN p.seq END) AS seq, coalesce(late.attempt + 1, 1) AS attempt FROM c LEFT JOIN late USING (consumer) LEFT JOIN n USING (consumer) LEFT JOIN p USING (consumer))
 SELECT * FROM t WHERE seq IS NOT NULL"""


def dlv_head_of_line(s, d):
    """Candidates that no message that isn't due holds up."""
    return delivery.before_undue(_pending(s, d), NOW).select("consumer", "seq")


DLV_HEAD_OF_LINE = f"{_LEASES}, b AS (SELECT *, min(CASE WHEN scheduled_ms > {NOW} THEN seq END) OVER (PARTITION BY consumer) AS block FROM pending) SELECT consumer, seq FROM b WHERE block IS NULL OR seq < block"


def dlv_valid_acks(s, d):
    """Of acknowledgements of which some carry an earlier delivery, those of the active one."""
    leases = _leases(s, d)
    return delivery.valid_acks(leases.select("consumer", "seq", (F.col("delivery_id") - (F.col("seq") % 4 == 0).cast("long")).alias("delivery_id")), leases)


DLV_VALID_ACKS = f"{_LEASES} SELECT consumer, seq, delivery_id FROM leases WHERE seq % 4 <> 0"


def dlv_extend(s, d):
    """Extensions of up to four seconds, of which three are allowed."""
    return delivery.extended(_leases(s, d), NOW, (F.col("seq") % 5) * 1000, 3000).select("consumer", "seq", "deadline_ms")


DLV_EXTEND = f"{_LEASES} SELECT consumer, seq, greatest(deadline_ms, {NOW}) + seq % 5 * 1000 AS deadline_ms FROM leases WHERE seq % 5 <= 3"


def dlv_restart(s, d):
    return delivery.restarted(_leases(s, d))


DLV_RESTART = f"{_LEASES} SELECT consumer, seq, attempt + 1 AS attempt FROM leases"


def ord_unsub_limit(s, d):
    """The first matches of a subscription that ends after a number of them."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ev.table(s, d, "events").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("user_id") % 5 + 1).select("user_id", "event_id")


ORD_UNSUB_LIMIT = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= user_id % 5 + 1"


def agg_due_age(s, d):
    """How long each consumer's oldest due message has waited, at least 0."""
    return _pending(s, d).groupBy("consumer").agg(F.greatest(NOW - F.min("scheduled_ms"), F.lit(0)).alias("age_ms"))


AGG_DUE_AGE = f"{_LEASES} SELECT consumer, greatest({NOW} - min(scheduled_ms), 0) AS age_ms FROM pending GROUP BY consumer"


def agg_scale_gate(s, d):
    """By workload: throughput kept (at least 70 %) and latency grown (at most 150 %) from the smallest to the largest case."""
    at = F.struct("l_quantity", "l_linenumber", "l_orderkey")
    g = ev.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("ack"))
    first, last = (lambda c: F.min_by(c, at)), (lambda c: F.max_by(c, at))
    one = g.agg(F.count("*").alias("n"), first("l_extendedprice").alias("t0"), last("l_extendedprice").alias("t1"), first("l_partkey").alias("p0"), last("l_partkey").alias("p1"))
    kept, grown = F.col("t1") / F.col("t0") * 100, F.col("p1") / F.col("p0") * 100
    return one.filter("n > 1").select("mode", "ack", F.round(kept, 4).alias("kept"), F.round(grown, 4).alias("grown"), ((kept >= 70) & (grown <= 150)).alias("passed"))


AGG_SCALE_GATE = """WITH r AS (SELECT l_returnflag AS mode, l_linestatus AS ack, l_extendedprice AS t, l_partkey AS p, row_number() OVER w AS a, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity, l_linenumber, l_orderkey)),
 o AS (SELECT mode, ack, max(CASE WHEN a = 1 THEN t END) AS t0, max(CASE WHEN a = n THEN t END) AS t1, max(CASE WHEN a = 1 THEN p END) AS p0, max(CASE WHEN a = n THEN p END) AS p1 FROM r WHERE n > 1 GROUP BY mode, ack)
 SELECT mode, ack, round(CAST(t1 AS DOUBLE) / t0 * 100, 4) AS kept, round(CAST(p1 AS DOUBLE) / p0 * 100, 4) AS grown, CAST(t1 AS DOUBLE) / t0 * 100 >= 70 AND CAST(p1 AS DOUBLE) / p0 * 100 <= 150 AS passed FROM o"""


def agg_alert_hold(s, d):
    """Spells of at least two consecutive days with seven or more events of a type."""
    days = ev.table(s, d, "events").groupBy("event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86_400_000).alias("day")).agg(F.count("*").alias("n")).filter("n >= 7")
    spell = F.col("day") - F.row_number().over(Window.partitionBy("event_type").orderBy("day"))
    return days.withColumn("_s", spell).groupBy("event_type", "_s").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("_s").filter("last_day > first_day")


AGG_ALERT_HOLD = """WITH h AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 7), g AS (SELECT *, day - row_number() OVER (PARTITION BY event_type ORDER BY day) AS s FROM h)
 SELECT event_type, min(day) AS first_day, max(day) AS last_day FROM g GROUP BY event_type, s HAVING max(day) > min(day)"""


def agg_changes(s, d):
    """How often each user's event type changes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    moved = (F.col("event_type") != F.lag("event_type").over(w)).cast("int")
    return ev.table(s, d, "events").select("user_id", moved.alias("c")).groupBy("user_id").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("changes"))


AGG_CHANGES = "WITH c AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events) SELECT user_id, CAST(coalesce(sum(CAST(c AS INTEGER)), 0) AS BIGINT) AS changes FROM c GROUP BY user_id"

BOUNDS = (5000, 20000, 40000, 60000)


def agg_histogram_quantile(s, d):
    """The 0.9 quantile read from cumulative buckets, linear within a bucket; the top bound beyond the last."""
    counts = [F.count_if(F.col("l_extendedprice") <= b).cast("double").alias(f"c{b}") for b in BOUNDS]
    g = ev.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), *counts)
    out, rank = F.lit(float(BOUNDS[-1])), F.col("n") * 0.9
    for low, b in reversed(list(zip((0, *BOUNDS), BOUNDS))):
        below = F.col(f"c{low}") if low else F.lit(0.0)
        out = F.when(F.col(f"c{b}") >= rank, low + (b - low) * (rank - below) / (F.col(f"c{b}") - below)).otherwise(out)
    return g.select("l_returnflag", F.round(out, 4).alias("p90"))


_CASES = " ".join(f"WHEN c{b} >= n * 0.9e0 THEN {lo} + {b - lo} * (n * 0.9e0 - {f'c{lo}' if lo else 0}) / (c{b} - {f'c{lo}' if lo else 0})" for lo, b in zip((0, *BOUNDS), BOUNDS))
AGG_HISTOGRAM_QUANTILE = f"WITH g AS (SELECT l_returnflag, count(*) AS n, {', '.join(f'CAST(count(*) FILTER (l_extendedprice <= {b}) AS DOUBLE) AS c{b}' for b in BOUNDS)} FROM lineitem GROUP BY 1) SELECT l_returnflag, round(CASE {_CASES} ELSE {BOUNDS[-1]}.0 END, 4) AS p90 FROM g"


def agg_regions(s, d):
    """Distinct regions among the suppliers of each part."""
    place = ev.table(s, d, "supplier").join(ev.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    return ev.table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.count_distinct("n_regionkey").alias("regions"))


AGG_REGIONS = "SELECT l_partkey, count(DISTINCT n_regionkey) AS regions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_partkey"


def rep_safe_leader(s, d):
    """The first available replica that holds the prefix a majority has: suppliers as nodes, order keys as offsets."""
    r = ev.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 64).cast("long").alias("part"), (F.col("l_suppkey") % 5).cast("long").alias("node")).agg(F.max("l_orderkey").cast("long").alias("at"))
    per = r.groupBy("part").agg(F.sort_array(F.collect_list("at"), asc=False).alias("o"), F.collect_list(F.struct("node", "at")).alias("r"))  # at most a replica set's size
    mark = F.get("o", F.floor(F.size("o") / 2).cast("int"))
    return per.withColumn("mark", mark).select("part", F.col("mark").alias("high_watermark"), F.array_min(F.transform(F.filter("r", lambda x: (x["at"] >= F.col("mark")) & ((x["node"] + F.col("part")) % 4 != 0)), lambda x: x["node"])).alias("leader"))


REP_SAFE_LEADER = """WITH r AS (SELECT l_partkey % 64 AS part, l_suppkey % 5 AS node, max(l_orderkey) AS reached FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY reached DESC) AS i, count(*) OVER (PARTITION BY part) AS n FROM r),
 m AS (SELECT part, reached AS mark FROM k WHERE i = n // 2 + 1) SELECT m.part, mark AS high_watermark, min(node) FILTER (reached >= mark AND (node + m.part) % 4 <> 0) AS leader FROM m JOIN r ON m.part = r.part GROUP BY m.part, mark"""


def rep_catch_up(s, d):
    """Offsets a follower lacks below the leader's end, per part."""
    held = ev.table(s, d, "lineitem").select((F.col("l_orderkey") % 32).cast("long").alias("part"), F.col("l_orderkey").cast("long").alias("off")).distinct()
    return held.join(held.filter("off % 13 <> 5"), ["part", "off"], "left_anti")


REP_CATCH_UP = "SELECT DISTINCT l_orderkey % 32 AS part, l_orderkey AS off FROM lineitem WHERE l_orderkey % 13 = 5"


def enc_round_trip(s, d):
    """Payloads after authenticated encryption and decryption, bound to the user."""
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.col("user_id").cast("string").cast("binary")
    sealed = ev.table(s, d, "events").select("event_id", F.aes_encrypt(F.col("props").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 24)), aad).alias("sealed"), aad.alias("aad"))
    return sealed.select("event_id", F.aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), "aad").cast("string").alias("props"))


ENC_ROUND_TRIP = "SELECT event_id, props FROM events"


def qta_reserve(s, d):
    """Orders as reservations of 100 tenants."""
    o, n = ev.table(s, d, "orders"), F.col("o_orderkey")
    amounts = {"connections": n % 2, "memory_bytes": n % 7 * 100, "disk_bytes": n % 11 * 1000, "tasks": n % 3, "background_tasks": n % 5}
    rows = o.select((F.col("o_custkey") % 100).cast("string").alias("tenant"), n.cast("long").alias("seq"), *[c.cast("long").alias(k) for k, c in amounts.items()])
    return folds.reservations(rows, {"connections": 40, "memory_bytes": 20_000, "disk_bytes": 300_000, "tasks": 60, "background_tasks": 110})


def rep_ship(s, d):
    """Orders as chunks of ten offsets, of which some come late, twice, changed, or with an old token."""
    o, n = ev.table(s, d, "orders"), F.col("o_orderkey")
    at = F.row_number().over(Window.partitionBy(n % 16).orderBy("o_orderkey")) - F.when(n % 17 == 3, 1).when(n % 19 == 4, 2).otherwise(0)
    rows = o.select(F.lit("s").alias("stream"), (n % 16).cast("int").alias("part"), n.cast("long").alias("seq"), at.alias("i"), F.when(n % 23 == 5, 6).otherwise(7).alias("token"))
    return folds.shipped(rows.withColumns({"first_off": (F.col("i") * 10).cast("long"), "last_off": (F.col("i") * 10 + 9).cast("long"), "checksum": F.sha2(F.col("i").cast("string"), 256)}), 7)


def grp_generations(s, d):
    """Events as joins, heartbeats and leaves of ten members in groups by user."""
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").when(F.col("event_type") == "purchase", "join").otherwise("heartbeat")
    e = ev.table(s, d, "events").select(F.col("user_id").cast("string").alias("group_id"), F.col("event_id").cast("long").alias("seq"), kind.alias("kind"), F.concat(F.lit("m"), (F.col("event_id") % 10).cast("string")).alias("member"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_id") % 9 == 0, 0).cast("long").alias("generation"))
    return folds.group_generations(e, 7 * 86_400_000)


BROKERS = [{"node": i, "region": f"r{i % 3}", "disk_used": 10 * i, "disk_capacity": 100, "partitions": 0, "leaders": 0, "throughput": i, "eligible": i != 2} for i in range(1, 7)]


def plc_moves(s, d):
    """Customers as partitions of clusters by nation, with three replicas each."""
    c, k = ev.table(s, d, "customer"), F.col("c_custkey")
    replicas = F.array(*[((k + i) % 6 + 1).cast("int") for i in (0, 1, 3)])
    return folds.planned_moves(c.select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_mktsegment").alias("stream"), k.cast("int").alias("part"), replicas.alias("replicas"), F.get(replicas, F.lit(0)).alias("leader"), F.expr("cast(array() as array<string>)").alias("allowed_regions"), F.lit(2).alias("min_regions")), BROKERS)


def sch_compatible(s, d):
    """Each policy on each pair of definitions: number of added and required fields from orders' priorities."""
    rows = ev.table(s, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ("none", "backward", "forward", "full"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("policy"))
    definition = lambda r: F.concat(F.lit('{"required":['), F.when(r % 2 == 0, '"a"').otherwise('"a","b"'), F.lit('],"properties":{"a":{},"b":{'), F.when(r % 3 == 0, '"default":1').otherwise(""), F.lit("}}}"))
    k = F.col("o_orderkey")
    return rows.select("o_orderkey", "policy", compatibility.compatible(F.col("policy"), F.lit("json"), definition(k), F.lit("json"), definition(F.floor(k / 4))).alias("ok"))


SCH_COMPATIBLE = """WITH r AS (SELECT o_orderkey, ['none', 'backward', 'forward', 'full'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS policy, o_orderkey % 2 = 1 AS ob, o_orderkey % 3 = 0 AS od, (o_orderkey // 4) % 2 = 1 AS nb, (o_orderkey // 4) % 3 = 0 AS nd FROM orders),
 c AS (SELECT *, NOT nb OR ob OR nd AS back, NOT ob OR nb OR od AS forth FROM r) SELECT o_orderkey, policy, CASE policy WHEN 'none' THEN true WHEN 'backward' THEN back WHEN 'forward' THEN forth ELSE back AND forth END AS ok FROM c"""


def stm_windows(s, d):
    """Daily counts by type of a stream, kept incrementally."""
    got = stream.drained(stream.windowed(stream.read(s, d, "events"), "1 day", "event_type", late=None), "windows", "update")
    return stream.latest(got, ["start_ms", "event_type"], "n")


STM_WINDOWS = "SELECT epoch_us(date_trunc('day', ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL"


def stm_view(s, d):
    """Each user's last event, kept incrementally; equal to a rebuild."""
    return stream.latest(stream.drained(stream.view(stream.read(s, d, "events"), "user_id", F.col("event_type"), "event_id"), "view", "update"), ["user_id"], "position", "value")


STM_VIEW = "SELECT user_id, max(event_id) AS position, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id"


def stm_once(s, d):
    """A stream whose every event comes twice, each taken once."""
    twice = stream.read(s, d, "events").select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    return stream.drained(stream.once(twice, ["event_id"], "400 days"), "once").select("event_id")


STM_ONCE = "SELECT event_id FROM events"

ALL = {
    f.__name__: (f, globals().get(f.__name__.upper()) or getattr(foldsql, f.__name__.upper(), None))
    for f in (dlv_expiry, dlv_next_pull, dlv_head_of_line, dlv_valid_acks, dlv_extend, dlv_restart, ord_unsub_limit, agg_due_age, agg_scale_gate, agg_alert_hold, agg_changes, agg_histogram_quantile, agg_regions, rep_safe_leader, rep_catch_up, enc_round_trip, qta_reserve, rep_ship, grp_generations, plc_moves, sch_compatible, stm_windows, stm_view, stm_once)
}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
