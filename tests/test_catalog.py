"""The queries of the catalog against DuckDB, and literal cases of their operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rillmark.functions import workload
from rillmark.operators import budgets, middleware
from rillmark.plans import catalog as q

from test_oracle import SF, TABLES, canonical


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    df = q.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names) and got


def test_deterministic_index(spark):
    def plain(v, n, seed):
        v ^= seed
        v ^= v >> 12
        v = (v ^ v << 25) % 2**64
        v ^= v >> 27
        return v * 0x2545F4914F6CDD1D % 2**64 % n

    rows = [0, 1, 7, 2**40, 2**63 - 1, -1, -(2**63)]
    got = spark.createDataFrame([(r,) for r in rows], "s long").select(workload.deterministic_index(F.col("s"), 1009, 99)).collect()
    assert [r[0] for r in got] == [plain(r % 2**64, 1009, 99) for r in rows]


def test_ack_window_of_one(spark):
    rows = [(1, i, off) for i, off in enumerate([1, 2, 0, 2, 1])]
    got = sorted(tuple(r)[1:] for r in budgets.ack_window(spark.createDataFrame(rows, "consumer long, seq long, off long"), 1).collect())
    assert got == [(0, "acked", 0), (1, "window", 0), (2, "acked", 2), (3, "acked", 3), (4, "stale", 3)]


def test_transfers(spark):
    zero = dict.fromkeys(budgets.DIMENSIONS, 0)
    rows = [(0, None, "a", 5), (1, "a", "b", 3), (2, "a", "b", 3), (3, None, "b", 8), (4, "b", "a", 0), (5, "b", "b", 99), (6, None, "b", 7)]
    df = spark.createDataFrame([{"pool": 1, "seq": s, "source": a, "target": b, **zero, "tasks": n} for s, a, b, n in rows], "pool long, seq long, source string, target string, " + ", ".join(f"{d} long" for d in budgets.DIMENSIONS))
    got = {r.seq: r.outcome for r in budgets.transfers(df, dict.fromkeys(budgets.DIMENSIONS, 10)).collect()}
    assert got == {0: "reserved", 1: "moved", 2: "lacking", 3: "full", 4: "moved", 5: "moved", 6: "reserved"}


def test_registered_ids(spark):
    rows = [("a", 1, '{"required":["x"],"properties":{"x":{}}}'), ("b", 2, "{}"), ("a", 3, "{}"), ("a", 4, '{"properties":{"x":{}}}'), ("b", 1 << 21, "{}")]
    got = {r.seq: (r.version, r.id) for r in budgets.registered(spark.createDataFrame(rows, "subject string, seq long, definition string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (None, None), 4: (2, 3), 1 << 21: (2, 4)}


def test_middleware_policies():
    bad = lambda m: ("continue", {"seq": 1}, [])
    many = lambda m: ("continue", {}, [{}] * 9)
    message = {"subject": "a/b", "payload": "p"}
    for f in (bad, many):
        for policy, want in (("open", "continue"), ("drop", "drop")):
            assert middleware.processed(message, "ingress", (middleware.Module("m", "ingress", "a/**", f, policy),))[:2] == (want, message)
        with pytest.raises(RuntimeError):
            middleware.processed(message, "ingress", (middleware.Module("m", "ingress", "a/**", f),))
    subject = lambda m: ("continue", {"subject": "x"}, [])
    module = middleware.Module("m", "after_commit", "a/b", subject, "open")
    assert middleware.processed(message, "after_commit", (module,))[1] == message
    r = middleware.Registry()
    with pytest.raises(ValueError):
        r.rollback()
    assert (r.install([module]), r.install([]), r.rollback(), r.rollback()) == (1, 2, 1, 2)
    with pytest.raises(ValueError):
        r.install([middleware.Module("m", "ingress", "a/**/b", subject)])


def test_torn_file_is_left_out(spark):
    import glob

    path = q.storage.written_log(q._log(spark, SF).select("stream", "part", "off", "seq", "subject", "payload"), "torn")
    file = sorted(glob.glob(path.removeprefix("file:") + "/stream=telemetry/part=1/*.parquet"))[0]
    with open(file, "r+b") as f:
        f.truncate(100)
    left = q.storage.replayed(spark, path)
    assert left.filter("part = 1 and stream = 'telemetry'").count() == 0 and left.filter("part = 2").count() > 0


def test_view_registry(spark):
    from rillmark.operators.views import View, ViewRegistry

    log, r = q._log(spark, SF), ViewRegistry(2)
    r.create(View("a", "t", "purchases"))
    r.create(View("b", "t", "telemetry", "events/click/*", F.col("key")))
    for bad in (View("a", "t", "x"), View("c", "t", "x"), View("no name", "u", "x"), View("d", "u", "x", "a/**/b")):
        with pytest.raises(ValueError):
            r.create(bad)
    assert r.list("t") == ["a", "b"] and r.list("u") == []
    rows = r.rebuild("t", "b", log)
    assert rows.count() == log.filter("event_type = 'click'").select("key").distinct().count() > 0
    r.pause("t", "b")
    assert r.rebuild("t", "b", log.limit(0)) is rows
    r.resume("t", "b")
    assert r.rebuild("t", "b", log.limit(0)).count() == 0
    r.delete("t", "b")
    with pytest.raises(KeyError):
        r.get("t", "b")


def test_partition_commands(spark):
    from rillmark.operators import metadata

    c = lambda seq, kind, leader, epoch, offset=None, checksum=None, generation=None, phase=None, replicas=None, active=None: ("s", 0, seq, kind, leader, epoch, offset, checksum, generation, phase, replicas, active)
    rows = [c(0, "commit", 1, 1, 0, 9), c(1, "commit", 1, 1, 0, 9), c(2, "commit", 1, 1, 0, 8), c(3, "commit", 1, 1, 2, 9), c(4, "leader", 2, 3), c(5, "leader", 4, 2), c(6, "leader", 2, 2), c(7, "commit", 1, 1, 1, 9), c(8, "commit", 2, 2, 1, 7)]
    rows += [c(9, "reconfigure", 2, 2, None, None, 2, "stable", [1, 2], [1, 2]), c(10, "reconfigure", 2, 2, None, None, 1, "catching_up", [1, 2, 4], [1, 2]), c(11, "commit", 2, 2, 2, 1), c(12, "reconfigure", 2, 2, 0, 7, 1, "activating", [1, 2, 4], [1, 2, 4])]
    rows += [c(13, "reconfigure", 2, 2, 1, 7, 1, "activating", [1, 2, 4], [1, 2, 4]), c(14, "reconfigure", 2, 2, None, None, 1, "stable", [1, 2, 4], [2]), c(15, "reconfigure", 4, 2, None, None, 1, "stable", [1, 2, 4], [2, 4]), c(16, "reconfigure", 4, 3, None, None, 1, "stable", [1, 2, 4], [2, 4]), c(17, "commit", 4, 3, 2, 5), c(18, "leader", 1, 4)]
    ddl = "stream string, part int, seq long, kind string, leader long, epoch long, offset long, checksum long, generation long, phase string, replicas array<long>, active array<long>"
    got = sorted(metadata.partition_commands(spark.createDataFrame(rows, ddl), [1, 2, 3], 1).collect(), key=lambda r: r.seq)
    assert [r.seq for r in got if r.ok] == [0, 1, 6, 8, 10, 13, 16, 17]
    assert (got[-1].leader, got[-1].epoch, got[-1].next_offset, got[-1].generation) == (4, 3, 3, 1)
    grown = metadata.expansions(spark.createDataFrame([("s", 0, 4, 2), ("s", 1, 3, 3), ("s", 2, 8, 2), ("s", 3, 8, 3)], "stream string, seq long, partitions long, epoch long"))
    assert [r.ok for r in sorted(grown.collect(), key=lambda r: r.seq)] == [True, False, False, True]
