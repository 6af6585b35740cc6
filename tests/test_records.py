"""Budgets, registries, storage and metrics: against DuckDB, and against literal cases."""

import pytest
from test_oracle import SF, canonical, duck  # noqa: F401

from rillmark.operators import ledgers
from rillmark.plans import records


@pytest.mark.parametrize("name", sorted(records.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    df = records.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(records.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names)
    assert got


@pytest.mark.parametrize("name", sorted(set(records.ALL) - set(records.oracle_sql())))
def test_has_rows(spark, name):
    assert records.queries()[name](spark, SF).count() > 0


def _log(spark, sizes):
    return spark.createDataFrame([("s", 0, i, b) for i, b in enumerate(sizes)], "stream string, part int, off long, bytes long")


def test_batches(spark):
    sizes = [5, 5, 1, 20, 1, 1, 1, 11]
    got = [r.batch for r in ledgers.ingress_batches(_log(spark, sizes), 3, 10).orderBy("off").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 2, 3]
    got = [r.batch for r in ledgers.connector_batches(_log(spark, sizes), 3, 10).orderBy("off").collect()]
    assert got == [0, 0, 1, None, 1, 1, 2, None]


def test_credit(spark):
    rows = [(1, "grant", 2, 1, 10), (2, "grant", 1, 1, 3), (3, "message", 0, 0, 5), (4, "message", 0, 0, 3), (5, "message", 0, 0, 1), (6, "grant", 2, 1, 0), (7, "message", 0, 0, 5)]
    df = spark.createDataFrame([(9, *r) for r in rows], "consumer long, seq long, kind string, connection long, messages long, bytes long")
    assert [r.connection for r in ledgers.credited(df).orderBy("seq").collect()] == [2, 1, None, 2]


def test_transactions(spark):
    rows = [(1, "begin", "a", 1, 0), (2, "write", "a", 1, 5), (3, "write", "a", 1, 9), (4, "commit", "a", 1, 9), (5, "prepare", "a", 1, 9), (6, "write", "a", 1, 9), (7, "commit", "a", 1, 9), (8, "abort", "a", 1, 9),
            (9, "begin", "b", 1, 10), (10, "begin", "c", 2, 10), (11, "commit", "b", 1, 11), (12, "begin", "d", 1, 11), (13, "prepare", "c", 2, 111), (14, "begin", "c", 3, 12), (15, "begin", "e", 2, 12), (16, "write", "zz", 2, 12), (17, "abort", "c", 2, 500)]
    df = spark.createDataFrame([(1, *r, 0, 6) for r in rows], "producer long, seq long, kind string, txn string, epoch long, ts_ms long, partition long, bytes long")
    out = ledgers.transactions(df, max_messages=5, max_bytes=10, max_partitions=1, max_duration_ms=100, max_open=1)
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["ok", "ok", "bytes", "not prepared", "ok", "not open", "ok", "terminal", "ok", "ok", "not prepared", "fenced", "timed out", "reused", "too many", "unknown", "ok"]


def test_roles_and_phases(spark):
    rows = [(1, "promote", 0, 0), (2, "promote", 0, 0), (3, "fence", 0, 0), (4, "failover", 2, 11), (5, "failover", 2, 10), (6, "demote", 0, 0)]
    df = spark.createDataFrame([("r", *r) for r in rows], "region string, seq long, kind string, token long, lag long")
    got = [(r.ok, r.token, r.role) for r in ledgers.region_roles(df, 10).orderBy("seq").collect()]
    assert got == [(True, 1, "primary"), (False, 1, "primary"), (True, 2, "fenced"), (False, 2, "fenced"), (True, 3, "primary"), (True, 4, "standby")]
    rows = [(1, "advance", False, 0), (2, "advance", False, 9), (3, "advance", True, 8), (4, "advance", True, 9), (5, "rollback", True, 9), (6, "advance", True, 9), (7, "advance", False, 0), (8, "advance", False, 0)]
    df = spark.createDataFrame([(1, *r, 9) for r in rows], "id long, seq long, kind string, quorum boolean, match_offset long, high_watermark long")
    p = ledgers.PHASES
    got = [(r.ok, r.phase) for r in ledgers.move_phases(df).orderBy("seq").collect()]
    assert got == [(True, p[1]), (False, p[1]), (False, p[1]), (True, p[2]), (False, p[2]), (True, p[3]), (True, p[4]), (True, p[4])]


def test_phases_of_one_seq_do_not_depend_on_arrival(spark):
    rows = [(1, 1, "rollback", True, 9), (1, 1, "advance", False, 0), (2, 1, "advance", True, 0), (2, 2, "advance", True, 9), (2, 2, "advance", False, 9), (2, 2, "advance", True, 0), (3, 1, "advance", True, 9), (3, 2, "rollback", False, 0), (3, 2, "advance", True, 9)]
    p = ledgers.PHASES
    want = [(1, 1, True, p[1]), (1, 1, True, "rolled_back"), (2, 1, True, p[1]), (2, 2, False, p[1]), (2, 2, False, p[1]), (2, 2, True, p[2]), (3, 1, True, p[1]), (3, 2, False, p[2]), (3, 2, True, p[2])]
    for arrived in (rows, rows[::-1], rows[4:] + rows[:4]):
        df = spark.createDataFrame([(*r, 9) for r in arrived], "id long, seq long, kind string, quorum boolean, match_offset long, high_watermark long").coalesce(1)
        assert sorted(tuple(r) for r in ledgers.move_phases(df).collect()) == want


def test_throttle_and_ledger(spark):
    rows = [(1, "start", 6), (2, "start", 5), (3, "start", 4), (4, "start", 0), (5, "finish", 0), (6, "start", 1), (7, "reset", 0), (8, "start", 1)]
    df = spark.createDataFrame([(1, *r) for r in rows], "node long, seq long, kind string, bytes long")
    got = [(r.started, r.active) for r in ledgers.throttled(df, 2, 10).orderBy("seq").collect()]
    assert got == [(True, 1), (False, 1), (True, 2), (False, 2), (None, 1), (False, 1), (None, 1), (True, 2)]
    rows = [(1, "reserve", 5), (2, "reserve", 6), (3, "release", 9), (4, "reserve", 10)]
    df = spark.createDataFrame([("t", *r, 0, 0, 0, 0) for r in rows], "tenant string, seq long, kind string, connections long, memory_bytes long, disk_bytes long, tasks long, background_tasks long")
    got = [(r.ok, r.used_connections) for r in ledgers.quota_ledger(df, dict.fromkeys(ledgers.DIMENSIONS, 10)).orderBy("seq").collect()]
    assert got == [(True, 5), (False, 5), (True, 0), (True, 10)]


def test_transfers(spark):
    brokers = [{"node": n, "leaders": k, "throughput": 0, "eligible": n != 4} for n, k in ((1, 5), (2, 3), (3, 3), (4, 0))]
    df = spark.createDataFrame([("c", "s", i, [1, 2, 3, 4], 1) for i in range(4)], "cluster string, stream string, part int, replicas array<int>, leader int")
    assert sorted((r.part, r.src, r.dst) for r in ledgers.leader_transfers(df, brokers).collect()) == [(0, 1, 2), (1, 1, 3)]
