"""Delivery, folds, compatibility and streams: against DuckDB, and against literal cases."""

import datetime
import functools

import pytest
from pyspark.sql import functions as F
from test_oracle import SF, canonical, duck  # noqa: F401

from rillmark.operators import compatibility, folds
from rillmark.plans import control


@pytest.mark.parametrize("name", sorted(control.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    df = control.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(control.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names)
    assert got


@pytest.mark.parametrize("name", sorted(set(control.ALL) - set(control.oracle_sql())))
def test_has_rows(spark, name):
    assert control.queries()[name](spark, SF).count() > 0


def test_reservations(spark):
    rows = [("t", 1, 1, 5, 0, 0, 0), ("t", 2, 1, 6, 0, 0, 0), ("t", 3, 2, 6, 0, 0, 0), ("t", 4, 1, 5, 0, 0, 0), ("u", 1, 3, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "tenant string, seq long, connections long, memory_bytes long, disk_bytes long, tasks long, background_tasks long")
    got = folds.reservations(df, {"connections": 2, "memory_bytes": 10, "disk_bytes": 1, "tasks": 1, "background_tasks": 1}).orderBy("tenant", "seq").collect()
    assert [r.rejected_by for r in got] == [None, "memory_bytes", "connections", None, "connections"]


def test_shipped(spark):
    rows = [(1, 7, 0, 9, "a"), (2, 7, 10, 19, "b"), (3, 7, 10, 19, "b"), (4, 7, 10, 19, "x"), (5, 7, 0, 9, "a"), (6, 7, 30, 39, "c"), (7, 6, 20, 29, "c"), (8, 7, 29, 20, "c"), (9, 7, 20, 29, "c")]
    df = spark.createDataFrame([("s", 0, *r) for r in rows], "stream string, part int, seq long, token int, first_off long, last_off long, checksum string")
    got = folds.shipped(df, 7).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["applied", "applied", "duplicate", "conflict", "stale", "gap", "fenced", "invalid", "applied"]


def test_generations(spark):
    rows = [(1, "join", "a", 0), (2, "join", "b", 10), (3, "heartbeat", "a", 90), (4, "heartbeat", "a", 115), (5, "leave", "a", 120), (6, "leave", "a", 121), (7, "join", "a", 130), (8, "join", "a", 131), (9, "leave", "a", 132, 5), (10, "heartbeat", "a", 133, 6), (11, "leave", "a", 134, 6)]
    df = spark.createDataFrame([("g", *r, *[None] * (5 - len(r))) for r in rows], "group_id string, seq long, kind string, member string, ts_ms long, generation long")
    got = folds.group_generations(df, 100).orderBy("seq").collect()
    assert [(r.generation, r.members) for r in got] == [(1, ["a"]), (2, ["a", "b"]), (2, ["a", "b"]), (3, ["a"]), (4, []), (4, []), (5, ["a"]), (6, ["a"]), (6, ["a"]), (6, ["a"]), (7, [])]
    assert [r.outcome for r in got] == ["ok"] * 5 + ["unknown", "ok", "ok", "stale", "ok", "ok"]


def test_sticky():
    assert folds.sticky({0: "a", 1: "a", 2: "a", 3: "b"}, ["a", "b"], 4) == {0: "a", 1: "a", 2: "b", 3: "b"}
    assert folds.sticky({0: "gone"}, ["b", "a"], 3) == {0: "a", 1: "b", 2: "a"}


def test_moves(spark):
    brokers = [{"node": n, "region": r, "disk_used": u, "disk_capacity": 100, "partitions": 1, "leaders": 0, "throughput": 0, "eligible": e} for n, r, u, e in ((1, "x", 90, True), (2, "x", 10, True), (3, "y", 0, True), (4, "x", 5, False))]
    df = spark.createDataFrame([("c", "s", 0, [1], 1, [], 2), ("c", "s", 1, [1], 1, ["y"], 1), ("c", "s", 2, [3], 3, [], 1)], "cluster string, stream string, part int, replicas array<int>, leader int, allowed_regions array<string>, min_regions int")
    got = sorted((r.part, r.src, r.dst) for r in folds.planned_moves(df, brokers).collect())
    assert got == [(0, 1, 3), (1, 1, 3)]  # part 0 needs two regions, so its replica can't stay in x


@pytest.mark.parametrize(
    "kind, old, new, back, forth",
    [
        ("json", '{"required":["a"],"properties":{"a":{}}}', '{"properties":{"a":{},"b":{}}}', True, False),
        ("json", '{"required":["a"],"properties":{"a":{}}}', '{"required":["a","b"],"properties":{"a":{},"b":{}}}', False, False),
        ("json", '{"properties":{"a":{}}}', '{"required":["b"],"properties":{"b":{"default":null}}}', True, False),
        ("json", "{}", "not json", False, False),
        ("avro", '{"fields":[{"name":"a"}]}', '{"fields":[{"name":"a"},{"name":"b","default":0}]}', True, False),
        ("avro", '{"fields":[{"name":"a"}]}', '{"fields":[{"name":"a"},{"name":"b"}]}', False, False),
        ("protobuf", "string a = 1; int32 b = 2;", "string a = 1; int32 b = 2; bool c = 3;", True, False),
        ("protobuf", "string a = 1;", "bytes a = 1;", False, False),
    ],
)
def test_compatible(spark, kind, old, new, back, forth):
    df = spark.createDataFrame([(kind, old, new)], "k string, o string, n string")
    verdict = [compatibility.compatible(F.lit(p), F.col("k"), F.col("o"), F.col("k"), F.col("n")).alias(p) for p in ("none", "backward", "forward", "full")]
    assert tuple(df.select(*verdict).first()) == (True, back, forth, back and forth)
    assert df.select(compatibility.compatible(F.lit("full"), F.lit("json"), F.col("o"), F.lit("avro"), F.col("n"))).first()[0] is False


def test_windows_of_overlapping_files(spark, tmp_path, monkeypatch):
    for k in range(3):  # every file has every day
        rows = [(10 * k + i, datetime.datetime(2024, 1, 1 + i, k), "view") for i in range(4)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(control.stream, "read", functools.partial(control.stream.read, files_per_trigger=1))
    assert sorted(r.n for r in control.stm_windows(spark, str(tmp_path)).collect()) == [3] * 4
