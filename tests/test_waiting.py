"""Shared commits, waiting fetches, timers and versioned keys: against DuckDB, and literal cases."""

import pytest
from test_oracle import SF, canonical, duck  # noqa: F401

from rillmark.functions import sealing
from rillmark.operators import waiting as w
from rillmark.plans import waiting


@pytest.mark.parametrize("name", sorted(waiting.ALL))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    df = waiting.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(waiting.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names)
    assert got


def test_shared_commits(spark):
    rows = spark.createDataFrame([("s", 0, t) for t in (10, 10, 15, 20, 21, 40, None)] + [("s", 1, 12)], "stream string, part int, at_ms long")
    assert sorted(map(tuple, w.shared_commits(rows, 10).collect())) == [("s", 0, 10, 20, 4), ("s", 0, 21, 31, 1), ("s", 0, 40, 50, 1), ("s", 1, 12, 22, 1)]
    assert w.shared_commits(rows.limit(0), 10).collect() == []


def test_waiting_fetch(spark):
    fetches = spark.createDataFrame(
        [("a", 1, 1, 1, 0, 1000), ("a", 1, 1, 2, 10, 1000), ("a", 1, 2, 3, 10, 50), ("a", 1, 3, 4, 20, 9), ("a", 1, 4, 5, 20, 0), ("a", 1, 3, 6, 60, 300_001), ("a", 1, 1, 7, 500, 300_000), ("b", 2, 9, 8, 299_999, 300_000), (None, 2, 8, 9, 5, 10)],
        "topic string, consumer long, connection long, id long, at_ms long, wait_ms long")
    messages = spark.createDataFrame([("a", 500), ("a", 500), ("a", 10), ("b", 299_999), ("b", 599_999), (None, 7)], "topic string, ts_ms long")
    woken = w.woken(fetches, messages)
    assert {r.id: r.woken_ms for r in woken.collect()} == {1: 10, 2: 500, 3: None, 4: None, 5: None, 6: 500, 7: None, 8: 599_999, 9: 7}
    got = {r.id: (r.outcome, r.ended_ms) for r in w.admitted(woken, 1).collect()}
    assert got == {1: ("woken", 10), 2: ("woken", 500), 3: ("consumer_full", 10), 4: ("consumer_full", 20), 5: ("at_once", 20), 6: ("wait_too_long", 60), 7: ("timed_out", 300_500), 8: ("woken", 599_999), 9: ("woken", 7)}


def test_versions(spark):
    from pyspark.sql import functions as F

    ring = {1: b"k" * 32, 2: b"q" * 32}
    row = spark.range(1).select(F.lit(b"text").alias("p"), F.lit(b"user").alias("a"), F.lit(b"n" * 12).alias("n"))
    new = row.select("a", sealing.seal(F.col("p"), ring, F.col("n"), F.col("a")).alias("s"))
    assert new.first().s.key_version == 2 and bytes(new.first().s.ciphertext[:12]) == b"n" * 12
    read = lambda ring, aad: new.select(sealing.unseal(F.col("s"), ring, F.lit(aad)).alias("p")).first().p
    assert read(ring | {3: b"z" * 32}, b"user") == b"text"
    assert read({1: ring[1]}, b"user") is None and read(ring, b"other") is None and read({2: b"k" * 32}, b"user") is None
