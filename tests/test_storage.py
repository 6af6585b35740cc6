"""Sinks and backups: against DuckDB, and a conflict that must stop a write."""

import pytest
from test_oracle import SF, canonical, duck  # noqa: F401

from rillmark.plans import storage
from rillmark.sources import sinks


@pytest.mark.parametrize("name", sorted(storage.ALL))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    df = storage.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(storage.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names)
    assert got


def test_conflict(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([("s", 0, *x) for x in r], "stream string, part int, off long, payload string")
    path = f"file://{tmp_path}/sink"
    sinks.append_once(rows((0, "a"), (1, None)), path, "0")
    sinks.append_once(rows((1, None), (2, "c"), (2, "c")), path, "1")
    for bad in ((1, ""), (0, "x")):
        with pytest.raises(ValueError):
            sinks.append_once(rows(bad), path, "2")
    with pytest.raises(ValueError):
        sinks.append_once(rows((5, "a"), (5, "b")), path, "2")
    assert sorted((r.off, r.payload, r.batch) for r in spark.read.parquet(path).collect()) == [(0, "a", 0), (1, None, 0), (2, "c", 1)]


def test_export_keeps_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, 'a "b", c\nd')], "k int, v string")
    for kind in ("json", "csv"):
        assert sorted(map(tuple, sinks.exported(rows.filter("k < 3") if kind == "csv" else rows, f"file://{tmp_path}/{kind}", kind).collect()))[:2] == [(1, None), (2, "")]
