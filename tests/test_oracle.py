"""Every query with SQL, against DuckDB on the same tables."""

import datetime
import os

import duckdb
import pytest

from rillmark.plans import queries as q

SF = os.environ.get("RILLMARK_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.ALL))
def test_same_as_duckdb(spark, duck, name):
    df = q.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(cur.fetchall(), names)
    assert got or name in ("idm_gaps", "src_point_read")
