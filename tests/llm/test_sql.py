"""The operators that SQL can say, against DuckDB on the whole tables."""

import duckdb
import pytest

from rillmark.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(q.oracle_sql()[name])
    names = sorted(c[0] for c in cur.description)
    place = [[c[0] for c in cur.description].index(c) for c in names]
    df = q.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = sorted((rounded([r[i] for i in place]) for r in cur.fetchall()), key=repr)
    assert sorted((rounded(r) for r in df.select(*names).collect()), key=repr) == want and want
