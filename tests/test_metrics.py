"""Metrics over other queries: against DuckDB; their names are one series each."""

import pytest
from test_oracle import SF, canonical, duck  # noqa: F401

from rillmark.plans import metrics


@pytest.mark.parametrize("name", sorted(metrics.ALL))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    df = metrics.queries()[name](spark, SF)
    assert df.columns == ["name", "labels", "value"]
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(metrics.oracle_sql()[name])
    assert got == canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert got


def test_each_name_once():
    names = [m for part in (metrics.DELIVERY, metrics.STORAGE, metrics.CONTROL) for _, _, found in part for m in found]
    assert len(names) == len(set(names)) >= 60
