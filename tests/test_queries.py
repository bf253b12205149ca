"""Registered queries against their DuckDB counterparts on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__
from callweave.plans import registry
from callweave.sources.testdata import _INPUTS

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in _INPUTS:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_oracle(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {quoted} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_oracle_has_a_query():
    assert registry.oracle_sql().keys() == registry.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert registry.FLAGSHIP in registry.queries()
