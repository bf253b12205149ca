"""Facts of the test tables hold every row of what they read."""

from pathlib import Path

import pytest

from callweave.plans import registry
from callweave.sources import testdata

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")

#: Independent of FACTS: what each fact must have one row for.
WHOLE = {
    "default_args": "select distinct coalesce(source, ''), coalesce(lang, ''), doc_id % 3, doc_id % 7, doc_id % 11, (n_chars // 1000) % 3 from documents",
    "exception_specs": "select distinct o_custkey % 200, o_orderpriority, o_orderstatus = 'F', o_orderkey % 13, o_orderkey % 5 from orders",
    "fn_globals": "select p_partkey from part",
    "overloads_flat": "select p_partkey from part",
    "deduction_guides": "select p_partkey from part",
    "adl_flat": "select 1 from lineitem join part on p_partkey = l_partkey",
    "ctad_vars": "select 1 from lineitem join part on p_partkey = l_partkey",
    "instantiations": "select 1 from lineitem join part on p_partkey = l_partkey",
}
QUERIES = ("adl_visibility", "ctad_fallback", "specialization_invisible", "normalize_types", "default_arg_divergence", "exception_spec_divergence", "static_init_order")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in testdata._INPUTS:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, duck, name):
    assert testdata.fact(spark, DATA, name).count() == duck.execute(f"select count(*) from ({WHOLE[name]})").fetchone()[0]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_of_whole_facts(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.execute(f"select {', '.join(f'x.{c}' for c in columns)} from ({registry.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want))
