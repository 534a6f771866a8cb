"""Every registered query against its SQL, on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline" and not n.startswith("op")))
def test_query_matches_sql(spark, con, name):
    ok, message = oracle_check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_sql():
    from millrace.plans import load_all

    queries, oracles = load_all()
    assert set(queries) == set(oracles) and set(queries) <= set(QUERIES)
