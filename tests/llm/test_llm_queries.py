"""The optional queries: those with SQL against it, the others by their rows, on the smallest tables."""

import oracle_check
import pytest

from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, message = oracle_check.compare(spark, oracle_check.connect(SF), name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_all_operators_are_there():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
