"""Every registered query of the library against DuckDB."""

import pytest

from corpusflow.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    assert compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and all(r["answer"] for r in rows)
    assert {"hash_embed_retrieve"} == set(registry.QUERIES) - set(registry.ORACLES)
