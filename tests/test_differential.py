"""Every registered query against its DuckDB statement, on whole driver tables."""

import pytest

import __spark_entry__ as registry
from tools.compare import difference, duck


OWN = set(registry.queries()) - set(registry.LLM_QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_statement():
    assert OWN == set(registry.oracle_sql()) - set(registry.LLM_SQL)


@pytest.mark.parametrize("key", sorted(OWN))
def test_matches_sql(spark, con, sf_dir, key):
    rows = registry.queries()[key](spark, sf_dir).toPandas()
    assert difference(rows, con.execute(registry.oracle_sql()[key]).df()) is None


def test_entry_runs(spark):
    assert registry.entry(spark).count() >= 1
