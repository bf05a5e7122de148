"""Every query of the core that has SQL gives the same rows as DuckDB."""

import decimal

import pytest
from conftest import DATA

from mnemolith.plans import registry


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 4) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    result = oracle.execute(registry.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
