"""Each registered query against its SQL in DuckDB, on the driver's tables."""

import os

import duckdb
import pytest

from tessera import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no tables")


def rows(table):
    table = table[sorted(table.columns)]
    return sorted((tuple(None if x != x else round(x, 7) if isinstance(x, float) else x for x in r) for r in table.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        assert rows(got) == rows(want)
    else:
        assert len(got)
