"""Every registered query against its SQL in DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from foliant.plans import registry
from foliant.sources.fixtures import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def small(spark):
    """Small plans run faster uncompiled."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, small, duck):
    found = registry.QUERIES[name](small, SF_DIR)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in found.select(columns).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in want)
