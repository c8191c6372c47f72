"""All registered queries: name -> callable(spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.fixtures import Views, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(views) under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = duck(sql)
        return f

    return add


from foliant.plans import classify, golden, ingest, intake, inventory, learning, migration, retrieval, runplans, selection, sources, temporal, workset  # noqa: E402, F401
