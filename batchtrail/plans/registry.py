"""Registry of named queries: key -> (Spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the test
tables of ``sf_dir``; the oracle SQL is the same question in plain SQL over the
fixture views (prefixed with their ``WITH`` clauses when served).
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from batchtrail.sources.fixtures import with_fixtures
from batchtrail.sources.process_tables import ProcessTables, from_fixtures

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}
_TABLES: WeakKeyDictionary[SparkSession, dict[str, ProcessTables]] = WeakKeyDictionary()


def tables_for(spark: SparkSession, sf_dir: str) -> ProcessTables:
    known = _TABLES.setdefault(spark, {})
    if sf_dir not in known:
        known[sf_dir] = from_fixtures(spark, sf_dir)
    return known[sf_dir]


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, tables, sf_dir) -> DataFrame`` under ``key``."""
    def wrap(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, tables_for(spark, sf_dir), sf_dir)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = build
        if sql is not None:
            _ORACLE[key] = with_fixtures(sql)
        return fn
    return wrap


def all_queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load() -> None:
    # importing the modules registers their queries
    from batchtrail.plans import catalog  # noqa: F401
