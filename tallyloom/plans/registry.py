"""Register of queries: a name, a builder over the test tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.views import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return build

    return wrap


def _runner(build):
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, build in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
