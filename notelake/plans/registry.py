"""All registered queries: name, Spark function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``(spark, sf_dir) -> DataFrame`` under a name."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def _load() -> None:
    import importlib

    for module in ("text_queries", "relation_queries", "note_queries", "more_queries", "curation_queries", "index_queries", "upkeep_queries", "record_queries", "layout_queries", "pack_queries", "focus_queries", "rule_queries", "identity_queries"):
        importlib.import_module(f"notelake.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
