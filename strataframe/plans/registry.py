"""All queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import SCHEMAS, views

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when they are imported.
MODULES = ("catalog", "files", "databases", "relational", "joins", "aggregates", "windows", "scalars", "vectors", "streams", "extensions")


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"two queries are named {name}")
        ENTRIES[name] = Entry(query, sql)
        return query

    return add


def register_sql(name: str, sql: str, duckdb: str | None = None) -> None:
    """A query in SQL over the declared tables that it names. duckdb: its SQL for DuckDB, where that differs."""
    names = [t for t in SCHEMAS if re.search(rf"\b{t}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *names)
        return spark.sql(sql)

    register(name, duckdb or sql)(query)


def _loaded() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f".{module}", __package__)
    return ENTRIES


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in _loaded().items() if e.sql}
