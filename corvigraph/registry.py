"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_MODULES = ["relational", "scalars", "annotation", "resolution", "graphs", "ontology", "evaluation", "storage", "streams", "extras", "clinical", "sinks"]


#: In a query's SQL clean(x) stands for lower case without outer white space of any kind.
_CLEAN = re.compile(r"\bclean\(([\w.]+)\)")


def expand(sql: str) -> str:
    return _CLEAN.sub(r"lower(regexp_replace(\1, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))", sql)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, base folder) -> DataFrame under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = expand(sql)
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for name in _MODULES:
        importlib.import_module(f"corvigraph.queries.{name}")
    return QUERIES, SQL
