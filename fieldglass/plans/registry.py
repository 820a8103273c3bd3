"""All queries on the reference's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


for _name in ("areas", "sources", "sites", "evidence", "scores", "workspace", "scans", "matching", "claims", "desk", "listings", "leads", "catalogs", "followup"):
    import_module(f"fieldglass.plans.{_name}")
