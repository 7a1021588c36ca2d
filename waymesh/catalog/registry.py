"""Registry of the queries the driver runs, with their SQL counterparts."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL, Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

# Sizes are estimated from compressed bytes, of which lines and sorted cells take a tenth or less; a table sent to all is built in the driver.
BROADCAST_BYTES = 1 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; ``sql`` may use the derived views."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEW_SQL:
            if re.search(rf"\b{view}\b", text) and view not in needed:
                visit(VIEW_SQL[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    ctes = [f"{view} AS ({VIEW_SQL[view]})" for view in needed]
    body = sql.strip()
    own = re.match(r"(?i)with\s+", body)
    if own:
        body = body[own.end():]
        return "WITH RECURSIVE " + ", ".join([*ctes, ""]) + body
    return ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + body


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST_BYTES)
            return fn(Views(spark, sf_dir))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in _ORACLES.items()}
