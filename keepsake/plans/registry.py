"""Named queries over the driver tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.session import configure
from keepsake.sources.fixtures import FIXTURES, Model, duckdb_text

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The moments the registered queries run at.
NOW = "2001-03-30 12:00:00"
EVENTS_NOW = "2024-01-20 06:00:00"


def query(name: str, oracle: str | None = None):
    """Register ``fn(model)`` under ``name``; fixtures named in the SQL are put in front of it."""

    def register(fn: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle)
        return fn

    return register


def with_fixtures(sql: str) -> str:
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} as ({duckdb_text(n)})" for n in used]
    body = sql.strip()
    own = re.match(r"with\s+(recursive\s+)?", body)
    if own:
        return "with recursive " + ", ".join(parts + [body[own.end():]])
    return ("with recursive " + ", ".join(parts) + "\n" if parts else "") + body


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QUERIES[name](Model(configure(spark), folder))

    run.__name__ = name
    return run


def load_all() -> None:
    """Import every module that registers queries."""
    from keepsake.plans import (  # noqa: F401
        q_audit, q_dedup, q_extract, q_files, q_home, q_jobs, q_retention, q_scalars, q_streams, q_views,
    )
