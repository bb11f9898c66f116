"""Registry of the queries this package answers, each with its SQL equivalent.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the Spark plan over the
input tables under ``sf_dir``; ``ORACLE[name]`` is the same question in plain
SQL over views of the same tables. Queries without a SQL form (model fitting,
iterative or random procedures) are registered with ``sql=None``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from vitae.plans import (  # noqa: F401
        q_features,
        q_jobs,
        q_extract,
        q_matching,
        q_metrics,
        q_model,
        q_screening,
        q_text,
    )
