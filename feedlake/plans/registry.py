"""Registry of the named queries: one Spark builder and (mostly) one oracle SQL per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlake.plans.normalize import plain

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL.

    A key without SQL gets the driver's weaker rows-only check.
    """
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return run
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from feedlake.plans import (  # noqa: F401
        q_articles, q_chunks, q_merge, q_profile, q_search, q_sources, q_stream, q_vectors)
