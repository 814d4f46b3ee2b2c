"""Registry of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from terraloom.plans.fixtures import Context, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of a Context as a query; sql is its oracle over the named views."""

    def register(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(" ".join(sql.split()) if "'" not in sql else sql.strip(), views)
        return f

    return register
