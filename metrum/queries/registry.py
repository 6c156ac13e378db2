"""Registry that ties a query's name to its Spark plan and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metrum.plans.durable import scratch
from metrum.queries.views import Views, with_views
from metrum.session import spread, tune

__all__ = ["ORACLES", "QUERIES", "query", "scratch"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``function(views) -> DataFrame``; ``sql`` may name any view of :mod:`metrum.queries.views`."""

    def register(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Views.of(spread(tune(spark)), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register
