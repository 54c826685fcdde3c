"""Every runnable query: name -> (spark, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.measures import decimals_to_double
from . import (
    check_tables,
    oracle_checks,
    oracle_data,
    oracle_models,
    oracle_time,
    oracle_views,
    queries_data,
    queries_models,
    queries_time,
    queries_views,
)

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (queries_views, queries_data, queries_time, queries_models, check_tables):
        out.update({name: _plain(fn) for name, fn in module.QUERIES.items()})
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (oracle_views, oracle_data, oracle_time, oracle_models, oracle_checks):
        out.update(module.SQL)
    return out


def _plain(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decimals_to_double(fn(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run
