"""All registered queries of the search and corpus operators, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_plans, search_plans, stream_plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search_plans.queries() | corpus_plans.queries() | stream_plans.queries()


def oracle_sql() -> dict[str, str]:
    return search_plans.oracle_sql() | corpus_plans.oracle_sql() | stream_plans.oracle_sql()
