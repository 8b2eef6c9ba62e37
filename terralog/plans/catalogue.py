"""All registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralog.plans import checks, climate, evidence, forecasts, formats

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (climate, evidence, checks, forecasts, formats)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
