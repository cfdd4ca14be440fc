"""Registration of queries: an operator over views, and the SQL that its result must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import check_text
from ..sources.views import check_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, views: str, make: Callable[..., DataFrame], sql: str | None = None) -> None:
    """``make`` gets the named views (blank-separated) as DataFrames."""
    names = tuple(views.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(*[view(spark, sf_dir, n) for n in names])

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = check_sql(names, check_text(sql))
