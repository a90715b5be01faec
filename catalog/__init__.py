"""Every registered query, with the SQL that gives its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paddock.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}

AS_OF = "2001-07-31"
DATE_FROM = "2001-07-17"
BEFORE_FROM = "2001-07-03"


def query(name: str, expected: str | None = None):
    """Register a query under ``name`` with its expected result as SQL."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if expected:
            EXPECTED[name] = expected
        return function

    return register


def load() -> None:
    from . import (  # noqa: F401
        aggregates, calculator, distributions, filters, listing, normalisation, plans, sources,
    )
