"""All queries over the star-schema tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spacemill.plans import base, config, extents, geometry, placement, scans, state  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a_i5_coalesce"](spark, sf_dir)
