"""Every query of the library by name, with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, checks, community, detection, enrichment, feeds, learning, packages, scalars, store, streams, structure, supply  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
