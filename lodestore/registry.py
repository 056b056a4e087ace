"""The engine's own queries by operator ID, and the SQL that checks each."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestore import plans
from lodestore.plans.base import QUERIES

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search: fused retrieval of anchors, their memories, and the packed context of every query."""
    return QUERIES["search"].run(spark, sf_dir)
