"""All registered queries and SQL twins, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

MODULES = ("segmentation", "metrics", "identity", "signal", "catalog", "streaming", "recovery")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__package__}.{name}"), attribute).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict:
    return {name: _shipped(query) for name, query in _gather("QUERIES").items()}


def all_oracles() -> dict:
    return _gather("ORACLES")
