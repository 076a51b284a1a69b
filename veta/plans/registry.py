"""Register of the ready-made queries: name, function and, where SQL can say it, the SQL cross-check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veta.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

FRONTS = ("profiles", "weighing", "sensors", "shipping", "prices", "preparation", "patterns", "assignment",
          "data_quality", "statistics", "scoring", "clustering", "modelling")


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def load_all() -> None:
    for front in FRONTS:
        importlib.import_module(f"veta.plans.{front}")
