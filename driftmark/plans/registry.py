"""Where the registered queries meet."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftmark.sources.tables import Tables

MODULES = ("statistics", "detectors", "projections", "listings", "matching", "queues", "pages", "operations", "learned")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"driftmark.plans.{module}")
