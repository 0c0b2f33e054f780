"""Query registry: name -> DataFrame function, and name -> comparison SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

FAMILIES = (
    "indicator_queries",
    "source_queries",
    "lookup_queries",
    "profile_queries",
    "feature_queries",
    "evaluation_queries",
    "scenario_queries",
    "model_queries",
    "stream_queries",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for family in FAMILIES:
        importlib.import_module(f"barloom.plans.{family}")
    return QUERIES, ORACLES
