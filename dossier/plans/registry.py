"""The catalogue of runnable queries: name -> Spark callable, optional DuckDB text, inventory ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    ids: tuple[str, ...]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query. ``ids`` are the inventory rows it covers."""

    def add(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in CATALOGUE:
            raise ValueError(f"query {key} registered twice")
        CATALOGUE[key] = Query(key, fn, tuple(ids.split()), sql)
        return fn

    return add
