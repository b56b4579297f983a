"""Registered queries: name -> (Spark query, SQL to check it with, operators covered)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tenantlake.plans.bindings import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    fn: QueryFn
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under a name; ``sql`` may use the named views."""
    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(fn, with_views(sql, *views) if sql else None, tuple(covers.split()))
        return fn
    return add
