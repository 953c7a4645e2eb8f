"""Registered queries with the plain SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    inventory: str


REGISTRY: dict[str, Query] = {}


def query(inventory: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def add(run: Run) -> Run:
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, sql, inventory)
        return run

    return add
