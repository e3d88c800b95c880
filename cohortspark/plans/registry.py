"""The named queries and, where SQL can say the same, the text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name; ``covers`` lists the inventory ids."""

    def register(fn: QueryFn) -> QueryFn:
        REGISTRY[fn.__name__] = Query(fn, sql, covers)
        return fn

    return register
