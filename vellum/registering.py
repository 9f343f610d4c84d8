"""How a module lists its queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def collector(queries: dict[str, Entry]) -> Callable:
    """A decorator that lists a function under its name, with its SQL."""

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = Entry(fn, sql)
            return fn

        return add

    return query
