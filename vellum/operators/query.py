"""A query over keyed entries, built step by step and run as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import json_ops


class NotFound(LookupError):
    """No entry matches."""


# predicates: each makes a column over (key, value, value_len)


def key_prefix(p: str | bytes) -> Column:
    return F.startswith(F.col("key"), F.lit(p))


def key_suffix(p: str | bytes) -> Column:
    return F.endswith(F.col("key"), F.lit(p))


def key_contains(p: str | bytes) -> Column:
    return F.contains(F.col("key"), F.lit(p))


def key_between(start: str | bytes | None, end: str | bytes | None) -> Column:
    """Half-open; an empty bound is open."""
    out = F.lit(True)
    if start:
        out &= F.col("key") >= F.lit(start)
    if end:
        out &= F.col("key") < F.lit(end)
    return out


def val_contains(p: str | bytes) -> Column:
    return F.contains(F.col("value"), F.lit(p))


def val_prefix(p: str | bytes) -> Column:
    return F.startswith(F.col("value"), F.lit(p))


def val_suffix(p: str | bytes) -> Column:
    return F.endswith(F.col("value"), F.lit(p))


def val_min_length(n: int) -> Column:
    """Bytes, from the stored length: the value is not read."""
    return F.col("value_len") >= n


def val_max_length(n: int) -> Column:
    return F.col("value_len") <= n


def json_eq(name: str, value: str) -> Column:
    return F.coalesce(json_ops.string_field("value", name) == value, F.lit(False))


def json_contains(name: str, part: str) -> Column:
    return F.coalesce(F.contains(json_ops.string_field("value", name), F.lit(part)), F.lit(False))


def prefix_upper_bound(p: bytes) -> bytes | None:
    """The least byte string above all with the prefix; None if there is none."""
    p = p.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


@dataclass(frozen=True)
class Query:
    """Immutable: each step returns a new query. All predicates must hold.

    Rows come in key order where the result depends on it (limit, offset, first) or it is asked
    for (``ordered``, ``reverse``); otherwise they are not sorted, which would cost a shuffle.
    """

    df: DataFrame
    bounds: Column | None = None
    conditions: tuple[Column, ...] = ()
    n: int = 0
    skip: int = 0
    order: str = ""

    def prefix(self, p: str | bytes) -> Query:
        """Keys with a prefix; the last of prefix and range holds."""
        return replace(self, bounds=key_prefix(p))

    def range(self, start: str | bytes | None, end: str | bytes | None) -> Query:
        return replace(self, bounds=key_between(start, end))

    def where(self, *conditions: Column) -> Query:
        """Conditions on key, value and value_len; those on keys alone reach the scan."""
        return replace(self, conditions=self.conditions + conditions)

    where_key = where
    where_raw = where

    def limit(self, n: int) -> Query:
        """At most n rows; no limit for n <= 0."""
        return replace(self, n=max(0, n))

    def offset(self, n: int) -> Query:
        return replace(self, skip=max(0, n))

    def ordered(self) -> Query:
        return replace(self, order=self.order or "asc")

    def reverse(self) -> Query:
        return replace(self, order="desc")

    def entries(self) -> DataFrame:
        """The matching rows."""
        df = self.df
        if self.bounds is not None:
            df = df.where(self.bounds)
        for c in self.conditions:
            df = df.where(c)
        if self.order or self.n or self.skip:
            df = df.orderBy(F.desc("key") if self.order == "desc" else F.asc("key"))
        if self.skip:
            df = df.offset(self.skip)
        return df.limit(self.n) if self.n else df

    def keys(self) -> DataFrame:
        return self.entries().select("key")

    def project(self, **columns: Column) -> DataFrame:
        return self.entries().select(*[c.alias(k) for k, c in columns.items()])

    def map_batches(self, fn: Callable, schema: str) -> DataFrame:
        """A function over Arrow batches, for what columns can't express; its errors are raised."""
        return self.entries().mapInArrow(fn, schema)

    def count(self) -> int:
        return self.entries().count()

    def first(self):
        rows = self.ordered().limit(1).entries().take(1) if not self.n else self.ordered().entries().take(1)
        if not rows:
            raise NotFound
        return rows[0]

    def scan(self, fn: Callable[[object], bool | None]) -> None:
        """Call fn on row after row in key order until it returns False; rows come partition by partition."""
        for row in self.ordered().entries().toLocalIterator():
            if fn(row) is False:
                return

    def stream(self) -> Iterator:
        return iter(self.ordered().entries().toLocalIterator())


def seek(df: DataFrame, target: str) -> DataFrame:
    """The first entry at or after a key."""
    return df.where(F.col("key") >= target).orderBy("key").limit(1)


def first_last(df: DataFrame) -> DataFrame:
    """(first_key, last_key), by a partial aggregate."""
    return df.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """(prev_key, next_key) of a key: the nearest distinct keys on either side."""
    k = F.col("key")
    return df.agg(F.max(F.when(k < key, k)).alias("prev_key"), F.min(F.when(k > key, k)).alias("next_key"))


def next_prev_keys(df: DataFrame, groups: Column) -> DataFrame:
    """Every key with its neighbours within a group of keys; groups bound the sort of a task."""
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("key")
    d = df.select("key", groups.alias("grp")).distinct()
    return d.select("grp", "key", F.lag("key").over(w).alias("prev_key"), F.lead("key").over(w).alias("next_key"))
