"""Tables with columns and keys, kept as documents of a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.operators import integrity
from vellum.sources.store import Store


class Violation(ValueError):
    """Rows break a key or a NOT NULL."""


class SqlTable:
    """A table of a store: a row is a JSON document under its encoded key, a statement one commit.

    ``columns`` is a schema as text. Checks are aggregates and joins over the statement's rows
    and the stored keys; a statement that breaks one writes nothing.
    """

    def __init__(self, store: Store, name: str, columns: str, key: Sequence[str], not_null: Sequence[str] = ()):
        self.store, self.name, self.key = store, name, list(key)
        self.schema: StructType = store.spark.createDataFrame([], columns).schema
        self.required = [c for c in self.schema.names if c in key or c in not_null]

    def create(self) -> None:
        self.store.create_collection(self.name)

    def _entries(self, rows: DataFrame) -> DataFrame:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        return typed.select(integrity.encode_key(typed, self.key).alias("key"), F.to_json(F.struct(*self.schema.names)).alias("value"), *[F.col(c).isNull().alias(f"no_{c}") for c in self.required])

    def _checked(self, rows: DataFrame, fresh: bool) -> DataFrame:
        e = self._entries(rows)
        for c in self.required:
            if not e.where(F.col(f"no_{c}")).isEmpty():
                raise Violation(f"{c} is null")
        if not e.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise Violation("a key occurs twice")
        if fresh and not e.join(self.store.view(coll=self.name).select("key"), "key", "left_semi").isEmpty():
            raise Violation("a key is there already")
        return e.select("key", "value")

    def rows(self, snap: str | None = None) -> DataFrame:
        """The table now or at a snapshot."""
        return self.store.view(snap, self.name).select(F.from_json("value", self.schema).alias("r")).select("r.*")

    def insert(self, rows: DataFrame) -> int:
        """Rows inserted; Violation if a key is there, occurs twice or a needed value is null."""
        e = self._checked(rows, True)
        n = e.count()
        self.store.put_rows(e, self.name)
        return n

    def replace(self, rows: DataFrame) -> int:
        """Rows inserted or put in the place of those with their keys."""
        e = self._checked(rows, False)
        n = e.count()
        self.store.put_rows(e, self.name)
        return n

    def update(self, where: Column, **values: Column) -> int:
        """Rows changed; keys can't be."""
        if set(values) & set(self.key):
            raise Violation("a key does not change")
        hit = self.rows().where(where)
        n = hit.count()
        if n:
            self.store.put_rows(self._checked(hit.withColumns(values), False), self.name)
        return n

    def delete(self, where: Column) -> int:
        """Rows deleted."""
        hit = self._entries(self.rows().where(where))
        n = hit.count()
        if n:
            self.store.delete_rows(hit, self.name)
        return n

    def table_info(self) -> DataFrame:
        """(cid, name, type, not_null, in_key) of each column."""
        info = [(i, f.name, f.dataType.simpleString(), f.name in self.required, f.name in self.key) for i, f in enumerate(self.schema)]
        return self.store.spark.createDataFrame(info, "cid int, name string, type string, not_null boolean, in_key boolean")

    def integrity_check(self) -> str:
        """'ok', or what is wrong: a row that is no document of the schema, lacks a value or lies under another key."""
        v = self.store.view(coll=self.name).select("key", F.from_json("value", self.schema).alias("r"))
        again = v.select("key", "r.*")
        bad = again.where(F.coalesce(integrity.encode_key(again, self.key) != F.col("key"), F.lit(True)) | F.greatest(F.lit(False), *[F.col(c).isNull() for c in self.required]))
        row = bad.select("key").take(1)
        return f"row {row[0][0]}" if row else "ok"


def replicate(rows: DataFrame, key: Sequence[str], store: Store, name: str) -> int:
    """Copy a table into a collection as canonical rows under encoded keys, one commit; rows that went are deleted."""
    copy = rows.select(integrity.encode_key(rows, key).alias("key"), integrity.canonical_row(rows).alias("value"))
    gone = store.view(coll=name).select("key").join(copy.select("key"), "key", "left_anti")
    changes = copy.select("key", F.lit(False).alias("deleted"), "value").unionByName(gone.select("key", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value")))
    return store.append(changes.select(F.lit(name).alias("coll"), "key", "deleted", "value"), "replicate")
