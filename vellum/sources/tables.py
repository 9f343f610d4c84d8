"""Plain tables read as keyed entries, document collections and version streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.common import column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(n: Column | str) -> Column:
    """A number as an id of 32 hex digits."""
    return F.lower(F.lpad(F.hex(column(n).cast("long")), 32, "0"))


def entries(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, value_len) of a table; the length in bytes is kept beside the value."""
    return df.select(key.alias("key"), value.alias("value")).withColumn("value_len", F.octet_length("value"))


def collection(df: DataFrame, id: Column, **fields: Column) -> DataFrame:
    """(id, doc): JSON objects with sorted keys."""
    return df.select(id.alias("id"), F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])).alias("doc"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as entries: key c_name, value the market segment and nation."""
    c = table(spark, sf_dir, "customer")
    return entries(c, F.col("c_name"), F.to_json(F.struct(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return collection(o, hex_id("o_orderkey"), customer_id=hex_id("o_custkey"), orderkey=F.col("o_orderkey"), priority=F.col("o_orderpriority"), status=F.col("o_orderstatus"), total=F.round(F.col("o_totalprice") * 100).cast("long"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return collection(c, hex_id("c_custkey"), name=F.col("c_name"), nation=F.col("c_nationkey"), segment=F.col("c_mktsegment"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions: key the user, ver the event in order, value its type; errors are deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ver"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("value"))
