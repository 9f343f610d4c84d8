"""Queries over keyed entries: customers by name, and documents by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids, json_ops
from vellum.operators import query as q
from vellum.operators.query import Query
from vellum.registering import Entry, collector
from vellum.sources import tables

QUERIES: dict[str, Entry] = {}
query = collector(QUERIES)

_CE = "WITH e AS (SELECT c_name AS key, CAST(to_json({'custkey': c_custkey, 'nation': c_nationkey, 'segment': c_mktsegment}) AS VARCHAR) AS value FROM customer) "
_DE = "WITH e AS (SELECT printf('%08d', doc_id) AS key, text AS value FROM documents) "


def _customers(spark: SparkSession, sf_dir: str) -> Query:
    return Query(tables.customers(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> Query:
    d = tables.table(spark, sf_dir, "documents")
    return Query(tables.entries(d, F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.col("text")))


def _kv(x: Query) -> DataFrame:
    return x.entries().select("key", "value")


@query(_CE + "SELECT key, value FROM e WHERE starts_with(key, 'Customer#00000001')")
def key_prefix(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).prefix("Customer#00000001"))


@query(_CE + "SELECT key, value FROM e WHERE key >= 'Customer#000000020' AND key < 'Customer#000000090'")
def key_range(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).range("Customer#000000020", "Customer#000000090"))


@query(_CE + "SELECT key, value FROM e WHERE key >= 'Customer#000000120'")
def key_range_open(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).prefix("x").range("Customer#000000120", None))


@query(_CE + "SELECT key, value FROM e WHERE ends_with(key, '7')")
def key_suffix(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where_key(q.key_suffix("7")))


@query(_CE + "SELECT key, value FROM e WHERE contains(key, '012')")
def key_contains(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where_key(q.key_contains("012")))


@query(_CE + "SELECT key, value FROM e WHERE key >= 'Customer#000000010' AND key < 'Customer#000000110' AND ends_with(key, '3')")
def key_between(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where_key(q.key_between("Customer#000000010", "Customer#000000110"), q.key_suffix("3")))


@query(_DE + "SELECT key, strlen(value) AS bytes FROM e WHERE contains(value, 'License')")
def val_contains(spark, sf_dir):
    return _documents(spark, sf_dir).where(q.val_contains("License")).project(key=F.col("key"), bytes=F.col("value_len").cast("long"))


@query(_DE + "SELECT key, strlen(value) AS bytes FROM e WHERE starts_with(value, 'Th')")
def val_prefix(spark, sf_dir):
    return _documents(spark, sf_dir).where(q.val_prefix("Th")).project(key=F.col("key"), bytes=F.col("value_len").cast("long"))


@query(_DE + "SELECT key, strlen(value) AS bytes FROM e WHERE ends_with(value, 'License.')")
def val_suffix(spark, sf_dir):
    return _documents(spark, sf_dir).where(q.val_suffix("License.")).project(key=F.col("key"), bytes=F.col("value_len").cast("long"))


@query(_DE + "SELECT key, strlen(value) AS bytes FROM e WHERE strlen(value) >= 2048")
def val_min_length(spark, sf_dir):
    return _documents(spark, sf_dir).where_raw(q.val_min_length(2048)).project(key=F.col("key"), bytes=F.col("value_len").cast("long"))


@query(_DE + "SELECT key, strlen(value) AS bytes FROM e WHERE strlen(value) <= 300")
def val_max_length(spark, sf_dir):
    return _documents(spark, sf_dir).where_raw(q.val_max_length(300)).project(key=F.col("key"), bytes=F.col("value_len").cast("long"))


@query(_DE + "SELECT key, strlen(value) > 2048 AS is_large, strlen(value) AS value_len FROM e")
def value_accessors(spark, sf_dir):
    return _documents(spark, sf_dir).project(key=F.col("key"), is_large=F.col("value_len") > 2048, value_len=F.col("value_len").cast("long"))


@query(_CE + "SELECT key, value FROM e WHERE json_extract_string(value, '$.segment') = 'BUILDING'")
def json_eq(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where(q.json_eq("segment", "BUILDING")))


@query(_CE + "SELECT key, value FROM e WHERE json_type(value, '$.nation') = 'VARCHAR'")
def json_eq_not_a_string(spark, sf_dir):
    """A field that is a number never equals a string."""
    return _kv(_customers(spark, sf_dir).where(q.json_eq("nation", "7")))


@query(_CE + "SELECT key, value FROM e WHERE contains(json_extract_string(value, '$.segment'), 'MACH')")
def json_contains(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where(q.json_contains("segment", "MACH")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_field_of_events(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.where(json_ops.field_ge("props", "k", 50)).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(_CE + "SELECT key, value FROM e ORDER BY key DESC LIMIT 10")
def reverse_topk(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).reverse().limit(10))


@query(_CE + "SELECT key, value FROM e WHERE json_extract_string(value, '$.segment') = 'MACHINERY' ORDER BY key LIMIT 12 OFFSET 5")
def offset_limit(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where(q.json_eq("segment", "MACHINERY")).offset(5).limit(12))


@query(_CE + "SELECT key, value FROM e ORDER BY key DESC LIMIT 8 OFFSET 3")
def reverse_offset_limit(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).reverse().offset(3).limit(8))


@query(_CE + "SELECT count(*) AS n FROM e WHERE contains(value, 'AUTO')")
def count_where(spark, sf_dir):
    return _customers(spark, sf_dir).where(q.val_contains("AUTO")).entries().agg(F.count("*").alias("n"))


@query(_CE + "SELECT key, value FROM e WHERE contains(value, 'HOUSE') ORDER BY key LIMIT 1")
def first_match(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).where(q.val_contains("HOUSE")).limit(1))


@query(_CE + "SELECT key FROM e WHERE starts_with(key, 'Customer#0000001')")
def collect_keys(spark, sf_dir):
    return _customers(spark, sf_dir).prefix("Customer#0000001").keys()


@query(_CE + "SELECT key, CAST(json_extract(value, '$.nation') AS INTEGER) AS nation, upper(json_extract_string(value, '$.segment')) AS segment FROM e")
def project_map(spark, sf_dir):
    return _customers(spark, sf_dir).project(key=F.col("key"), nation=F.get_json_object("value", "$.nation").cast("int"), segment=F.upper(F.get_json_object("value", "$.segment")))


@query(_CE + "SELECT key, value FROM e WHERE key >= 'Customer#00000003x' ORDER BY key LIMIT 1")
def seek_ge(spark, sf_dir):
    return q.seek(tables.customers(spark, sf_dir), "Customer#00000003x").select("key", "value")


@query(_CE + "SELECT min(key) AS first_key, max(key) AS last_key FROM e")
def first_last_key(spark, sf_dir):
    return q.first_last(tables.customers(spark, sf_dir))


@query(_CE + "SELECT max(key) FILTER (key < 'Customer#000000050') AS prev_key, min(key) FILTER (key > 'Customer#000000050') AS next_key FROM e")
def cursor_neighbours(spark, sf_dir):
    return q.neighbours(tables.customers(spark, sf_dir), "Customer#000000050")


@query("SELECT conv_id AS grp, turn AS key, lag(turn) OVER w AS prev_key, lead(turn) OVER w AS next_key FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def cursor_next_prev(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").select(F.col("turn").alias("key"), "conv_id")
    return q.next_prev_keys(c, F.col("conv_id"))


# identifiers and routing

_UUID = "WITH u AS (SELECT event_id, printf('%012x', epoch_us(ts) // 1000) || '7' || printf('%03x', event_id % 4096) || lower(printf('%08x', (2::BIGINT << 30) + ((event_id % 5) << 26) + ((user_id % 256) << 18) + ((event_id % 1024) << 8) + (event_id >> 32)) || printf('%08x', event_id % 4294967296)) AS id FROM events) "


def _event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    bits = ids.payload(F.col("event_id") % 5, F.col("user_id") % 256, F.col("event_id") % 1024, F.col("event_id"))
    # 1,000,000 ns hold 4,096 steps: the nanoseconds that give a wanted step
    ns = ms * 1_000_000 + F.ceil((F.col("event_id") % 4096) * F.lit(1_000_000) / F.lit(4096)).cast("long")
    return e.select("event_id", ids.compose(ns, bits).alias("id"))


@query(_UUID + "SELECT event_id, id, ('0x' || id[1:12])::BIGINT AS ts_ms, 7 AS version, true AS is_v7 FROM u")
def uuid7_fields(spark, sf_dir):
    return _event_ids(spark, sf_dir).select("event_id", "id", ids.timestamp_ms("id").alias("ts_ms"), ids.version("id").alias("version"), ids.is_v7("id").alias("is_v7"))


@query("SELECT event_id, CAST(event_id % 5 AS INTEGER) AS kind, CAST(user_id % 256 AS INTEGER) AS coll, CAST(event_id % 1024 AS INTEGER) AS shard, event_id AS counter FROM events")
def id_overlay_fields(spark, sf_dir):
    return _event_ids(spark, sf_dir).select("event_id", ids.kind_of("id").alias("kind"), ids.coll_of("id").alias("coll"), ids.shard_of("id").alias("shard"), ids.counter_of("id").alias("counter"))


@query(_UUID + "SELECT event_id, id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] AS text, id AS parsed FROM u")
def uuid_text(spark, sf_dir):
    return _event_ids(spark, sf_dir).select("event_id", ids.dashed("id").alias("text"), ids.parse(F.upper(ids.dashed("id"))).alias("parsed"))


@query("SELECT c_name AS key, CAST(('0x' || sha256(c_name)[1:4])::INTEGER >> 6 AS INTEGER) AS shard FROM customer")
def shard_route(spark, sf_dir):
    return tables.customers(spark, sf_dir).select("key", ids.route("key").alias("shard"))


@query("SELECT DISTINCT c_mktsegment AS name, ('0x' || sha256(c_mktsegment)[1:2])::INTEGER AS coll FROM customer")
def coll_byte(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return c.select("name", ids.coll_byte("name").alias("coll"))
