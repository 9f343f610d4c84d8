"""Queries that write to a store in the shared folder and read it back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids, json_ops
from vellum.operators import integrity, query as builder
from vellum.plans import lot
from vellum.registering import Entry, collector
from vellum.session import scratch
from vellum.sources import tables
from vellum.sources.sqltable import SqlTable, replicate
from vellum.sources.store import Store, apply_snapshot, open_snapshot
from vellum.streaming import feed

QUERIES: dict[str, Entry] = {}
query = collector(QUERIES)

_CAP = {"prefix": "o", "quota_bytes": 1 << 30, "quota_ops": 8}
_SHARD = "('0x' || sha256({0})[1:4])::INTEGER >> 6"


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch(spark, "store"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey", "c_nationkey")


def _filled(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    """A store with three commits: all customers, one nation's deleted, every seventh rewritten; and the first snapshot."""
    s, c = _store(spark), _customers(spark, sf_dir)
    s.put_rows(c)
    snap = s.freeze()
    s.delete_rows(c.where("c_nationkey = 3"))
    s.put_rows(c.where("c_custkey % 7 = 0").withColumn("value", F.lit("X")))
    return s, snap


_NOW = "SELECT c_name AS key, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 7 = 0 OR c_nationkey <> 3"
_THEN = "SELECT c_name AS key, c_mktsegment AS value FROM customer"


@query(_NOW)
def store_round_trip(spark, sf_dir):
    """Bulk puts and deletes, one commit each, read as the latest state."""
    return _filled(spark, sf_dir)[0].view().select("key", "value")


@query(_THEN)
def store_as_of(spark, sf_dir):
    s, snap = _filled(spark, sf_dir)
    return s.view(snap).select("key", "value")


@query(_THEN)
def store_as_of_after_archive(spark, sf_dir):
    """Archiving moves old versions away; a snapshot still sees them."""
    s, snap = _filled(spark, sf_dir)
    s.compact("archive")
    return s.view(snap).select("key", "value")


@query("SELECT c_name AS key, c_mktsegment AS value, false AS deleted FROM customer WHERE c_nationkey = 3 OR c_custkey % 7 = 0 UNION ALL SELECT c_name, NULL, true FROM customer WHERE c_nationkey = 3")
def store_history(spark, sf_dir):
    """What archiving moved: versions that were followed by another, and deletes."""
    s, _ = _filled(spark, sf_dir)
    s.compact("archive")
    return s.history().select("key", "value", "deleted")


@query(_NOW)
def store_pruned(spark, sf_dir):
    """After pruning only live versions are stored."""
    s, _ = _filled(spark, sf_dir)
    s.compact("prune")
    return s.versions().select("key", "value")


@query(_THEN)
def store_snapshot(spark, sf_dir):
    """A snapshot exported after archiving, verified, and applied to another store."""
    s, snap = _filled(spark, sf_dir)
    s.compact("archive")
    path = scratch(spark, "snapshot")
    s.export(path, snap)
    t = _store(spark)
    apply_snapshot(t, path)
    return t.view().select("key", "value")


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS keys FROM customer")
def store_snapshot_verified(spark, sf_dir):
    s, snap = _filled(spark, sf_dir)
    path = scratch(spark, "snapshot")
    s.export(path, snap)
    return open_snapshot(spark, path).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name > 'Customer#000000040' AND c_name <> 'Customer#000000050' UNION ALL SELECT 'tx', 'committed'")
def store_tx(spark, sf_dir):
    """A transaction's writes appear together; those of one rolled back never."""
    s, c = _store(spark), _customers(spark, sf_dir)
    s.put_rows(c)
    with s.begin() as tx:
        tx.put("tx", "committed")
        tx.delete("Customer#000000050")
    other = s.begin()
    other.put("lost", "rolled back")
    other.rollback()
    return s.view().where("key > 'Customer#000000040'").select("key", "value")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey = 42")
def store_point_get(spark, sf_dir):
    s = _store(spark)
    s.put_rows(_customers(spark, sf_dir))
    return spark.createDataFrame([("Customer#000000042", s.get("Customer#000000042"))], "key string, value string")


@query("SELECT c_name AS key FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY 1 LIMIT 8")
def store_prefix_scan(spark, sf_dir):
    s = _store(spark)
    s.put_rows(_customers(spark, sf_dir))
    return s.scan_prefix("Customer#00000001", 8)


def _two_collections(spark: SparkSession, sf_dir: str) -> Store:
    s = _store(spark)
    for name, docs in (("ocustomers", tables.customer_docs(spark, sf_dir)), ("orders", tables.order_docs(spark, sf_dir))):
        s.create_collection(name)
        s.put_rows(docs.select(F.col("id").alias("key"), F.col("doc").alias("value")), name)
    return s


def _sizes(s: Store) -> DataFrame:
    """(name, n) of each collection; their number is small."""
    return integrity.count_rows(**{name: s.view(coll=name) for name in s.collections()})


@query("SELECT 'ocustomers' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def list_collections(spark, sf_dir):
    return _sizes(_two_collections(spark, sf_dir))


@query("SELECT 'ocustomers' AS name, count(*) AS n FROM customer")
def drop_collection(spark, sf_dir):
    s = _two_collections(spark, sf_dir)
    s.drop_collection("orders")
    return _sizes(s)


@query("SELECT printf('%032x', c_custkey) AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def collection_scan(spark, sf_dir):
    """One collection of several, its documents by a field."""
    v = _two_collections(spark, sf_dir).query("ocustomers").where(builder.json_eq("segment", "BUILDING")).entries()
    return v.select(F.col("key").alias("id"), json_ops.field("value", "name").alias("name"))


@query(f"SELECT count(*) AS n, 0 AS kind, CAST(('0x' || sha256('notes')[1:2])::INTEGER AS INTEGER) AS coll, CAST({_SHARD.format(chr(39) + 'notes' + chr(39))} AS INTEGER) AS shard, count(*) AS v7 FROM customer")
def insert_documents(spark, sf_dir):
    """Documents under new ids: all different, and the ids tell kind, collection and shard."""
    s = _store(spark)
    s.create_collection("notes")
    s.insert_rows("notes", tables.customer_docs(spark, sf_dir).select("doc"), 1_700_000_000_000_000_000)
    v = s.view(coll="notes")
    return v.groupBy(ids.kind_of("key").alias("kind"), ids.coll_of("key").alias("coll"), ids.shard_of("key").alias("shard")).agg(F.countDistinct("key").alias("n"), F.count_if(ids.is_v7("key")).alias("v7"))


@query(f"WITH s AS (SELECT c_name AS key, c_mktsegment AS value, {_SHARD.format('c_name')} AS shard FROM customer) SELECT key, value, (SELECT count(DISTINCT shard) > 1 FROM s) AS others_refused FROM s WHERE shard = (SELECT min(shard) FROM s)")
def put_batch_atomic_check(spark, sf_dir):
    """A batch of one shard is one commit; one of several shards is refused whole."""
    s, c = _store(spark), _customers(spark, sf_dir)
    first = c.agg(F.min(ids.route("key"))).first()[0]
    s.put_batch_atomic(c.where(ids.route("key") == first).select("key", "value"))
    refused = False
    try:
        s.put_batch_atomic(c.select("key", "value"))
    except ValueError:
        refused = True
    return s.view().select("key", "value", F.lit(refused).alias("others_refused"))


# requests

_DOC = "CAST(to_json({{'customer_id': printf('%032x', o_custkey), 'orderkey': o_orderkey, 'priority': o_orderpriority, 'status': {0}, 'total': CAST(round(o_totalprice * 100) AS BIGINT) + {1}}}) AS VARCHAR)"


@query(f"SELECT printf('%032x', o_orderkey) AS id, {_DOC.format('o_orderstatus', 1)} AS doc FROM orders WHERE o_orderstatus = 'P' ORDER BY id LIMIT 30")
def nest_cas_narrow(spark, sf_dir):
    """A nested cas changes whole documents, though its source projects one field."""
    spec = {"depth": 1, "src": {"scan": {"coll": "orders", "limit": 30, "proj": ["status"], "filter": {"eq": ["status", "P"]}}}, "then": {"cas": {"coll": "orders", "ops": [{"op": 3, "f": "total", "v": 1}]}}}
    request = json.dumps({"cap": _CAP, "op": {"nest": spec}})
    return lot.Planner(spark, {"orders": tables.order_docs(spark, sf_dir)}, lambda coll: "0" * 32).run(request).writes.select("id", "doc")


@query(f"SELECT printf('%032x', o_orderkey) AS id, CASE WHEN o_orderstatus = 'P' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 40 THEN {_DOC.format(chr(39) + 'D' + chr(39), 0)} ELSE {_DOC.format('o_orderstatus', 0)} END AS doc FROM orders WHERE o_orderkey <> 5")
def lot_on_store(spark, sf_dir):
    """A request on a store: its writes are one commit, seen by the next. The nested cas takes the first 40 of what the del left."""
    s = _two_collections(spark, sf_dir)
    try:
        got = s.execute({"cap": _CAP, "op": {"get": {"coll": "orders", "id": f"{5:032x}"}}}).docs.first()
        s.execute({"cap": _CAP, "op": {"del": {"coll": "orders", "id": f"{5:032x}", "expect": got["hash"]}}})
    except lot.Missing:  # no such order: none to delete
        pass
    scan = {"scan": {"coll": "orders", "limit": 40, "proj": ["status"], "filter": {"eq": ["status", "P"]}}}
    s.execute({"cap": _CAP, "op": {"nest": {"depth": 1, "src": scan, "then": {"cas": {"coll": "orders", "ops": [{"op": 1, "f": "status", "v": "D"}]}}}}})
    return s.view(coll="orders").select(F.col("key").alias("id"), F.col("value").alias("doc"))


_REFUSALS = [
    ({"op": {"count": {"coll": "orders", "limit": 1}}}, "capability"),
    ({"cap": _CAP}, "op"),
    ({"cap": _CAP, "op": {"sweep": {}}}, "op"),
    ({"cap": _CAP, "op": {"count": {"coll": "xorders", "limit": 1}}}, "capability"),
    ({"cap": _CAP, "op": {"count": {"coll": "orders", "limit": 0}}}, "limit"),
    ({"cap": _CAP, "op": {"get": {"coll": "orders", "id": "xyz"}}}, "id"),
    ({"cap": _CAP, "op": {"scan": {"coll": "orders", "limit": 5, "proj": []}}}, "projection"),
    ({"cap": _CAP | {"quota_bytes": 100}, "op": {"scan": {"coll": "orders", "limit": 5, "proj": ["a"]}}}, "quota"),
    ({"cap": _CAP, "op": {"nest": {"depth": 9, "src": {}, "then": {}}}}, "depth"),
    ({"cap": _CAP, "ops": [{"get": {"coll": "orders", "id": "0" * 32}}] * 9}, "quota"),
    ({"cap": _CAP, "op": {"join": {"on": "", "left_max": 1, "right_max": 1}}}, "join"),
    ({"cap": _CAP, "op": {"get": {"coll": "orders", "id": "0" * 32}}}, "accepted"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(_REFUSALS)) + ") r(n, kind)")
def lot_refusals(spark, sf_dir):
    """What is wrong with each of some requests."""

    def kind(request: dict) -> str:
        try:
            lot.validate(request)
        except lot.Refused as e:
            return e.kind
        return "accepted"

    return spark.createDataFrame([(i, kind(r)) for i, (r, _) in enumerate(_REFUSALS)], "n int, kind string")


# the change log

_EVENTS = "SELECT 1 AS seq, 'mutation' AS kind, c_name AS key, false AS deleted, c_mktsegment AS value FROM customer UNION ALL SELECT 2, 'mutation', c_name, true, NULL FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 3, 'mutation', c_name, false, 'X' FROM customer WHERE c_custkey % 7 = 0"


@query(f"{_EVENTS} UNION ALL SELECT 4, 'prune', NULL, NULL, NULL")
def feed_of_store(spark, sf_dir):
    """Every write of a store is an event of its log."""
    s, _ = _filled(spark, sf_dir)
    s.compact("prune")
    return s.events().select(F.col("seq").cast("int").alias("seq"), "kind", "key", "deleted", "value")


@query(f"SELECT * FROM ({_EVENTS}) WHERE seq > 1")
def feed_resumed(spark, sf_dir):
    return _filled(spark, sf_dir)[0].events(1).select(F.col("seq").cast("int").alias("seq"), "kind", "key", "deleted", "value")


@query(_NOW)
def feed_published(spark, sf_dir):
    """The log published in two parts, streamed to a replica, which ends as the store did."""
    s, c = _store(spark), _customers(spark, sf_dir)
    out, replica = scratch(spark, "feed"), feed.ReplicaSink(scratch(spark, "replica"))
    s.put_rows(c)
    s.publish(out)
    s.delete_rows(c.where("c_nationkey = 3"))
    s.put_rows(c.where("c_custkey % 7 = 0").withColumn("value", F.lit("X")))
    s.publish(out)
    feed.replicate(feed.read_stream(spark, f"{out}/upto=*", files=2), replica, scratch(spark, "progress")).awaitTermination()
    return replica.state(spark).select("key", "value")


# tables with keys


def _accounts(spark: SparkSession, sf_dir: str) -> SqlTable:
    t = SqlTable(_store(spark), "accounts", "id bigint, name string, cents bigint, segment string", key=["id"], not_null=["name"])
    c = tables.table(spark, sf_dir, "customer")
    t.create()
    t.insert(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), F.col("c_mktsegment").alias("segment")))
    return t


_ACCOUNT = "SELECT c_custkey AS id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment AS segment FROM customer"


@query(f"SELECT id, name, CASE WHEN segment = 'BUILDING' THEN cents + 1000 ELSE cents END AS cents, segment FROM ({_ACCOUNT}) WHERE cents >= 0 UNION ALL SELECT -1, 'new', 7, NULL")
def sql_table_statements(spark, sf_dir):
    """CREATE, INSERT, UPDATE, DELETE and INSERT OR REPLACE, each a commit."""
    t = _accounts(spark, sf_dir)
    t.delete(F.col("cents") < 0)
    t.update(F.col("segment") == "BUILDING", cents=F.col("cents") + 1000)
    for cents in (5, 7):
        t.replace(spark.createDataFrame([(-1, "new", cents, None)], "id bigint, name string, cents bigint, segment string"))
    return t.rows()


@query("SELECT * FROM (VALUES (0, 'id', 'bigint', true, true), (1, 'name', 'string', true, false), (2, 'cents', 'bigint', false, false), (3, 'segment', 'string', false, false)) t(cid, name, type, not_null, in_key)")
def sql_declared_columns(spark, sf_dir):
    return _accounts(spark, sf_dir).table_info()


@query("SELECT 'ok' AS result, count(*) AS n FROM customer")
def sql_integrity_check(spark, sf_dir):
    t = _accounts(spark, sf_dir)
    return t.rows().agg(F.count("*").alias("n")).select(F.lit(t.integrity_check()).alias("result"), "n")


@query("SELECT count(*) AS n, (SELECT count(*) FROM nation) AS first FROM nation WHERE n_regionkey <> 2")
def shadow_replicate(spark, sf_dir):
    """A table copied row by row under encoded keys; rows that went from it go from the copy."""
    s, n = _store(spark), tables.table(spark, sf_dir, "nation")
    replicate(n, ["n_nationkey"], s, "nation")
    first = s.view(coll="nation").count()
    replicate(n.where("n_regionkey <> 2"), ["n_nationkey"], s, "nation")
    return s.view(coll="nation").agg(F.count("*").alias("n"), F.lit(first).cast("long").alias("first"))


# identifiers and values


@query("SELECT n, nil, largest, cmp, strict FROM (VALUES (0, true, false, -1, false), (1, false, true, 1, false), (2, false, false, 0, true), (3, false, false, -1, false)) t(n, nil, largest, cmp, strict)")
def id_predicates(spark, sf_dir):
    """Nil, largest, order against an id, and strict parsing of version 7."""
    v7 = "018bcfe5687b7abc8123456789abcdef"
    rows = spark.createDataFrame([(0, ids.NIL), (1, ids.MAX), (2, v7), (3, v7[:12] + "4" + v7[13:16] + "f" + v7[17:])], "n int, id string")
    return rows.select("n", ids.is_nil("id").alias("nil"), ids.is_max("id").alias("largest"), ids.compare("id", F.lit(v7)).alias("cmp"), ids.parse_v7(ids.dashed("id")).isNotNull().alias("strict"))


@query("SELECT printf('%032x', o_orderkey) AS id, o_orderpriority AS priority, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS total FROM orders")
def json_scalars(spark, sf_dir):
    """Fields of any scalar kind as text."""
    return tables.order_docs(spark, sf_dir).select("id", json_ops.field("doc", "priority").alias("priority"), json_ops.field("doc", "total").alias("total"))


@query("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_by_value(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderstatus", "o_orderkey")
