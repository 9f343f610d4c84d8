"""Queries of the document language over orders and customers as collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids, json_ops
from vellum.plans import lot
from vellum.registering import Entry, collector
from vellum.sources import tables

QUERIES: dict[str, Entry] = {}
query = collector(QUERIES)

_O = (
    "WITH o AS (SELECT printf('%032x', o_orderkey) AS id, printf('%032x', o_custkey) AS customer_id, o_orderkey AS orderkey, o_orderpriority AS priority, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders), "
    "od AS (SELECT *, CAST(to_json({'customer_id': customer_id, 'orderkey': orderkey, 'priority': priority, 'status': status, 'total': total}) AS VARCHAR) AS doc FROM o), "
    "cd AS (SELECT printf('%032x', c_custkey) AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(to_json({'name': c_name, 'nation': c_nationkey, 'segment': c_mktsegment}) AS VARCHAR) AS doc FROM customer) "
)
_CAP = {"prefix": "o", "quota_bytes": 1 << 30, "quota_ops": 8}


def _run(spark: SparkSession, sf_dir: str, *ops: dict, **more) -> lot.Result:
    collections = {"orders": tables.order_docs(spark, sf_dir), "ocustomers": tables.customer_docs(spark, sf_dir)}
    request = json.dumps({"cap": _CAP, "ops": list(ops), **more})
    return lot.Planner(spark, collections, lambda coll: "0" * 31 + "a").run(request)


def _id(n: int) -> str:
    return f"{n:032x}"


def _scan(limit: int, proj: list[str], **more) -> dict:
    return {"coll": "orders", "limit": limit, "proj": proj, **more}


@query(_O + "SELECT id, CAST(to_json({'orderkey': orderkey, 'total': total}) AS VARCHAR) AS doc FROM od WHERE status = 'F' AND orderkey >= 100 ORDER BY id LIMIT 50")
def scan_filter_project(spark, sf_dir):
    """The whole path: a JSON request, validated and planned."""
    spec = _scan(50, ["orderkey", "total"], filter={"eq": ["status", "F"], "ge": ["orderkey", 100]})
    return _run(spark, sf_dir, {"scan": spec}).docs.select("id", "doc")


@query(_O + "SELECT id, doc, sha256(doc) AS hash FROM od WHERE orderkey = 7")
def lot_get(spark, sf_dir):
    return _run(spark, sf_dir, {"get": {"coll": "orders", "id": _id(7)}}).docs.select("id", "doc", "hash")


@query(_O + "SELECT r.pos, od.id, CAST(to_json({'status': status}) AS VARCHAR) AS doc FROM (VALUES (0, 9), (1, 3), (2, 5)) r(pos, k) JOIN od ON od.orderkey = r.k")
def lot_gets(spark, sf_dir):
    return _run(spark, sf_dir, {"gets": {"coll": "orders", "ids": [_id(9), _id(3), _id(5)], "limit": 5, "proj": ["status"]}}).docs.select(F.col("pos").cast("int").alias("pos"), "id", "doc")


@query(_O + "SELECT id, CAST(to_json({'priority': priority, 'status': status}) AS VARCHAR) AS doc FROM od ORDER BY id LIMIT 100")
def lot_scan(spark, sf_dir):
    return _run(spark, sf_dir, {"scan": _scan(100, ["status", "priority", "nosuch"])}).docs.select("id", "doc")


@query(_O + "SELECT id AS next_from FROM od ORDER BY id LIMIT 1 OFFSET 100")
def lot_scan_next_page(spark, sf_dir):
    return lot.next_page(tables.order_docs(spark, sf_dir), _scan(100, ["status"]))


@query(_O + "SELECT id, CAST(to_json({'status': status}) AS VARCHAR) AS doc FROM od WHERE id >= printf('%032x', 101) ORDER BY id LIMIT 100")
def lot_scan_page2(spark, sf_dir):
    return _run(spark, sf_dir, {"scan": _scan(100, ["status"], from_id=_id(101))}).docs.select("id", "doc")


@query(_O + "SELECT id, CAST(to_json({'total': total}) AS VARCHAR) AS doc FROM od WHERE orderkey >= 32 AND orderkey < 80 ORDER BY id LIMIT 1000")
def lot_scan_id_window(spark, sf_dir):
    return _run(spark, sf_dir, {"scan": _scan(1000, ["total"], from_id=_id(32), to_id=_id(80))}).docs.select("id", "doc")


@query(_O + "SELECT id, CAST(to_json({'orderkey': orderkey}) AS VARCHAR) AS doc FROM od WHERE status = 'O'")
def lot_filter_eq(spark, sf_dir):
    o = tables.order_docs(spark, sf_dir)
    return o.where(json_ops.filter_column("doc", {"eq": ["status", "O"]})).select("id", json_ops.project("doc", ["orderkey"]).alias("doc"))


@query(_O + "SELECT id, total FROM od WHERE total >= 20000000")
def lot_filter_ge_numeric(spark, sf_dir):
    o = tables.order_docs(spark, sf_dir)
    return o.where(json_ops.filter_column("doc", {"ge": ["total", 20000000]})).select("id", json_ops.field("doc", "total").cast("long").alias("total"))


@query(_O + "SELECT id, priority FROM od WHERE priority >= '3-'")
def lot_filter_ge_text(spark, sf_dir):
    o = tables.order_docs(spark, sf_dir)
    return o.where(json_ops.filter_column("doc", {"ge": ["priority", "3-"]})).select("id", json_ops.field("doc", "priority").alias("priority"))


@query(_O + "SELECT id FROM od WHERE status = 'F' AND priority = '1-URGENT' AND total >= 5000000")
def lot_filter_and(spark, sf_dir):
    spec = {"and": [{"eq": ["status", "F"]}, {"eq": ["priority", "1-URGENT"]}], "ge": ["total", 5000000]}
    return tables.order_docs(spark, sf_dir).where(json_ops.filter_column("doc", spec)).select("id")


@query(_O + "SELECT id FROM od WHERE false")
def lot_filter_malformed(spark, sf_dir):
    """A filter that is none matches nothing."""
    return tables.order_docs(spark, sf_dir).where(json_ops.filter_column("doc", {"eq": "status"})).select("id")


@query(_O + "SELECT id FROM od")
def lot_filter_missing_field(spark, sf_dir):
    """A missing field equals the empty text."""
    return tables.order_docs(spark, sf_dir).where(json_ops.filter_column("doc", {"eq": ["nosuch", ""]})).select("id")


@query(_O + "SELECT least(count(*), 1000000000) AS n FROM od")
def lot_count(spark, sf_dir):
    return lot.count(tables.order_docs(spark, sf_dir), {"limit": 1_000_000_000})


@query(_O + "SELECT least(count(*), 25) AS n FROM od WHERE orderkey >= 16 AND orderkey < 400")
def lot_count_range(spark, sf_dir):
    return lot.count(tables.order_docs(spark, sf_dir), {"limit": 25, "from_id": _id(16), "to_id": _id(400)})


@query(_O + "SELECT od.id AS left_id, cd.id, CAST(to_json({'name': name}) AS VARCHAR) AS doc FROM od JOIN cd ON od.customer_id = cd.id")
def lot_join(spark, sf_dir):
    """Each order's customer, without caps: the join alone."""
    l = tables.order_docs(spark, sf_dir).select(F.col("id").alias("left_id"), json_ops.field("doc", "customer_id").alias("id"))
    return l.join(tables.customer_docs(spark, sf_dir), "id").select("left_id", "id", json_ops.project("doc", ["name"]).alias("doc"))


@query(_O + "SELECT cd.id, CAST(to_json({'name': name}) AS VARCHAR) AS doc FROM (SELECT * FROM od WHERE status = 'F' ORDER BY id LIMIT 40) l JOIN cd ON l.customer_id = cd.id ORDER BY l.id LIMIT 25")
def lot_join_capped(spark, sf_dir):
    spec = {"on": "customer_id", "left_max": 40, "right_max": 25, "left": _scan(60, ["orderkey"], filter={"eq": ["status", "F"]}), "right": {"coll": "ocustomers", "from_left": "customer_id", "proj": ["name"]}}
    return _run(spark, sf_dir, {"join": spec}).docs.select("id", "doc")


@query(_O + "SELECT priority AS k, count(*) AS n, CAST(sum(total) AS BIGINT) AS s FROM od GROUP BY priority")
def lot_group(spark, sf_dir):
    return lot.group(tables.order_docs(spark, sf_dir), {"by": ["priority"], "sum": "total", "limit": 1 << 30}).select("k", "n", F.col("s").cast("long").alias("s"))


@query(_O + "SELECT k, n, s FROM (SELECT customer_id AS k, count(*) AS n, CAST(sum(total) AS BIGINT) AS s, min(id) AS f FROM od GROUP BY customer_id ORDER BY f LIMIT 15)")
def lot_group_limit(spark, sf_dir):
    """Groups in the order first seen."""
    return lot.group(tables.order_docs(spark, sf_dir), {"by": ["customer_id"], "sum": "total", "limit": 15}).select("k", "n", F.col("s").cast("long").alias("s"))


@query(_O + "SELECT '' AS k, count(*) AS n, 0::BIGINT AS s FROM od")
def lot_group_global(spark, sf_dir):
    """No field: one group; a sum over text that is no number is 0."""
    return lot.group(tables.order_docs(spark, sf_dir), {"by": [], "sum": "status", "limit": 5}).select("k", "n", F.col("s").cast("long").alias("s"))


@query(_O + "SELECT CAST(to_json({'k': status, 'n': count(*), 's': CAST(sum(total) AS BIGINT)}) AS VARCHAR) AS doc FROM (SELECT * FROM od ORDER BY id LIMIT 500) GROUP BY status")
def lot_nest_group(spark, sf_dir):
    spec = {"depth": 1, "src": {"scan": _scan(500, ["status", "total"])}, "then": {"group": {"by": ["status"], "sum": "total", "limit": 10}}}
    return _run(spark, sf_dir, {"nest": spec}).docs.select("doc")


@query(_O + "SELECT CAST(x.op AS INTEGER) AS op, x.id, x.doc FROM (SELECT 0 AS op, id, CAST(to_json({'status': status}) AS VARCHAR) AS doc FROM (SELECT * FROM od ORDER BY id LIMIT 5) UNION ALL SELECT 1, id, doc FROM od WHERE orderkey = 3) x")
def lot_combined(spark, sf_dir):
    return _run(spark, sf_dir, {"scan": _scan(5, ["status"])}, {"get": {"coll": "orders", "id": _id(3)}}).docs.select("op", "id", "doc")


# writes


@query("""SELECT 'orders' AS coll, '0000000000000000000000000000000a' AS id, '{"total":5,"status":"N"}' AS doc, false AS deleted""")
def lot_ins(spark, sf_dir):
    return _run(spark, sf_dir, {"ins": {"coll": "orders", "doc": {"total": 5, "status": "N"}}}).writes


def _cas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every open order asks to be closed; those of low priority expect an outdated document."""
    o = tables.order_docs(spark, sf_dir)
    ask = o.where(json_ops.field_eq("doc", "status", "O"))
    expect = F.when(json_ops.field("doc", "priority") == "5-LOW", F.sha2(F.concat("doc", F.lit("x")), 256)).otherwise(ids.doc_hash("doc"))
    return lot.compare_and_set(o, ask.select("id", expect.alias("expect"), json_ops.mutate("doc", [{"op": 1, "f": "status", "v": "C"}]).alias("doc")))


@query(_O + "SELECT id, CAST(to_json({'customer_id': customer_id, 'orderkey': orderkey, 'priority': priority, 'status': 'C', 'total': total}) AS VARCHAR) AS doc FROM od WHERE status = 'O' AND priority <> '5-LOW'")
def cas_hit(spark, sf_dir):
    return _cas(spark, sf_dir)[0].select("id", "doc")


@query(_O + "SELECT id, sha256(doc || 'x') AS expect FROM od WHERE status = 'O' AND priority = '5-LOW'")
def cas_miss(spark, sf_dir):
    return _cas(spark, sf_dir)[1].select("id", "expect")


def _mutated(spark: SparkSession, sf_dir: str, **op) -> DataFrame:
    return tables.order_docs(spark, sf_dir).select("id", json_ops.mutate("doc", [op]).alias("doc"))


_ALL = "'customer_id': customer_id, 'orderkey': orderkey, 'priority': priority"


@query(_O + f"SELECT id, CAST(to_json({{{_ALL}, 'status': 'X', 'total': total}}) AS VARCHAR) AS doc FROM od")
def mut_set(spark, sf_dir):
    return _mutated(spark, sf_dir, op=1, f="status", v="X")


@query(_O + f"SELECT id, CAST(to_json({{{_ALL}, 'status': status, 'total': total, 'urgent': true}}) AS VARCHAR) AS doc FROM od")
def mut_set_if_absent(spark, sf_dir):
    o = tables.order_docs(spark, sf_dir)
    return o.select("id", json_ops.mutate("doc", [{"op": 2, "f": "status", "v": "X"}, {"op": 2, "f": "urgent", "v": True}]).alias("doc"))


@query(_O + f"SELECT id, CAST(to_json({{{_ALL}, 'status': 7, 'total': total + 100}}) AS VARCHAR) AS doc FROM od")
def mut_incr(spark, sf_dir):
    """A field that is no number counts as 0."""
    o = tables.order_docs(spark, sf_dir)
    return o.select("id", json_ops.mutate("doc", [{"op": 3, "f": "total", "v": 100}, {"op": 3, "f": "status", "v": 7}]).alias("doc"))


@query(_O + f"SELECT id, CAST(to_json({{{_ALL}, 'total': total}}) AS VARCHAR) AS doc FROM od")
def mut_clear(spark, sf_dir):
    return _mutated(spark, sf_dir, op=8, f="status")


@query(_O + "SELECT id FROM cd WHERE segment = 'BUILDING'")
def del_expect(spark, sf_dir):
    """Customers of a segment are deleted if they are still as read."""
    c = tables.customer_docs(spark, sf_dir)
    ask = c.where(json_ops.field_eq("doc", "segment", "BUILDING")).select("id", ids.doc_hash("doc").alias("expect"), F.lit(None).cast("string").alias("doc"))
    return lot.compare_and_set(c, ask)[0].select("id")


@query(_O + f"SELECT id, CAST(to_json({{{_ALL}, 'status': status, 'total': total + 1}}) AS VARCHAR) AS doc FROM od WHERE status = 'P' ORDER BY id LIMIT 30")
def nest_cas(spark, sf_dir):
    all_fields = ["customer_id", "orderkey", "priority", "status", "total"]
    spec = {"depth": 1, "src": {"scan": _scan(30, all_fields, filter={"eq": ["status", "P"]})}, "then": {"cas": {"coll": "orders", "ops": [{"op": 3, "f": "total", "v": 1}]}}}
    return _run(spark, sf_dir, {"nest": spec}).writes.select("id", "doc")


@query(_O + "SELECT DISTINCT CAST(('0x' || sha256(id)[1:4])::INTEGER >> 6 AS INTEGER) AS shard FROM (SELECT id FROM od WHERE status = 'P' ORDER BY id LIMIT 30)")
def lot_shards(spark, sf_dir):
    return lot.touched_shards(nest_cas(spark, sf_dir))


@query(_O + "SELECT id, sha256(doc) AS hash FROM od")
def doc_hash(spark, sf_dir):
    return tables.order_docs(spark, sf_dir).select("id", ids.doc_hash("doc").alias("hash"))
