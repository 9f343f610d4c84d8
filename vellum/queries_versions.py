"""Queries over version streams: time travel, retention, replay, merging, integrity, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids
from vellum.operators import integrity, merge, mvcc
from vellum.registering import Entry, collector
from vellum.sources import tables
from vellum.streaming import feed

QUERIES: dict[str, Entry] = {}
query = collector(QUERIES)

_V = "WITH v AS (SELECT printf('%08d', user_id) AS key, printf('%012d', event_id) AS ver, event_type = 'error' AS deleted, event_type AS value FROM events), l AS (SELECT key, arg_max({'ver': ver, 'deleted': deleted, 'value': value}, ver) AS x FROM v GROUP BY key) "
_MARK = _V.rstrip() + ", m AS (SELECT *, ver = max(ver) OVER (PARTITION BY key) AND NOT deleted AS hot FROM v) "
SNAP = "000000000500"


def _v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_versions(spark, sf_dir)


@query(_V + "SELECT key, x.ver AS ver, x.value AS value FROM l WHERE NOT x.deleted")
def latest_version(spark, sf_dir):
    return mvcc.latest(_v(spark, sf_dir)).select("key", "ver", "value")


@query(_V + f"SELECT key, x.ver AS ver, x.value AS value FROM (SELECT key, arg_max({{'ver': ver, 'deleted': deleted, 'value': value}}, ver) AS x FROM v WHERE ver <= '{SNAP}' GROUP BY key) WHERE NOT x.deleted")
def as_of(spark, sf_dir):
    return mvcc.as_of(_v(spark, sf_dir), SNAP).select("key", "ver", "value")


@query(_V + "SELECT q.key, q.snap, x.ver AS ver, x.value AS value FROM (SELECT q.key, q.snap, arg_max({'ver': v.ver, 'deleted': v.deleted, 'value': v.value}, v.ver) AS x FROM (SELECT DISTINCT key, ver AS snap FROM v WHERE deleted) q JOIN v ON v.key = q.key AND v.ver < q.snap GROUP BY ALL) q WHERE NOT x.deleted")
def as_of_per_row(spark, sf_dir):
    """What each delete hid: the entry just before it."""
    v = _v(spark, sf_dir)
    before = F.lpad((F.col("ver").cast("long") - 1).cast("string"), 12, "0")
    out = mvcc.as_of_each(v.where("deleted").select("key", before.alias("snap")), v)
    return out.select("key", F.lpad((F.col("snap").cast("long") + 1).cast("string"), 12, "0").alias("snap"), "ver", "value")


@query(_V + f"SELECT count(*) AS keys_then, (SELECT count(*) FROM l WHERE NOT x.deleted) AS keys_now FROM (SELECT key, arg_max(deleted, ver) AS gone FROM v WHERE ver <= '{SNAP}' GROUP BY key) WHERE NOT gone")
def view_isolation(spark, sf_dir):
    """A view keeps what it saw, whatever is written after."""
    v = _v(spark, sf_dir)
    then = mvcc.as_of(v, SNAP).agg(F.count("*").alias("keys_then"))
    return then.join(F.broadcast(mvcc.latest(v).agg(F.count("*").alias("keys_now"))))  # one row each


@query(_V + "SELECT key, ver, deleted, value FROM v")
def all_versions(spark, sf_dir):
    return mvcc.retain(_v(spark, sf_dir), "keep_all")[0]


@query(_V + "SELECT max(ver) AS snap FROM v")
def freeze(spark, sf_dir):
    return mvcc.freeze(_v(spark, sf_dir))


@query(_V + "SELECT CAST(sum(n) AS BIGINT) AS versions, count(*) AS keys, CAST(sum(n - CASE WHEN gone THEN 0 ELSE 1 END) AS BIGINT) AS pruned FROM (SELECT key, count(*) AS n, arg_max(deleted, ver) AS gone FROM v GROUP BY key)")
def version_count(spark, sf_dir):
    return mvcc.version_stats(_v(spark, sf_dir))


@query(_V + "SELECT key, ver, value FROM (SELECT *, lead(value) OVER w AS nv, lead(ver) OVER w AS nk FROM v WINDOW w AS (PARTITION BY key ORDER BY ver)) WHERE nk IS NULL OR value IS DISTINCT FROM nv")
def same_value_collapse(spark, sf_dir):
    return mvcc.collapse(_v(spark, sf_dir)).select("key", "ver", "value")


@query(_MARK + "SELECT key, ver, value FROM m WHERE hot")
def retain_prune(spark, sf_dir):
    return mvcc.retain(_v(spark, sf_dir), "prune")[0].select("key", "ver", "value")


@query(_MARK + "SELECT key, ver, value FROM m WHERE hot")
def retain_archive_hot(spark, sf_dir):
    return mvcc.retain(_v(spark, sf_dir), "archive")[0].select("key", "ver", "value")


@query(_MARK + "SELECT key, ver, deleted, value FROM m WHERE NOT hot")
def retain_archive_cold(spark, sf_dir):
    return mvcc.retain(_v(spark, sf_dir), "archive")[1].select("key", "ver", "deleted", "value")


@query(QUERIES["as_of"].sql)
def hot_cold_as_of(spark, sf_dir):
    """Archiving changes no answer about the past."""
    hot, cold = mvcc.retain(_v(spark, sf_dir), "archive")
    return mvcc.as_of(hot, SNAP, cold).select("key", "ver", "value")


@query(_V + "SELECT key, x.ver AS ver FROM l WHERE x.deleted")
def tombstone_no_resurrect(spark, sf_dir):
    """Keys whose delete hides older versions: no live entry of theirs comes back from the archive."""
    v = _v(spark, sf_dir)
    hot, cold = mvcc.retain(v, "archive")
    live = mvcc.latest(mvcc.merge_history(hot, cold)).select("key")
    return mvcc.newest(v).join(live, "key", "left_anti").select("key", "ver")


@query(_V + f"SELECT key, ver, value FROM v WHERE ver >= '{SNAP}'")
def gc_before(spark, sf_dir):
    return mvcc.gc_before(_v(spark, sf_dir), SNAP).select("key", "ver", "value")


# a log: signups begin a user's transaction, a purchase commits it, errors delete

_LOG = """WITH log AS (
  SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'checkpoint' WHEN 'error' THEN 'del' ELSE 'put' END AS op,
         CASE WHEN event_type IN ('purchase', 'view') THEN user_id END AS txn, printf('%08d', user_id) AS key, printf('%012d', event_id) AS ver, event_type = 'error' AS deleted, event_type AS value FROM events),
c AS (SELECT * FROM log WHERE op IN ('put', 'del') AND (txn IS NULL OR txn IN (SELECT txn FROM log WHERE op = 'commit'))) """


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "commit").when(kind == "signup", "checkpoint").when(kind == "error", "del").otherwise("put")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(kind.isin("purchase", "view"), F.col("user_id")).alias("txn"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ver"), (kind == "error").alias("deleted"), kind.alias("value"))


@query(_LOG + "SELECT seq, key, value FROM c")
def tx_committed_only(spark, sf_dir):
    return mvcc.committed(_log(spark, sf_dir)).select("seq", "key", "value")


@query(_LOG + "SELECT key, x.value AS value FROM (SELECT key, arg_max({'deleted': deleted, 'value': value}, ver) AS x FROM c GROUP BY key) WHERE NOT x.deleted")
def replay_fold(spark, sf_dir):
    return mvcc.replay(_log(spark, sf_dir)).select("key", "value")


@query(_LOG + "SELECT key, x.value AS value FROM (SELECT key, arg_max({'deleted': deleted, 'value': value}, ver) AS x FROM c WHERE seq > 400 GROUP BY key) WHERE NOT x.deleted")
def replay_resume(spark, sf_dir):
    return mvcc.replay(_log(spark, sf_dir), 400).select("key", "value")


@query(_LOG + "SELECT coalesce(max(seq), 0) AS after FROM log WHERE op = 'checkpoint'")
def replay_resume_point(spark, sf_dir):
    return mvcc.resume_point(_log(spark, sf_dir))


@query(_LOG + "SELECT seq AS after, nx AS next FROM (SELECT seq, lead(seq) OVER (ORDER BY seq) AS nx FROM log WHERE op <> 'checkpoint') WHERE nx > seq + 1")
def wal_gap_detect(spark, sf_dir):
    return mvcc.gaps(_log(spark, sf_dir).where("op <> 'checkpoint'"))


@query(_LOG + "SELECT CASE WHEN seq <= (SELECT min(seq) FROM (SELECT seq, lead(seq) OVER (ORDER BY seq) AS nx FROM log WHERE op <> 'checkpoint') WHERE nx > seq + 1) THEN 'kept' ELSE 'quarantined' END AS part, count(*) AS n FROM log WHERE op <> 'checkpoint' GROUP BY ALL")
def wal_repair(spark, sf_dir):
    kept, bad = mvcc.cut_at_gap(_log(spark, sf_dir).where("op <> 'checkpoint'"))
    both = kept.withColumn("part", F.lit("kept")).unionByName(bad.withColumn("part", F.lit("quarantined")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query(_LOG + "SELECT CASE WHEN seq > (SELECT coalesce(max(seq), 0) FROM log WHERE op = 'checkpoint') THEN 'kept' ELSE 'archived' END AS part, count(*) AS n FROM log GROUP BY ALL")
def wal_truncate(spark, sf_dir):
    kept, old = mvcc.truncate(_log(spark, sf_dir))
    both = kept.withColumn("part", F.lit("kept")).unionByName(old.withColumn("part", F.lit("archived")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


# three sides of the orders: each drops and edits by its own rules

_SIDES = """WITH x AS (SELECT o_orderkey AS key, o_orderkey AS ver, CAST(round(o_totalprice * 100) AS BIGINT) AS val_crc, o_orderstatus AS st, o_orderpriority AS pr, year(o_orderdate) AS yr, o_custkey AS cu FROM orders),
b AS (SELECT key, ver, val_crc, false AS deleted FROM x WHERE pr <> '2-HIGH'),
o AS (SELECT key, CASE WHEN pr = '1-URGENT' THEN ver + cu ELSE ver END AS ver, CASE WHEN pr = '1-URGENT' THEN val_crc + 1 WHEN pr = '2-HIGH' AND yr >= 1995 THEN val_crc + 3 ELSE val_crc END AS val_crc, st = 'F' AND pr = '4-NOT SPECIFIED' AS deleted FROM x WHERE NOT (st = 'P' OR (pr = '3-MEDIUM' AND yr = 1994))),
t AS (SELECT key, CASE WHEN st = 'F' THEN ver + 500 ELSE ver END AS ver, CASE WHEN st = 'F' AND yr <> 1993 THEN val_crc + 2 WHEN st = 'F' THEN val_crc + 1 ELSE val_crc END AS val_crc, false AS deleted FROM x WHERE NOT (pr = '5-LOW' OR (pr = '1-URGENT' AND yr = 1996))),
j AS (SELECT coalesce(b.key, o.key, t.key) AS key, b, o, t, b.key IS NOT NULL AS hb, o.key IS NOT NULL AS ho, t.key IS NOT NULL AS ht,
  (o.val_crc, o.deleted) IS DISTINCT FROM (b.val_crc, b.deleted) AS om, (t.val_crc, t.deleted) IS DISTINCT FROM (b.val_crc, b.deleted) AS tm, (o.val_crc, o.deleted) IS NOT DISTINCT FROM (t.val_crc, t.deleted) AS eq,
  t.ver > o.ver AS tn FROM b FULL JOIN o ON b.key = o.key FULL JOIN t ON t.key = coalesce(b.key, o.key)),
r AS (SELECT *, CASE WHEN NOT hb AND ho AND ht THEN CASE WHEN NOT eq AND tn THEN 'theirs' ELSE 'ours' END WHEN NOT hb THEN CASE WHEN ho THEN 'ours' ELSE 'theirs' END
  WHEN ho AND ht THEN CASE WHEN om AND tm THEN CASE WHEN NOT eq AND tn THEN 'theirs' ELSE 'ours' END WHEN om THEN 'ours' WHEN tm THEN 'theirs' ELSE 'base' END
  WHEN ho AND om THEN 'ours' WHEN ht AND tm THEN 'theirs' END AS side,
  CASE WHEN ho AND ht THEN (NOT hb OR (om AND tm)) AND NOT eq ELSE hb END AS conflict FROM j) """


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("ver"), F.round(F.col("o_totalprice") * 100).cast("long").alias("val_crc"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.year("o_orderdate").alias("yr"), F.col("o_custkey").alias("cu"))
    never = F.lit(False).alias("deleted")
    base = x.where("pr <> '2-HIGH'").select("key", "ver", "val_crc", never)
    ours = x.where("not (st = 'P' or (pr = '3-MEDIUM' and yr = 1994))").select("key", F.expr("case when pr = '1-URGENT' then ver + cu else ver end").alias("ver"), F.expr("case when pr = '1-URGENT' then val_crc + 1 when pr = '2-HIGH' and yr >= 1995 then val_crc + 3 else val_crc end").alias("val_crc"), F.expr("st = 'F' and pr = '4-NOT SPECIFIED'").alias("deleted"))
    theirs = x.where("not (pr = '5-LOW' or (pr = '1-URGENT' and yr = 1996))").select("key", F.expr("case when st = 'F' then ver + 500 else ver end").alias("ver"), F.expr("case when st = 'F' and yr <> 1993 then val_crc + 2 when st = 'F' then val_crc + 1 else val_crc end").alias("val_crc"), never)
    return base, ours, theirs


@query(_SIDES + "SELECT key, CASE side WHEN 'ours' THEN o.ver WHEN 'theirs' THEN t.ver ELSE b.ver END AS ver, CASE side WHEN 'ours' THEN o.val_crc WHEN 'theirs' THEN t.val_crc ELSE b.val_crc END AS val_crc, CASE side WHEN 'ours' THEN o.deleted WHEN 'theirs' THEN t.deleted ELSE b.deleted END AS deleted, side, conflict FROM r WHERE side IS NOT NULL")
def three_way_merge(spark, sf_dir):
    return merge.three_way_merge(*_sides(spark, sf_dir))


@query(_SIDES + "SELECT side, conflict, count(*) AS n FROM r WHERE side IS NOT NULL GROUP BY ALL")
def merge_conflicts(spark, sf_dir):
    return merge.three_way_merge(*_sides(spark, sf_dir)).groupBy("side", "conflict").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def merge_sorted_union(spark, sf_dir):
    return merge.union_sorted(tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct(), tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


# images: the texts of pages, before and after a change of each page's block 1

_BLOCKS = """WITH p AS (SELECT page_id, encode(html) AS v FROM pages WHERE html IS NOT NULL), n AS (SELECT page_id, v, greatest(1, CAST(ceil(octet_length(v) / 4096) AS INTEGER)) AS k FROM p),
s AS (SELECT page_id, i AS no, v[i * 4096 + 1 : i * 4096 + 4096] AS data FROM (SELECT page_id, v, unnest(range(k)) AS i FROM n)) """


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "pages").where("html is not null")
    return merge.split_blocks(p, "page_id", "html")


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _blocks(spark, sf_dir).select((F.col("page_id") * 100_000 + F.col("block_no")).alias("block_no"), "data", (F.col("block_no") == 1).alias("edit"))
    dst = b.select("block_no", F.when(F.col("edit"), F.concat(F.lit(b"!"), "data")).otherwise(F.col("data")).alias("data"))
    return b.select("block_no", "data"), dst


@query(_BLOCKS + "SELECT page_id * 100000 + no AS block_no, octet_length(data) + 1 AS bytes FROM s WHERE no = 1")
def delta_encode(spark, sf_dir):
    return merge.delta_encode(*_delta(spark, sf_dir)).select("block_no", F.octet_length("data").cast("long").alias("bytes"))


@query(_BLOCKS + "SELECT page_id * 100000 + no AS block_no, sha256(CASE WHEN no = 1 THEN '!'::BLOB || data ELSE data END) AS hash FROM s")
def delta_apply(spark, sf_dir):
    src, dst = _delta(spark, sf_dir)
    return merge.delta_apply(src, merge.delta_encode(src, dst)).select("block_no", F.sha2("data", 256).alias("hash"))


@query("SELECT page_id, sha256(html) AS hash FROM pages WHERE html IS NOT NULL")
def block_reassembly(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages").where("html is not null")
    sizes = p.select("page_id", F.octet_length("html").alias("bytes"))
    return merge.join_blocks(_blocks(spark, sf_dir), sizes, "page_id").select("page_id", F.sha2("value", 256).alias("hash"))


@query("SELECT sha256(text) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cas_dedup(spark, sf_dir):
    return integrity.content_store(tables.table(spark, sf_dir, "documents"), "text").select("hash", "copies")


@query("SELECT name, n FROM (SELECT 'hot' AS name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'shadow', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'))")
def shadow_counts(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return integrity.count_rows(hot=o, shadow=o.where("o_orderstatus <> 'P'"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing in b' ELSE 'o_totalprice' END AS difference FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'")
def shadow_diff(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    shadow = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return integrity.differences(o, shadow, ["o_orderkey"])


def _tlv(column: str, tag: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"'{len(column)}:{column}=' || coalesce('{tag}:' || strlen({text}) || ':' || {text}, '0:') || ';'"


@query(f"SELECT c_custkey, sha256({_tlv('c_custkey', '1')} || {_tlv('c_mktsegment', '3')} || {_tlv('c_name', '3')} || {_tlv('c_nationkey', '1')}) AS row_hash FROM customer")
def canonical_row_hash(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return integrity.row_hashes(c, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, '1:' || strlen(l_orderkey::VARCHAR) || ':' || l_orderkey || ';1:' || strlen(l_linenumber::VARCHAR) || ':' || l_linenumber || ';' AS encoded, l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b FROM lineitem")
def composite_key(spark, sf_dir):
    l = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    l = l.withColumn("encoded", integrity.encode_key(l, ["l_orderkey", "l_linenumber"]))
    a, b = integrity.decode_key(F.col("encoded"), 2)
    return l.select("l_orderkey", "l_linenumber", "encoded", a.alias("a"), b.alias("b"))


_HIST = "WITH h AS (SELECT CAST(('0x' || sha256(printf('%032x', o_orderkey))[1:4])::INTEGER >> 6 AS INTEGER) AS shard, count(*) AS n FROM orders GROUP BY 1) "


@query(_HIST + "SELECT shard, n FROM h")
def shard_histogram(spark, sf_dir):
    return integrity.shard_histogram(tables.order_docs(spark, sf_dir), ids.route("id"))


@query(_HIST + "SELECT round(sum(n * n) * 1024 / sum(n) - sum(n), 6) AS chi2, CAST(sum(n) AS BIGINT) AS n FROM h")
def shard_chi2(spark, sf_dir):
    h = integrity.shard_histogram(tables.order_docs(spark, sf_dir), ids.route("id"))
    return integrity.chi_square(h, ids.SHARDS).select(F.round("chi2", 6).alias("chi2"), "n")


@query(_HIST + "SELECT CASE shard WHEN 7 THEN 9 ELSE shard END AS shard, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1")
def shard_migrate(spark, sf_dir):
    return integrity.shard_histogram(tables.order_docs(spark, sf_dir), integrity.migrate(ids.route("id"), 7, 9))


@query("SELECT count(*) AS entries, CAST(sum(strlen(printf('%08d', doc_id))) AS BIGINT) AS key_bytes, CAST(sum(strlen(text)) AS BIGINT) AS value_bytes, count(*) FILTER (strlen(text) > 2048) AS large FROM documents")
def page_stats(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return integrity.table_stats(tables.entries(d, F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.col("text")))


# the change feed: events with kinds, by shard

_FEED = "WITH f AS (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'compaction' WHEN 'signup' THEN 'prune' ELSE 'mutation' END AS kind, CAST(user_id % 16 AS INTEGER) AS shard, printf('%08d', user_id) AS key, printf('%012d', event_id) AS ver, event_type = 'error' AS deleted, event_type AS value FROM events) "


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    k = F.col("event_type")
    kind = F.when(k == "purchase", "compaction").when(k == "signup", "prune").otherwise("mutation")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("user_id") % 16).cast("int").alias("shard"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ver"), (k == "error").alias("deleted"), k.alias("value"))


@query(_FEED + "SELECT kind, count(*) AS n FROM f GROUP BY kind")
def feed_kind_counts(spark, sf_dir):
    return feed.kind_counts(_feed(spark, sf_dir))


@query(_FEED + "SELECT key, x.ver AS ver, x.value AS value FROM (SELECT key, arg_max({'ver': ver, 'deleted': deleted, 'value': value}, ver) AS x FROM f WHERE kind = 'mutation' GROUP BY key) WHERE NOT x.deleted")
def feed_latest_state(spark, sf_dir):
    return feed.latest_state(_feed(spark, sf_dir)).select("key", "ver", "value")


@query(_FEED + "SELECT seq AS after, nx AS next FROM (SELECT seq, lead(seq) OVER (ORDER BY seq) AS nx FROM f WHERE kind = 'mutation') WHERE nx > seq + 1")
def feed_seq_gaps(spark, sf_dir):
    return mvcc.gaps(_feed(spark, sf_dir).where("kind = 'mutation'"))


@query(_FEED + "SELECT shard, max(seq) AS last_seq, (SELECT max(seq) FROM f) - max(seq) AS lag FROM f GROUP BY shard")
def feed_lag_by_shard(spark, sf_dir):
    return feed.lag_by_shard(_feed(spark, sf_dir))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def feed_tumbling(spark, sf_dir):
    out = feed.tumbling(_feed(spark, sf_dir), "1 hour", "1 day", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "value", "n")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def feed_sliding(spark, sf_dir):
    return feed.sliding(_feed(spark, sf_dir), "2 hours", "1 hour", "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT printf('%08d', user_id) AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def feed_sessions(spark, sf_dir):
    return feed.sessions(_feed(spark, sf_dir), "1 hour", "1 day", "key").select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
