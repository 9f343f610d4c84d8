"""The engine's parts on small inputs: builder, language, versions, merging, store, feed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import blake3, ids, json_ops
from vellum.operators import integrity, merge, mvcc
from vellum.operators import query as q
from vellum.operators.query import NotFound, Query
from vellum.plans import lot
from vellum.sources.sqltable import SqlTable, Violation
from vellum.sources.store import Corrupt, Lost, NeedsRecovery, Store, apply_snapshot, open_snapshot
from vellum.streaming import feed


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(f"item:{i:03d}", f"v{i}") for i in range(50)], "key string, value string").withColumn("value_len", F.octet_length("value"))


def keys(df):
    return [r[0] for r in df.select("key").collect()]


def test_pages(items):
    every = [f"item:{i:03d}" for i in range(50)]
    x = Query(items)
    assert keys(x.limit(7).entries()) == every[:7]
    assert keys(x.offset(45).entries()) == every[45:]
    assert keys(x.reverse().offset(2).limit(3).entries()) == every[::-1][2:5]
    assert keys(x.limit(0).ordered().entries()) == every
    assert x.offset(60).count() == 0


def test_last_of_prefix_and_range_holds(items):
    assert Query(items).range("item:010", "item:020").prefix("item:04").count() == 10
    assert Query(items).prefix("item:04").range("item:010", "item:020").count() == 10


def test_first(items):
    assert Query(items).where(q.val_suffix("7")).first()["key"] == "item:007"
    with pytest.raises(NotFound):
        Query(items).where(q.val_prefix("x")).first()


def test_scan_stops(items):
    seen = []
    Query(items).scan(lambda r: seen.append(r["key"]) or len(seen) < 4)
    assert seen == [f"item:{i:03d}" for i in range(4)]


def test_key_predicates_reach_the_scan(spark, tmp_path, items, capsys):
    items.write.parquet(str(tmp_path / "t"))
    Query(spark.read.parquet(str(tmp_path / "t"))).prefix("item:01").keys().explain()
    plan = capsys.readouterr().out
    assert "StringStartsWith(key,item:01)" in plan and "ReadSchema: struct<key:string>" in plan


@pytest.mark.parametrize("p, bound", [(b"ab", b"ac"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None)])
def test_prefix_upper_bound(p, bound):
    assert q.prefix_upper_bound(p) == bound


def test_binary_keys(spark):
    df = spark.createDataFrame([(bytearray(b), bytearray(b"v")) for b in (b"\x00", b"\x00\x00", b"\x7f", b"\x80", b"\xff\xff")], "key binary, value binary").withColumn("value_len", F.octet_length("value"))
    assert [bytes(r[0]) for r in Query(df).ordered().entries().collect()] == [b"\x00", b"\x00\x00", b"\x7f", b"\x80", b"\xff\xff"]
    assert Query(df).range(b"\x7f", b"\xff").count() == 2
    assert Query(df).where(q.key_prefix(b"\x00")).count() == 2


JSON = [
    ('{"role":"x","note":"role:\\"agent\\""}', "x"),
    ('{"note":"\\"role\\":\\"agent\\"","role":"agent"}', "agent"),
    ('{"inner":{"role":"agent"}}', None),
    ('{"role":7}', None),
    ('{"role":null}', None),
    ("not json", None),
    ("", None),
    (None, None),
]


def test_string_field_is_top_level_and_a_string(spark):
    df = spark.createDataFrame([(d,) for d, _ in JSON], "value string")
    assert [r[0] for r in df.select(json_ops.string_field("value", "role")).collect()] == [w for _, w in JSON]
    assert df.where(q.json_eq("role", "agent")).count() == 1


def test_field_text_and_comparison(spark):
    df = spark.createDataFrame([('{"n":10}',), ('{"n":9}',), ('{"n":"abc"}',), ('{"n":null}',), ("x",), ('{"n":" 5"}',), ('{"n":"99999999999999999999"}',)], "doc string")
    assert [r[0] for r in df.select(json_ops.field("doc", "n")).collect()] == ["10", "9", "abc", "", "", " 5", "99999999999999999999"]
    assert [r[0] for r in df.select(json_ops.field_ge("doc", "n", 10)).collect()] == [True, False, True, False, False, False, True]
    assert [r[0] for r in df.select(json_ops.field_ge("doc", "n", "ab")).collect()] == [False, False, True, False, False, False, False]


def test_unsigned_sums_saturate_and_wrap(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("2",), ("99999999999999999999999",), ("-1",), ("x",)], "t string")
    assert [int(r[0]) for r in df.select(json_ops.u64(F.col("t"))).collect()] == [2**64 - 1, 2, 2**64 - 1, 0, 0]
    assert int(df.limit(2).agg(json_ops.wrap_u64(F.sum(json_ops.u64(F.col("t"))))).first()[0]) == 1


def test_mutations(spark):
    df = spark.createDataFrame([('{"b":1,"a":"x","c":{"z":1,"y":[1, 2]}}',), ("[1]",), ("no",)], "doc string")
    ops = [{"op": 1, "f": "d", "v": None}, {"op": 2, "f": "a", "v": 5}, {"op": 3, "f": "b", "v": 2}, {"op": 3, "f": "e", "v": 4}, {"op": 8, "f": "c"}]
    assert [r[0] for r in df.select(json_ops.mutate("doc", ops)).collect()] == ['{"a":"x","b":3,"d":null,"e":4}', None, None]
    with pytest.raises(ValueError):
        json_ops.mutate("doc", [{"op": 9, "f": "x"}])


def test_projection(spark):
    df = spark.createDataFrame([('{"b":1,"a":"x"}',), ("[1]",), (None,)], "doc string")
    assert [r[0] for r in df.select(json_ops.project("doc", ["b", "zz", "a"])).collect()] == ['{"a":"x","b":1}', "[1]", None]


CAP = {"prefix": "t_", "quota_bytes": 1 << 20, "quota_ops": 2}
ID = "0" * 31 + "1"
SCAN = {"coll": "t_x", "limit": 5, "proj": ["a"]}
REFUSED = [
    ("op", "no json"),
    ("op", {"cap": CAP}),
    ("capability", {"op": {"get": {"coll": "t_x", "id": ID}}}),
    ("capability", {"cap": {**CAP, "prefix": ""}, "op": {"get": {"coll": "t_x", "id": ID}}}),
    ("capability", {"cap": CAP, "op": {"get": {"coll": "other", "id": ID}}}),
    ("id", {"cap": CAP, "op": {"get": {"coll": "t_x", "id": "12"}}}),
    ("id", {"cap": CAP, "as_of": "zz", "op": {"scan": SCAN}}),
    ("op", {"cap": CAP, "op": {"get": {"coll": "t_x", "id": ID}, "scan": SCAN}}),
    ("op", {"cap": CAP, "op": {"drop": {}}}),
    ("op", {"cap": CAP, "op": {"get": {"coll": "t_x", "id": ID, "x": 1}}}),
    ("quota", {"cap": CAP, "ops": [{"scan": SCAN}] * 3}),
    ("quota", {"cap": CAP, "op": {"scan": {**SCAN, "limit": 1000}}}),
    ("quota", {"cap": CAP, "op": {"gets": {"coll": "t_x", "ids": [ID, ID], "limit": 1}}}),
    ("limit", {"cap": CAP, "op": {"scan": {**SCAN, "limit": 0}}}),
    ("limit", {"cap": CAP, "op": {"count": {"coll": "t_x"}}}),
    ("limit", {"cap": CAP, "op": {"group": {"by": ["a"], "limit": 3}}}),
    ("projection", {"cap": CAP, "op": {"scan": {**SCAN, "proj": []}}}),
    ("projection", {"cap": CAP, "op": {"scan": {**SCAN, "proj": ["a"] * 65}}}),
    ("join", {"cap": CAP, "op": {"join": {"left": SCAN, "left_max": 1, "right_max": 1}}}),
    ("join", {"cap": CAP, "op": {"join": {"on": "a", "left": SCAN, "left_max": 1}}}),
    ("op", {"cap": CAP, "op": {"ins": {"coll": "t_x"}}}),
    ("depth", {"cap": CAP, "op": {"nest": {"depth": 5, "src": {"scan": SCAN}, "then": {"group": {"by": ["a"], "limit": 1}}}}}),
]


@pytest.mark.parametrize("kind, request_", REFUSED)
def test_refusals(kind, request_):
    with pytest.raises(lot.Refused) as e:
        lot.validate(request_)
    assert e.value.kind == kind


def test_deep_nests_are_refused():
    op = {"scan": SCAN}
    for _ in range(5):
        op = {"nest": {"depth": 1, "src": op, "then": {"group": {"by": ["a"], "limit": 1}}}}
    with pytest.raises(lot.Refused):
        lot.validate({"cap": CAP, "op": op})


@pytest.fixture(scope="module")
def versioned(spark):
    rows = [(f"{i:032x}", f'{{"a":{v},"s":"{"odd" if i % 2 else "even"}"}}', f"{v:032x}", False) for i in range(1, 7) for v in (1, 2)] + [(f"{6:032x}", None, f"{3:032x}", True)]
    return {"t_x": spark.createDataFrame(rows, "id string, doc string, ver string, deleted boolean")}


def run(spark, versioned, **request):
    return lot.Planner(spark, versioned, lambda c: "f" * 32).run({"cap": CAP, **request})


def test_reads_see_one_snapshot(spark, versioned):
    now = run(spark, versioned, op={"scan": SCAN})
    assert [r["doc"] for r in now.docs.orderBy("pos").collect()] == ['{"a":2}'] * 5 and now.n() == 5
    then = run(spark, versioned, op={"scan": {**SCAN, "limit": 9}}, as_of=f"{1:032x}")
    assert [r["doc"] for r in then.docs.collect()] == ['{"a":1}'] * 6
    assert run(spark, versioned, op={"scan": {**SCAN, "limit": 2}}).next_from() == f"{3:032x}" and now.next_from() == ""


def test_missing_documents_are_errors(spark, versioned):
    with pytest.raises(lot.Missing):
        run(spark, versioned, op={"get": {"coll": "t_x", "id": f"{6:032x}"}})
    with pytest.raises(lot.Missing):
        run(spark, versioned, op={"gets": {"coll": "t_x", "ids": [f"{1:032x}", f"{9:032x}"], "limit": 4}})
    with pytest.raises(lot.Refused):
        run(spark, versioned, op={"get": {"coll": "t_none", "id": ID}})


def test_cas_and_del(spark, versioned):
    doc = '{"a":2,"s":"odd"}'
    digest = spark.range(1).select(F.sha2(F.lit(doc), 256)).first()[0]
    cas = {"cas": {"coll": "t_x", "id": ID, "expect": digest, "ops": [{"op": 3, "f": "a", "v": 5}]}}
    out = run(spark, versioned, ops=[cas])
    assert [tuple(r) for r in out.writes.collect()] == [("t_x", ID, '{"a":7,"s":"odd"}', False)]
    with pytest.raises(lot.Conflict):  # the second operation sees the first
        run(spark, versioned, ops=[cas, cas])
    after = out.docs.first()["hash"]
    out = run(spark, versioned, ops=[cas, {"del": {"coll": "t_x", "id": ID, "expect": after}}])
    assert [tuple(r) for r in out.writes.collect()] == [("t_x", ID, None, True)]
    with pytest.raises(lot.Conflict):
        run(spark, versioned, op={"cas": {"coll": "t_x", "id": ID, "expect": "", "doc": {}}})
    with pytest.raises(lot.Conflict):
        run(spark, versioned, op={"del": {"coll": "t_x", "id": ID, "expect": "00"}})
    fresh = run(spark, versioned, op={"cas": {"coll": "t_x", "id": "9" * 32, "expect": "", "doc": {"k": 1}}})
    assert fresh.writes.first()["doc"] == '{"k":1}'


def test_nested_group_keeps_order(spark, versioned):
    out = run(spark, versioned, op={"nest": {"depth": 1, "src": {"scan": {**SCAN, "proj": ["a", "s"]}}, "then": {"group": {"by": ["s"], "sum": "a", "limit": 5}}}})
    assert [r["doc"] for r in out.docs.orderBy("pos").collect()] == ['{"k":"odd","n":3,"s":6}', '{"k":"even","n":2,"s":4}']


def versions(spark, rows):
    return spark.createDataFrame(rows, "key string, ver string, deleted boolean, value string")


def test_as_of_every_version(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(5)}", f"{i:04d}", r.random() < 0.3, f"v{i}") for i in range(60)]
    v = versions(spark, rows)
    hot, cold = mvcc.retain(v, "archive")
    for snap in range(0, 60, 7):
        want = {}
        for k, ver, gone, value in rows[: snap + 1]:
            want[k] = None if gone else value
        want = {k: x for k, x in want.items() if x is not None}
        for got in (mvcc.as_of(v, f"{snap:04d}"), mvcc.as_of(hot, f"{snap:04d}", cold)):
            assert {x["key"]: x["value"] for x in got.collect()} == want


def test_an_empty_value_is_live(spark):
    v = versions(spark, [("a", "1", False, ""), ("b", "1", True, None), ("c", "1", False, None)])
    assert sorted(keys(mvcc.latest(v))) == ["a", "c"]


def test_collapse_keeps_the_newest_of_a_run(spark):
    v = versions(spark, [("a", f"{i}", False, x) for i, x in enumerate("xxyyx")])
    assert [r["ver"] for r in mvcc.collapse(v).orderBy("ver").collect()] == ["1", "3", "4"]


def test_replay_is_idempotent_and_all_or_nothing(spark):
    log = spark.createDataFrame([(1, "put", None, "a", "1", False, "x"), (2, "put", 7, "b", "2", False, "y"), (3, "put", 8, "a", "3", False, "lost"), (4, "commit", 7, None, None, None, None), (5, "del", 7, "a", "4", True, None)], "seq bigint, op string, txn bigint, key string, ver string, deleted boolean, value string")
    assert [(r["key"], r["value"]) for r in mvcc.replay(log.union(log)).collect()] == [("b", "y")]


def test_gaps_across_ranges(spark):
    s = spark.createDataFrame([(x,) for x in (1, 2, 5, 99_999, 100_000, 350_000)], "seq bigint")
    assert sorted(map(tuple, mvcc.gaps(s).collect())) == [(2, 5), (5, 99_999), (100_000, 350_000)]
    assert mvcc.gaps(s.limit(0)).count() == 0


def merged(base, ours, theirs):
    out = {}
    for k in {*base, *ours, *theirs}:
        b, o, t = base.get(k), ours.get(k), theirs.get(k)
        content = lambda x: x and x[1:]
        newer = "ours" if content(o) == content(t) or not (o and t) or t[0] <= o[0] else "theirs"
        if b is None:
            out[k] = (newer, content(o) != content(t)) if o and t else ("ours" if o else "theirs", False)
        elif o and t:
            om, tm = content(o) != content(b), content(t) != content(b)
            out[k] = (newer, content(o) != content(t)) if om and tm else ("ours" if om else "theirs" if tm else "base", False)
        elif o or t:
            if content(o or t) != content(b):
                out[k] = ("ours" if o else "theirs", True)
    return out


def test_three_way_merge_random(spark):
    r = random.Random(11)
    side = lambda: {k: (r.randrange(4), r.randrange(2), r.random() < 0.3) for k in range(300) if r.random() < 0.7}
    b, o, t = side(), side(), side()
    frame = lambda s: spark.createDataFrame([(k, *v) for k, v in s.items()], "key bigint, ver bigint, val_crc bigint, deleted boolean")
    got = {x["key"]: (x["side"], x["conflict"]) for x in merge.three_way_merge(frame(b), frame(o), frame(t)).collect()}
    assert got == merged(b, o, t)


def test_delta_round_trip(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "block_no bigint, data string")
    src, dst = frame({1: "a", 2: "b", 3: "c"}), frame({1: "a", 2: "x", 4: "d"})
    d = merge.delta_encode(src, dst)
    assert {r[0] for r in d.collect()} == {2, 3, 4}
    h = [merge.image_hash(x).first()[0] for x in (src, dst)]
    assert sorted(map(tuple, merge.delta_apply(src, d, *h).collect())) == sorted(map(tuple, dst.collect()))
    with pytest.raises(merge.DeltaMismatch):
        merge.delta_apply(dst, d, h[0])


def test_blocks_with_zeros(spark):
    values = {1: b"\0" * 9000, 2: b"x" * 4096 + b"\0" * 4096 + b"y", 3: b"z"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in values.items()], "id bigint, v binary")
    blocks = merge.split_blocks(df, "id", "v")
    assert blocks.where("id = 1").count() == 0 and blocks.where("id = 2").count() == 2
    back = merge.join_blocks(blocks, df.select("id", F.octet_length("v").alias("bytes")), "id")
    assert {r[0]: bytes(r[1]) for r in back.collect()} == values


def test_canonical_rows_are_injective(spark):
    rows = [("a", "b"), ("ab", ""), ("a", None), (None, "a"), ("", "ab"), ("1:a", "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(integrity.canonical_row(df)).distinct().count() == len(rows)
    key = integrity.encode_key(df, ["x", "y"])
    assert [tuple(r) for r in df.withColumn("k", key).select(*integrity.decode_key(F.col("k"), 2)).collect()] == rows


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, "z", 3)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "z", 3)], "k int, s string, n int")
    assert sorted(map(tuple, integrity.differences(a, b, ["k"]).collect())) == [(2, "n"), (3, "missing in b"), (4, "missing in a")]


def test_ids(spark):
    df = spark.range(5).select(ids.compose(F.col("id") * 1_234_567_891_011, ids.payload(F.col("id"), F.lit(200), F.lit(1023), F.lit(2**40 - 1))).alias("i"), "id")
    r = df.select("id", "i", ids.kind_of("i").alias("kind"), ids.coll_of("i").alias("coll"), ids.shard_of("i").alias("shard"), ids.counter_of("i").alias("counter"), ids.timestamp_ms("i").alias("ms"), ids.is_v7("i").alias("v7")).collect()
    assert all((x["kind"], x["coll"], x["shard"], x["counter"], x["ms"], x["v7"]) == (x["id"], 200, 1023, 2**40 - 1, x["id"] * 1_234_567_891_011 // 10**6, True) for x in r)
    t = spark.createDataFrame([("00000000-0000-7000-8000-000000000001",), ("urn:uuid:00000000-0000-7000-8000-00000000000A",), ("xyz",)], "t string")
    assert [x[0] for x in t.select(ids.parse("t")).collect()] == ["0" * 12 + "70008" + "0" * 14 + "1", "0" * 12 + "70008" + "0" * 14 + "a", None]


def test_blake3(spark):
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    df = spark.createDataFrame([("abc",), (None,), ("x" * 5000,)], "s string")
    got = [r[0] for r in df.select(blake3.blake3("s")).collect()]
    assert got[0] == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85" and got[1] is None and len(got[2]) == 64


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    assert s.versions().count() == 0
    s.put_batch([("a", "1"), ("b", "2")])
    first = s.freeze()
    s.put("a", "3")
    s.delete("b")
    assert s.get("a") == "3" and s.get("a", snap=first) == "1" and s.get("b", snap=first) == "2"
    with pytest.raises(NotFound):
        s.get("b")
    tx = s.begin()
    tx.put("c", "9")
    tx.rollback()
    with pytest.raises(RuntimeError):
        tx.commit()
    tx = s.begin()
    tx.put("c", "4")
    tx.delete("a")
    tx.commit()
    assert keys(s.scan_prefix("", 10)) == ["c"]
    with pytest.raises(ValueError):
        s.scan_prefix("", 0)
    s.compact("archive")
    assert s.versions().count() == 1 and s.get("a", snap=first) == "1"
    with pytest.raises(Lost):
        s.files.create("_commits/000000000001", "")
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "db"), read_only=True).put("x", "y")


def test_two_writers_of_one_number(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    a.put("k", "0")
    seen = []
    b.probes.append(lambda kind, what: seen.append(kind))
    real, b.commits = b.commits, lambda: [1]  # b has read the commits before a writes again
    a.put("k", "a")
    create = b.files.create

    def late(name, text):
        b.commits = real
        create(name, text)

    b.files.create = late
    assert b.put("k", "b") == 3 and seen == ["lost", "commit"]
    assert a.get("k") == "b" and a.get("k", snap=f"{2:016x}" + "0" * 16) == "a" and a.pending() == []


def test_recovery_and_strict_opening(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.put("a", "1")
    s._write(s.versions())  # a writer that died before its marker
    with pytest.raises(NeedsRecovery):
        Store(spark, str(tmp_path / "db"), strict=True)
    assert len(s.recover()) == 1 and Store(spark, str(tmp_path / "db"), strict=True).get("a") == "1"


def test_automatic_compaction_and_events(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), compact_after=2)
    for i in range(4):
        s.put("a", str(i))
    assert [s.marker(n)["kind"] for n in s.commits()] == ["put", "put", "compact", "put", "put", "compact"]
    assert s.versions().count() == 4 and s.get("a", snap=f"{2:016x}" + "0" * 16) == "1"
    got = [(r["seq"], r["kind"], r["value"]) for r in s.events().orderBy("seq").collect()]
    assert got == [(1, "mutation", "0"), (2, "mutation", "1"), (3, "compaction", None), (4, "mutation", "2"), (5, "mutation", "3"), (6, "compaction", None)]
    assert s.publish(str(tmp_path / "feed")) == 6
    s.put("b", "x")
    assert s.publish(str(tmp_path / "feed")) == s.publish(str(tmp_path / "feed")) == 7
    told = spark.read.parquet(str(tmp_path / "feed/upto=*"))
    assert [r["value"] for r in feed.latest_state(told).orderBy("key").collect()] == ["3", "x"]


def test_archived_versions_are_exported_and_applied(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.put("a", "1")
    snap = s.freeze()
    s.put("a", "2")
    s.compact("archive")
    assert s.export(str(tmp_path / "snap"), snap)["rows"] == 1
    t = Store(spark, str(tmp_path / "other"))
    apply_snapshot(t, str(tmp_path / "snap"))
    assert t.get("a") == "1"


def test_requests_on_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.create_collection("t")
    cap = {"prefix": "t", "quota_bytes": 1 << 20, "quota_ops": 4}
    s.execute({"cap": cap, "ops": [{"ins": {"coll": "t", "doc": {"n": i, "x": "kept"}}} for i in range(3)]})
    nest = {"nest": {"depth": 1, "src": {"scan": {"coll": "t", "limit": 10, "proj": ["n"]}}, "then": {"cas": {"coll": "t", "ops": [{"op": 3, "f": "n", "v": 10}]}}}}
    s.execute({"cap": cap, "op": nest})
    assert sorted(r["value"] for r in s.view(coll="t").collect()) == [f'{{"n":{i},"x":"kept"}}' for i in (10, 11, 12)]
    assert s.execute({"cap": cap, "op": {"count": {"coll": "t", "limit": 9}}}).n() == 3 and len(s.commits()) == 3
    with pytest.raises(lot.Refused):
        s.execute({"cap": cap, "op": {"get": {"coll": "tx", "id": ID}}})
    ids_ = [s.insert("t", "{}", 5) for _ in range(3)]
    assert ids_ == sorted(ids_) and len(set(ids_)) == 3


def test_a_planner_forgets_the_request_before(spark, versioned):
    p = lot.Planner(spark, versioned, lambda c: "f" * 32)
    req = {"cap": CAP, "op": {"ins": {"coll": "t_x", "doc": {"k": 1}}}}
    assert p.run(req).writes.count() == p.run(req).writes.count() == 1
    assert p.run({"cap": CAP, "op": {"count": {"coll": "t_x", "limit": 5}}}).writes.count() == 0


def test_decoding_many_parts(spark):
    df = spark.createDataFrame([("a;1:", None, 7, "", "é", 2.5, "x" * 30), (None,) * 7], "a string, b string, c int, d string, e string, f double, g string")
    parts = integrity.decode_key(F.col("k"), 7)
    got = df.select(integrity.encode_key(df, df.columns).alias("k")).select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).collect()
    assert [tuple(r) for r in got] == [("a;1:", None, "7", "", "é", "2.5", "x" * 30), (None,) * 7]


def test_tables_with_keys(spark, tmp_path):
    t = SqlTable(Store(spark, str(tmp_path / "db")), "users", "id bigint, name string", key=["id"], not_null=["name"])
    t.create()
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, name string")
    assert t.insert(rows((1, "a"), (2, "b"))) == 2
    for bad in (rows((1, "again")), rows((3, None)), rows((4, "x"), (4, "y"))):
        with pytest.raises(Violation):
            t.insert(bad)
    assert t.replace(rows((2, "c"), (5, "e"))) == 2 and t.update(F.col("id") == 1, name=F.upper("name")) == 1 and t.delete(F.col("id") == 5) == 1
    assert sorted(map(tuple, t.rows().collect())) == [(1, "A"), (2, "c")] and t.integrity_check() == "ok"
    assert [tuple(r) for r in t.table_info().collect()] == [(0, "id", "bigint", True, True), (1, "name", "string", True, False)]


def test_uncommitted_folders_are_ignored(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.put("a", "1")
    s.versions().write.parquet(str(tmp_path / "db/data/000000000002"))
    assert s.versions().count() == 1


def test_collections_and_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.create_collection("users")
    with pytest.raises(ValueError):
        s.create_collection("users")
    with pytest.raises(ValueError):
        s.create_collection("a\x1fb")
    id = s.insert("users", '{"n":1}', 1_700_000_000_000_000_000)
    assert s.get(id, "users") == '{"n":1}' and s.collections() == ["users"]
    s.export(str(tmp_path / "snap"))
    assert open_snapshot(spark, str(tmp_path / "snap")).where("coll = 'users'").count() == 1
    spark.createDataFrame([("users", "x", "y", "0")], "coll string, key string, value string, ver string").write.mode("append").parquet(str(tmp_path / "snap/data"))
    with pytest.raises(Corrupt):
        open_snapshot(spark, str(tmp_path / "snap"))
    s.drop_collection("users")
    assert s.collections() == [] and s.view(coll="users").count() == 0


def test_journal(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.note("migrate", "7 to 9")
    s.put("a", "1")
    s.note("archive", "x")
    assert [tuple(r)[1:] for r in s.journal().collect()] == [("migrate", "7 to 9"), ("archive", "x")] and keys(s.view()) == ["a"]


def test_feed_stream_equals_batch(spark, tmp_path):
    rows = [(i, "mutation", i % 3, f"k{i % 7}", f"{i:04d}", i % 5 == 0, f"v{i}") for i in range(100)]
    log = spark.createDataFrame(rows, "seq bigint, kind string, shard int, key string, ver string, deleted boolean, value string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    log = log.select("seq", "ts", "kind", "shard", "key", "ver", "deleted", "value")
    for part in range(4):
        log.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    sink = feed.ReplicaSink(str(tmp_path / "replica"))
    feed.replicate(feed.read_stream(spark, str(tmp_path / "log"), files=1), sink, str(tmp_path / "ck")).awaitTermination()
    sink(log.limit(10), 0)  # delivered again
    feed.replicate(feed.read_stream(spark, str(tmp_path / "log"), files=1), sink, str(tmp_path / "ck2")).awaitTermination()
    assert sorted(map(tuple, sink.state(spark).collect())) == sorted(map(tuple, feed.latest_state(log).select("key", "ver", "deleted", "value").collect()))


def test_windows_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i * 600, f"k{i % 2}", f"{i // 2}") for i in range(12)], "s bigint, key string, ver string").select(F.timestamp_seconds("s").alias("ts"), "key", "ver")
    df.write.parquet(str(tmp_path / "in"))
    out = feed.tumbling(feed.read_stream(spark, str(tmp_path / "in"), "ts timestamp, key string, ver string"), "1 hour", "10 minutes")
    out.writeStream.format("memory").queryName("vellum_tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("vellum_tumbling").collect()) == [6, 6]
