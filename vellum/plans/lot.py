"""A small document language: a JSON request of one or more operations, planned as DataFrames.

A request is ``{cap: {prefix, quota_bytes, quota_ops}, as_of?, op | ops}``; an operation holds
one verb of get, gets, scan, count, ins, cas, del, join, group, nest. It is validated on the
driver and planned over collections of (id, doc, ver?, deleted?). Reads see one snapshot; writes
are staged and returned as one frame, so a request is applied whole or not at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids, json_ops
from vellum.operators import mvcc

VERBS = ("get", "gets", "scan", "count", "ins", "cas", "del", "join", "group", "nest")
MAX_FIELDS, MAX_DOC, MAX_DEPTH = 64, 4096, 4
#: From this limit on groups are counted before they are sorted for it.
MANY_GROUPS = 100_000
_HEX = re.compile("[0-9a-f]{32}")
_ROW = "pos bigint, doc string, id string, hash string"


class Refused(ValueError):
    """The request is malformed or not allowed; ``kind`` says how."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class Missing(LookupError):
    """A document that a get names does not exist."""


class Conflict(RuntimeError):
    """A cas or del expected another state."""


_KEYS = {
    "get": {"coll", "id"},
    "gets": {"coll", "ids", "limit", "proj"},
    "scan": {"coll", "limit", "proj", "filter", "kind", "coll_id", "from_id", "to_id"},
    "count": {"coll", "limit", "from_id", "to_id"},
    "ins": {"coll", "doc"},
    "cas": {"coll", "id", "expect", "doc", "ops"},
    "del": {"coll", "id", "expect"},
    "join": {"on", "left_max", "right_max", "left", "right"},
    "right": {"coll", "from_left", "limit", "proj"},
    "group": {"by", "limit", "sum", "src"},
    "nest": {"depth", "src", "then"},
}


def _known(verb: str, body: Any) -> dict:
    if not isinstance(body, dict):
        raise Refused("op", f"{verb} is no object")
    if extra := set(body) - _KEYS[verb]:
        raise Refused("op", f"{verb} has {sorted(extra)}")
    return body


def _id(text: Any, optional: bool = False) -> None:
    if optional and text in (None, ""):
        return
    if not isinstance(text, str) or not _HEX.fullmatch(text):
        raise Refused("id", repr(text))


def _positive(body: dict, name: str, kind: str) -> int:
    n = body.get(name)
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise Refused(kind, name)
    return n


@dataclass
class Lot:
    """A validated request."""

    cap: dict
    ops: list[dict]
    as_of: str | None = None

    def allow(self, coll: Any) -> None:
        if not isinstance(coll, str) or not coll.startswith(self.cap["prefix"]):
            raise Refused("capability", repr(coll))

    def check_scan(self, body: Any) -> None:
        s = _known("scan", body)
        limit = _positive(s, "limit", "limit")
        proj = s.get("proj")
        if not isinstance(proj, list) or not 1 <= len(proj) <= MAX_FIELDS or not all(isinstance(p, str) for p in proj):
            raise Refused("projection")
        self.allow(s.get("coll"))
        if limit * MAX_DOC > self.cap["quota_bytes"]:
            raise Refused("quota", "limit times document size")
        _id(s.get("from_id"), True)
        _id(s.get("to_id"), True)

    def check(self, op: Any, depth: int = 0, nested: bool = False) -> None:
        if not isinstance(op, dict) or len(op) != 1 or next(iter(op)) not in VERBS:
            raise Refused("op", "one verb an operation")
        verb, body = next(iter(op.items()))
        b = _known(verb, body)
        if verb in ("get", "gets", "count", "ins", "cas", "del"):
            self.allow(b.get("coll"))
        if verb in ("get", "del"):
            _id(b.get("id"))
        elif verb == "gets":
            if len(b.get("ids") or []) > _positive(b, "limit", "limit"):
                raise Refused("quota", "more ids than limit")
            for i in b.get("ids") or []:
                _id(i)
        elif verb == "scan":
            self.check_scan(b)
        elif verb == "count":
            _positive(b, "limit", "limit")
            _id(b.get("from_id"), True)
            _id(b.get("to_id"), True)
        elif verb == "ins":
            if b.get("doc") is None:
                raise Refused("op", "ins without doc")
        elif verb == "cas":
            _id(b.get("id"), nested)
        elif verb == "join":
            if not b.get("on"):
                raise Refused("join", "on")
            _positive(b, "left_max", "join")
            _positive(b, "right_max", "join")
            if b.get("left") is None:
                raise Refused("limit", "left")
            self.check_scan(b["left"])
            if b.get("right") is not None:
                self.allow(_known("right", b["right"]).get("coll"))
        elif verb == "group":
            _positive(b, "limit", "limit")
            if b.get("src") is not None:
                self.check_scan(b["src"])
            elif not nested:
                raise Refused("limit", "src")
        elif verb == "nest":
            n = b.get("depth")
            if not isinstance(n, int) or not 1 <= n <= MAX_DEPTH or depth + 1 > MAX_DEPTH:
                raise Refused("depth")
            if b.get("src") is None or b.get("then") is None:
                raise Refused("op", "nest")
            self.check(b["src"], depth + 1, True)
            self.check(b["then"], depth + 1, True)


def validate(raw: str | bytes | dict) -> Lot:
    """The request, or Refused."""
    try:
        req = json.loads(raw) if isinstance(raw, (str, bytes)) else raw
    except ValueError:
        raise Refused("op", "no JSON") from None
    if not isinstance(req, dict) or set(req) - {"cap", "as_of", "op", "ops"}:
        raise Refused("op", "envelope")
    cap = req.get("cap")
    if not isinstance(cap, dict) or not cap.get("prefix") or not all(isinstance(cap.get(k), int) and cap[k] > 0 for k in ("quota_bytes", "quota_ops")):
        raise Refused("capability", "cap")
    ops = req["ops"] if req.get("ops") else [req["op"]] if req.get("op") else []
    if not ops:
        raise Refused("op", "no operation")
    if len(ops) > cap["quota_ops"]:
        raise Refused("quota", "operations")
    if req.get("as_of") is not None:
        _id(req["as_of"])
    lot = Lot(cap, ops, req.get("as_of"))
    for op in ops:
        lot.check(op)
    return lot


@dataclass
class Result:
    """docs: (op, pos, doc, id, hash); n and next_from as values; writes: (coll, id, doc, deleted)."""

    docs: DataFrame
    writes: DataFrame
    counts: list[DataFrame] = field(default_factory=list)
    pages: list[DataFrame] = field(default_factory=list)
    writes_any: bool = False

    def n(self) -> int:
        """The sum of what the operations count, or else the number of documents."""
        return sum(c.first()[0] for c in self.counts) or self.docs.count()

    def next_from(self) -> str:
        """The id that the last unfinished scan goes on from, or ''."""
        for p in reversed(self.pages):
            if row := p.first():
                return row[0]
        return ""


def in_range(df: DataFrame, spec: Mapping) -> DataFrame:
    """from_id <= id < to_id, and the kind and collection byte of the id, where given."""
    if spec.get("from_id"):
        df = df.where(F.col("id") >= spec["from_id"])
    if spec.get("to_id"):
        df = df.where(F.col("id") < spec["to_id"])
    if spec.get("kind") is not None:
        df = df.where(ids.kind_of("id") == spec["kind"])
    if spec.get("coll_id") is not None:
        df = df.where(ids.coll_of("id") == spec["coll_id"])
    return df


def scan(docs: DataFrame, spec: Mapping, whole: bool = False) -> DataFrame:
    """The first ``limit`` matching documents by id; ``whole`` leaves the projection out."""
    out = in_range(docs, spec).where(json_ops.filter_column("doc", spec.get("filter"))).orderBy("id").limit(spec["limit"])
    return out.select("id", (F.col("doc") if whole else json_ops.project("doc", spec.get("proj") or [])).alias("doc"))


def next_page(docs: DataFrame, spec: Mapping) -> DataFrame:
    """(next_from): the id after the page; no row if the page is the last."""
    hits = in_range(docs, spec).where(json_ops.filter_column("doc", spec.get("filter")))
    return hits.orderBy("id").offset(spec["limit"]).limit(1).select(F.col("id").alias("next_from"))


def count(docs: DataFrame, spec: Mapping) -> DataFrame:
    """(n): documents in the range, at most ``limit``."""
    return in_range(docs, spec).agg(F.least(F.count("*"), F.lit(spec["limit"])).alias("n"))


def gets(docs: DataFrame, wanted: list[str], proj: list[str] | None = None) -> DataFrame:
    """(pos, id, doc): documents in the order asked for; the request is small and is sent to the scan."""
    spark = docs.sparkSession
    req = spark.createDataFrame(list(enumerate(wanted)), "pos bigint, id string")
    hit = docs.where(F.col("id").isin(list(dict.fromkeys(wanted)))).join(F.broadcast(req), "id")
    return hit.select("pos", "id", json_ops.project("doc", proj or []).alias("doc"))


def lookup_join(left: DataFrame, right: DataFrame, spec: Mapping) -> DataFrame:
    """(pos, id, doc): for each left document, by id, the right one whose id its field holds.

    At most left_max left documents and right_max results; left ones without a match are left out.
    """
    right_spec = spec.get("right") or {}
    name = right_spec.get("from_left") or spec["on"]
    l = scan(left, {**spec["left"], "limit": min(spec["left"]["limit"], spec["left_max"])}, whole=True)
    l = l.select(F.col("id").alias("left_id"), json_ops.field("doc", name).alias("id"))
    hit = l.join(right, "id").orderBy("left_id").limit(spec["right_max"])
    return hit.select("left_id", "id", json_ops.project("doc", right_spec.get("proj") or []).alias("doc"))


def group(docs: DataFrame, spec: Mapping) -> DataFrame:
    """(k, n, s): count and unsigned sum by the first field, groups in the order first seen."""
    by = (spec.get("by") or [""])[0]
    k = json_ops.field("doc", by) if by else F.lit("")
    s = json_ops.u64(json_ops.field("doc", spec["sum"])) if spec.get("sum") else F.lit(0).cast("decimal(20,0)")
    g = docs.groupBy(k.alias("k")).agg(F.count("*").alias("n"), json_ops.wrap_u64(F.sum(s)).alias("s"), F.min("id").alias("seen"))
    if spec["limit"] < MANY_GROUPS:  # a larger one is no top-k: one task would take all groups
        g = g.orderBy("seen").limit(spec["limit"])
    else:
        g = g.orderBy("seen").offset(0).limit(spec["limit"]) if g.limit(spec["limit"] + 1).count() > spec["limit"] else g
    return g.select("k", "n", "s", "seen")


def compare_and_set(docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, refused) for (id, expect, doc) requests; applied has id, doc and the old document.

    expect is the digest of the current document, '' for an absent one. A null doc deletes.
    """
    j = requests.join(docs.select("id", F.col("doc").alias("old")), "id", "left")
    ok = F.coalesce(ids.doc_hash("old"), F.lit("")) == F.col("expect")
    return j.where(ok).select("id", "doc", "old"), j.where(~ok).select("id", "expect", "old")


def touched_shards(writes: DataFrame) -> DataFrame:
    """(shard): the shards that a request's writes fall in."""
    return writes.select(ids.route("id").alias("shard")).distinct()


class Planner:
    """Plans a validated request over collections.

    ``collections`` maps a name to (id, doc) or, with versions, (id, doc, ver, deleted). New ids
    come from ``new_id``, so that tests can fix them.
    """

    def __init__(self, spark: SparkSession, collections: Mapping[str, DataFrame], new_id: Callable[[str], str]):
        self.spark, self.collections, self.new_id = spark, collections, new_id
        self._begin(None)

    def _begin(self, as_of: str | None) -> None:
        """Forget the request before."""
        self.as_of = as_of
        self.staged: dict[tuple[str, str], tuple[str | None, bool]] = {}  # (coll, id) -> doc, deleted
        self.bulk: dict[str, list[DataFrame]] = {}  # coll -> (id, doc) of nested operations
        self.counts: list[DataFrame] = []
        self.pages: list[DataFrame] = []

    def docs(self, name: str) -> DataFrame:
        """(id, doc) of a collection, with what the request has written so far."""
        if name not in self.collections:
            raise Refused("collection", name)
        df = self._stored(self.collections[name], name)
        for new in self.bulk.get(name, []):
            df = df.join(new.select("id"), "id", "left_anti").unionByName(new)
        own = [(i, d, gone) for (c, i), (d, gone) in self.staged.items() if c == name]
        if own:  # a few rows of the request
            new = self.spark.createDataFrame(own, "id string, doc string, gone boolean")
            df = df.join(F.broadcast(new.select("id")), "id", "left_anti").unionByName(new.where("not gone").select("id", "doc"))
        return df

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        if "ver" in df.columns:
            v = df.select(F.col("id").alias("key"), "ver", "deleted", F.col("doc").alias("value"))
            live = mvcc.as_of(v, self.as_of) if self.as_of else mvcc.latest(v)
            return live.select(F.col("key").alias("id"), F.col("value").alias("doc"))
        if self.as_of:
            raise Refused("as_of", f"{name} keeps no versions")
        return df.select("id", "doc")

    def run(self, raw: str | bytes | dict) -> Result:
        lot = validate(raw)
        self._begin(lot.as_of)
        parts = [self._op(op, None).withColumn("op", F.lit(i)) for i, op in enumerate(lot.ops)]
        docs = parts[0]
        for p in parts[1:]:
            docs = docs.unionByName(p)
        writes = self.spark.createDataFrame([(c, i, d, gone) for (c, i), (d, gone) in self.staged.items()], "coll string, id string, doc string, deleted boolean")
        for coll, parts in self.bulk.items():
            for b in parts:
                writes = writes.unionByName(b.select(F.lit(coll).alias("coll"), "id", "doc", F.lit(False).alias("deleted")))
        return Result(docs.select("op", "pos", "doc", "id", F.coalesce("hash", F.when(F.col("id") != "", ids.doc_hash("doc"))).alias("hash")), writes, self.counts, self.pages, bool(self.staged or self.bulk))

    def _frame(self, df: DataFrame, pos: str) -> DataFrame:
        return df.select(F.col(pos).cast("bigint").alias("pos"), "doc", "id", F.lit(None).cast("string").alias("hash"))

    def _positioned(self, df: DataFrame, by: str) -> DataFrame:
        """pos by an order; the frame is a limited page."""
        from pyspark.sql import Window

        return df.withColumn("pos", F.row_number().over(Window.orderBy(by)) - 1)

    def _current(self, coll: str, id: str) -> str | None:
        row = self.docs(coll).where(F.col("id") == id).select("doc").take(1)
        return row[0][0] if row else None

    def _op(self, op: dict, parent: DataFrame | None) -> DataFrame:
        (verb, b), = op.items()
        return getattr(self, f"_{verb}")(b, parent)

    def _get(self, b: dict, parent) -> DataFrame:
        doc = self._current(b["coll"], b["id"])
        if doc is None:
            raise Missing(b["id"])
        return self.spark.createDataFrame([(0, doc, b["id"], None)], _ROW)

    def _gets(self, b: dict, parent) -> DataFrame:
        out = gets(self.docs(b["coll"]), b.get("ids") or [], b.get("proj"))
        if out.count() != len(b.get("ids") or []):
            raise Missing("gets")
        return self._frame(out, "pos")

    def _scan(self, b: dict, parent) -> DataFrame:
        docs = self.docs(b["coll"])
        self.pages.append(next_page(docs, b))
        return self._frame(self._positioned(scan(docs, b), "id"), "pos")

    def _count(self, b: dict, parent) -> DataFrame:
        self.counts.append(count(self.docs(b["coll"]), b))
        return self.spark.createDataFrame([], _ROW)

    def _ins(self, b: dict, parent) -> DataFrame:
        doc, id = json.dumps(b["doc"], separators=(",", ":"), ensure_ascii=False), self.new_id(b["coll"])
        self.staged[b["coll"], id] = doc, False
        return self.spark.createDataFrame([(0, None, id, doc)], _ROW).withColumn("hash", F.sha2("hash", 256))

    def _cas(self, b: dict, parent) -> DataFrame:
        if parent is not None:
            return self._cas_each(b, parent)
        old = self._current(b["coll"], b["id"])
        req = self.spark.createDataFrame([(b["id"], b.get("expect") or "", old)], "id string, expect string, old string")
        ok = F.coalesce(ids.doc_hash("old"), F.lit("")) == F.col("expect")
        new = json_ops.mutate(F.coalesce("old", F.lit("{}")), b["ops"]) if b.get("ops") else F.lit(json.dumps(b.get("doc"), separators=(",", ":"), ensure_ascii=False))
        row = req.select(ok.alias("ok"), new.alias("doc")).first()
        if not row["ok"]:
            raise Conflict(b["id"])
        self.staged[b["coll"], b["id"]] = row["doc"], False
        self._settle(b["coll"], b["id"])
        return self.spark.createDataFrame([(0, row["doc"], b["id"], None)], _ROW)

    def _settle(self, coll: str, id: str) -> None:
        """A later single write replaces what a nested one wrote to the same document."""
        self.bulk[coll] = [d.where(F.col("id") != id) for d in self.bulk.get(coll, [])] if self.bulk.get(coll) else []
        if not self.bulk[coll]:
            del self.bulk[coll]

    def _cas_each(self, b: dict, parent: DataFrame) -> DataFrame:
        """Write to the current document of each id of the source, whatever the source projects.

        Each document must still be the one that the source read: one that this request has
        changed since, or that the collection lacks, is a Conflict.
        """
        current = self.docs(b["coll"]).select("id", F.col("doc").alias("old"))
        whole = parent.columns and "whole" in parent.columns
        read = parent.select("pos", "id", (F.col("whole") if whole else F.col("doc")).alias("read"))
        j = read.join(current, "id", "left")
        if row := j.where(F.col("old").isNull() | (ids.doc_hash("old") != ids.doc_hash("read"))).select("id").take(1):
            raise Conflict(row[0][0])
        new = json_ops.mutate("old", b["ops"]) if b.get("ops") else F.lit(json.dumps(b.get("doc"), separators=(",", ":"), ensure_ascii=False))
        done = j.select("pos", new.alias("doc"), "id")
        ids_here = [d for d in self.bulk.get(b["coll"], [])]
        self.bulk[b["coll"]] = [d.join(done.select("id"), "id", "left_anti") for d in ids_here] + [done.select("id", "doc")]
        return self._frame(done, "pos")

    def _del(self, b: dict, parent) -> DataFrame:
        old = self._current(b["coll"], b["id"])
        if (self.spark.createDataFrame([(old,)], "d string").select(F.coalesce(ids.doc_hash("d"), F.lit(""))).first()[0]) != (b.get("expect") or ""):
            raise Conflict(b["id"])
        self.staged[b["coll"], b["id"]] = None, True
        self._settle(b["coll"], b["id"])
        return self.spark.createDataFrame([], _ROW)

    def _join(self, b: dict, parent) -> DataFrame:
        right = b.get("right") or {}
        out = lookup_join(self.docs(b["left"]["coll"]), self.docs(right.get("coll") or b["left"]["coll"]), b)
        return self._frame(self._positioned(out, "left_id"), "pos")

    def _group(self, b: dict, parent) -> DataFrame:
        src = parent if b.get("src") is None else scan(self.docs(b["src"]["coll"]), b["src"], whole=True)
        g = self._positioned(group(src, b), "seen")
        doc = F.to_json(F.struct(F.col("k"), F.col("n"), F.col("s")))
        return g.select(F.col("pos").cast("bigint").alias("pos"), doc.alias("doc"), F.lit("").alias("id")).withColumn("hash", F.lit(None).cast("string"))

    def _nest(self, b: dict, parent) -> DataFrame:
        (verb, spec), = b["src"].items()
        if verb == "scan" and "cas" in b["then"]:  # a cas writes to whole documents and compares them
            page = self._positioned(scan(self.docs(spec["coll"]), spec, whole=True), "id")
            src = page.select(F.col("pos").cast("bigint").alias("pos"), "doc", "id", F.col("doc").alias("whole"))
        else:
            src = self._op(b["src"], parent).select("pos", "doc", "id")
        return self._op(b["then"], src)
