"""A database of versioned entries on any file system Spark writes to.

A commit writes its rows to a folder that no other writer knows, and then its marker: a small
file with the commit's number, made with create-if-absent, that names the folder. Of two writers
of one number the later one loses and takes the next; readers see only folders that a marker
names. A version id is the commit number, so ids follow commit order and not clocks. The folders
of the commits are the change log.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import ids
from vellum.operators import mvcc
from vellum.operators.query import NotFound, Query

#: part is a letter and 16 digits of the digest of the collection's name: a folder each.
SCHEMA = "coll string, key string, deleted boolean, value string, value_len int, shard smallint, ver string"
_FILES = SCHEMA + ", commit string, part string"
_WRITES = "coll string, key string, deleted boolean, value string"
#: Commits that rewrite what is there.
REWRITES = ("compact", "prune", "archive")
LARGE = 2048
#: Nanoseconds that an id can tell apart.
_TICK = 245


class Lost(RuntimeError):
    """Another writer took the commit number."""


class NeedsRecovery(RuntimeError):
    """There are folders that no commit names."""


class Files:
    """The few file-system calls that commits need, through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, name: str, text: str) -> None:
        """A new file; Lost if it exists."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Lost(name) from None
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        src = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
        finally:
            src.close()

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} to {new}")


class Store:
    """Entries (coll, key) -> value with all their versions.

    ``strict`` refuses to open over folders that no commit names, what a writer that died leaves;
    recover() deletes them. With ``compact_after`` a commit that makes so many since the last
    compaction is followed by one that keeps all versions.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, strict: bool = False, compact_after: int | None = None):
        self.spark, self.root, self.read_only, self.compact_after = spark, root.rstrip("/"), read_only, compact_after
        self.files = Files(spark, root)
        self.markers: dict[int, dict] = {}
        self.last_ns = 0
        self.probes: list[Callable[[str, dict], None]] = []
        if strict and self.pending():
            raise NeedsRecovery(self.pending()[0])

    def probe(self, event: str, **what) -> None:
        """Tell the observers in ``probes`` what happens."""
        for observer in self.probes:
            observer(event, what)

    # commits

    def commits(self) -> list[int]:
        return [int(n) for n in self.files.names("_commits")]

    def marker(self, n: int) -> dict:
        """What a commit's marker says; markers never change."""
        if n not in self.markers:
            self.markers[n] = json.loads(self.files.read(f"_commits/{n:012d}"))
        return self.markers[n]

    def pending(self) -> list[str]:
        """Folders that no commit names: of writers at work, or that died."""
        named = {self.marker(n)["data"] for n in self.commits()}
        return [f for f in self.files.names("data") if f not in named]

    def recover(self) -> list[str]:
        """Delete the folders that no commit names. Only while nobody else writes."""
        gone = self.pending()
        for f in gone:
            self.files.delete(f"data/{f}")
        return gone

    def _read(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{self.marker(n)['data']}" for n in numbers])

    def versions(self, coll: str | None = None) -> DataFrame:
        """All committed versions, of one collection if named: a collection is a folder of each commit."""
        done = self.commits()
        base = self.marker(done[-1])["base"] if done else 0
        df = self._read([n for n in done if n >= base])
        if coll is not None:
            df = df.where((F.col("part") == f"c{hashlib.sha256(coll.encode()).hexdigest()[:16]}") & (F.col("coll") == coll))
        return df.drop("commit", "part")

    def history(self) -> DataFrame:
        """Versions that archiving moved away."""
        names = self.files.names("history")
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/history/{n}" for n in names]) if names else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> str:
        folder = f"commit=c{uuid.uuid4().hex}"
        # collection and shard of a key together, large ones split and small ones merged; sorted by
        # key within files, so that key ranges prune row groups
        rows.withColumn("part", F.concat(F.lit("c"), F.substring(F.sha2("coll", 256), 1, 16))).hint("rebalance", "part", "shard").sortWithinPartitions("part", "key", "ver").write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        return folder

    def append(self, writes: DataFrame, kind: str = "put", versioned: bool = False, base: int | None = None, at: int | None = None) -> int:
        """Commit (coll, key, deleted, value) rows at once; returns the commit number.

        A key that occurs twice keeps one of its rows, the last by value; give each key once. A
        writer that loses its number takes the next, unless ``at`` names the only one that will
        do: then it raises Lost, and nothing is written.
        """
        if self.read_only:
            raise PermissionError("read only")
        done = self.commits()
        n = at or (done[-1] + 1 if done else 1)
        ver = lambda k: F.lit(f"{k:016x}" + "0" * 16)
        if not versioned:
            last = writes.groupBy("coll", "key").agg(F.max_by(F.struct("deleted", "value"), F.struct("deleted", "value")).alias("w"))
            writes = last.select("coll", "key", "w.*").withColumn("ver", ver(n))
        rows = writes.select("coll", "key", "deleted", "value", F.octet_length("value").alias("value_len"), ids.route("key").cast("smallint").alias("shard"), "ver")
        folder = self._write(rows)
        while True:
            old_base = self.marker(n - 1)["base"] if n > 1 else 0
            text = {"kind": kind, "base": old_base if base is None else n, "data": folder, "ms": time.time_ns() // 1_000_000}
            try:
                self.files.create(f"_commits/{n:012d}", json.dumps(text))
                break
            except Lost:
                self.probe("lost", n=n)
                if at or kind in REWRITES:  # what it was made from is no longer the state
                    self.files.delete(f"data/{folder}")
                    raise
                n = self.commits()[-1] + 1
                stale = self.spark.read.schema(_FILES).option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/{folder}")
                again = self._write(stale.drop("commit", "part").withColumn("ver", ver(n)))
                self.files.delete(f"data/{folder}")
                folder = again
        self.probe("commit", n=n, kind=kind)
        if self.compact_after and kind not in REWRITES and n - old_base >= self.compact_after:
            try:
                self.compact("keep_all")
            except Lost:  # another writer was faster; the next commit tries again
                pass
        return n

    # entries

    def put(self, key: str, value: str, coll: str = "") -> int:
        return self.put_batch([(key, value)], coll)

    def put_batch(self, rows: Iterable[tuple[str, str]], coll: str = "") -> int:
        rows = list(dict(rows).items())
        if any(not k or len(k.encode()) > 65535 for k, _ in rows):
            raise ValueError("keys are 1 to 65535 bytes")
        return self.append(self.spark.createDataFrame([(coll, k, False, v) for k, v in rows], _WRITES))

    def put_rows(self, rows: DataFrame, coll: str = "") -> int:
        """One commit for (key, value) rows, however many; keys are unique and 1 to 65,535 bytes."""
        bad = F.assert_true(F.octet_length("key").between(1, 65535), "keys are 1 to 65535 bytes")
        return self.append(rows.where(F.coalesce(bad.cast("string"), F.lit("")) == "").select(F.lit(coll).alias("coll"), "key", F.lit(False).alias("deleted"), "value"))

    def delete_rows(self, keys: DataFrame, coll: str = "") -> int:
        """One commit that deletes the (key) rows."""
        return self.append(keys.select(F.lit(coll).alias("coll"), "key", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value")), "delete")

    def put_batch_atomic(self, rows: DataFrame, coll: str = "") -> int:
        """One commit for (key, value) rows of one shard; refuses more, as a single writer would."""
        if rows.select(ids.route("key")).distinct().limit(2).count() > 1:
            raise ValueError("more than one shard")
        return self.append(rows.select(F.lit(coll).alias("coll"), "key", F.lit(False).alias("deleted"), "value"))

    def delete(self, *keys: str, coll: str = "") -> int:
        return self.append(self.spark.createDataFrame([(coll, k, True, None) for k in dict.fromkeys(keys)], _WRITES), "delete")

    def view(self, snap: str | None = None, coll: str = "") -> DataFrame:
        """The live entries of a collection, now or at a snapshot, archived versions included."""
        v = self.versions(coll)
        if snap is None:
            return mvcc.latest(v)
        return mvcc.as_of(v, snap, self.history().where(F.col("coll") == coll))

    def get(self, key: str, coll: str = "", snap: str | None = None) -> str:
        v = self.versions(coll).where(F.col("key") == key)
        if snap is not None:
            v = mvcc.merge_history(v, self.history().where((F.col("coll") == coll) & (F.col("key") == key))).where(F.col("ver") <= snap)
        rows = mvcc.latest(v).select("value").take(1)
        if not rows:
            raise NotFound(key)
        return rows[0][0]

    def query(self, coll: str = "", snap: str | None = None) -> Query:
        return Query(self.view(snap, coll))

    def scan_prefix(self, prefix: str, limit: int, coll: str = "") -> DataFrame:
        if limit <= 0:
            raise ValueError("a limit is needed")
        return self.query(coll).prefix(prefix).limit(limit).keys()

    def freeze(self) -> str:
        """The id of the last commit: a consistent snapshot."""
        done = self.commits()
        return (f"{done[-1]:016x}" if done else "0" * 16) + "0" * 16

    # collections and documents

    def create_collection(self, name: str) -> int:
        if not name or "\x1f" in name or "\0" in name:
            raise ValueError("bad name")
        if name in self.collections():
            raise ValueError("exists")
        return self.append(self.spark.createDataFrame([("\0C", name, False, "")], _WRITES), "create")

    def collections(self) -> list[str]:
        return [r[0] for r in mvcc.latest(self.versions("\0C")).select("key").orderBy("key").collect()]

    def drop_collection(self, name: str) -> int:
        rows = self.view(coll=name).select("coll", "key").unionByName(self.spark.createDataFrame([("\0C", name)], "coll string, key string"))
        return self.append(rows.select("coll", "key", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value")), "drop")

    def _next_ns(self, ts_ns: int, n: int = 1) -> int:
        """The first of ``n`` times from ``ts_ns`` on, later than all that this store gave before."""
        begin = max(ts_ns, self.last_ns + _TICK)
        self.last_ns = begin + (n - 1) * _TICK
        return begin

    def insert(self, coll: str, doc: str, ts_ns: int) -> str:
        """A document under a new version-7 id; ids of one store object increase."""
        if coll not in self.collections():
            raise NotFound(coll)
        id = ids.compose_text(self._next_ns(ts_ns), ids.PUT, coll, uuid.uuid4().int & (2**40 - 1))
        self.put(id, doc, coll)
        return id

    def insert_rows(self, coll: str, docs: DataFrame, ts_ns: int) -> int:
        """One commit for (doc) rows under new ids of one time, told apart by partition and row number."""
        if coll not in self.collections():
            raise NotFound(coll)
        at = F.monotonically_increasing_id()
        counter = F.shiftleft(F.shiftright(at, 33), 27).bitwiseOR(at.bitwiseAND(F.lit(2**27 - 1)))
        bits = ids.payload(F.lit(ids.PUT), ids.coll_byte(F.lit(coll)), ids.route(F.lit(coll)), counter)
        return self.put_rows(docs.select(ids.compose(F.lit(self._next_ns(ts_ns)), bits).alias("key"), F.col("doc").alias("value")), coll)

    # requests of the document language

    def execute(self, request: str | bytes | dict, new_id: Callable[[str], str] | None = None, tries: int = 5):
        """Run a request on the collections at one commit and commit its writes as the next.

        If another writer is faster the request runs again on the new state. Refusals and
        conflicts are raised, and nothing is written then.
        """
        from vellum.plans.lot import Planner

        fresh = new_id or (lambda coll: ids.compose_text(self._next_ns(time.time_ns()), ids.PUT, coll, uuid.uuid4().int & (2**40 - 1)))
        for _ in range(tries):
            done = self.commits()
            n = (done[-1] if done else 0) + 1
            result = Planner(self.spark, Documents(self), fresh).run(request)
            if not result.writes_any:
                return result
            try:
                self.append(result.writes.select("coll", F.col("id").alias("key"), "deleted", F.col("doc").alias("value")), "lot", at=n)
                return result
            except Lost:
                continue
        raise Lost(f"{tries} times")

    # the change log

    def events(self, after: int = 0) -> DataFrame:
        """(seq, ts, kind, shard, key, ver, deleted, value, coll) of the commits after a number, in the feed's form.

        seq is the commit's number; a rewrite is one event without a key. Pass the largest seq
        read so far to go on from there.
        """
        done = [n for n in self.commits() if n > after]
        kinds = self.spark.createDataFrame([(self.marker(n)["data"].split("=")[1], n, self.marker(n)["kind"], self.marker(n)["ms"]) for n in done], "commit string, seq bigint, did string, ms bigint")
        rows = self._read([n for n in done if self.marker(n)["kind"] not in REWRITES]).join(F.broadcast(kinds), "commit")  # a row a commit
        told = rows.select("seq", F.timestamp_millis("ms").alias("ts"), F.lit("mutation").alias("kind"), F.col("shard").cast("int").alias("shard"), "key", "ver", "deleted", "value", "coll")
        none = lambda t: F.lit(None).cast(t)
        did = F.when(F.col("did") == "compact", "compaction").otherwise(F.col("did"))
        rewrites = kinds.where(F.col("did").isin(*REWRITES)).select("seq", F.timestamp_millis("ms").alias("ts"), did.alias("kind"), none("int").alias("shard"), none("string").alias("key"), F.format_string("%016x%016x", "seq", F.lit(0)).alias("ver"), none("boolean").alias("deleted"), none("string").alias("value"), none("string").alias("coll"))
        return told.unionByName(rewrites)

    def publish(self, path: str) -> int:
        """Append the events since the last call to a feed folder, a file set of its own; returns the last seq there.

        A call that died half-way is repeated whole: its folder is named by where it began.
        """
        feed, done = Files(self.spark, path), self.commits()
        shipped = [int(x.split("=")[1]) for x in feed.names("") if x.startswith("upto=")]
        last, now = max(shipped, default=0), done[-1] if done else 0
        if now > last:
            self.events(last).where(F.col("seq") <= now).write.mode("overwrite").parquet(f"{path}/.writing-{last}")
            feed.rename(f".writing-{last}", f"upto={now}")
        return now

    # audit

    def note(self, kind: str, ref: str) -> int:
        """Append to the journal of what was done to the store itself."""
        return self.append(self.spark.createDataFrame([("\0A", f"{len(self.commits()):012d}", False, json.dumps({"kind": kind, "ref": ref}))], _WRITES), "note")

    def journal(self) -> DataFrame:
        """(n, kind, ref) in order of the notes."""
        v = mvcc.latest(self.versions("\0A"))
        return v.select(F.col("key").alias("n"), F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.ref").alias("ref")).orderBy("n")

    # transactions

    def begin(self) -> Transaction:
        return Transaction(self)

    # retention

    def compact(self, policy: str = "prune") -> int:
        """Rewrite what is kept as one commit, which later readers start from.

        keep_all keeps all versions, prune the live ones, archive moves the others to history.
        A commit in between makes it Lost, and nothing changes.
        """
        done = self.commits()
        n = (done[-1] if done else 0) + 1
        every = self.versions()
        keyed = every.withColumns({"key": F.concat_ws("\x1f", "coll", "key")})
        hot, cold = mvcc.retain(keyed, policy)
        plain = lambda df: df.withColumn("key", F.expr("substring(key, length(coll) + 2)"))
        kind = {"keep_all": "compact"}.get(policy, policy)
        if policy == "archive":  # before the commit: a version may be in both places, never in neither
            plain(cold).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{self.root}/history/{uuid.uuid4().hex}")
        return self.append(plain(hot).select("coll", "key", "deleted", "value", "ver"), kind, versioned=True, base=-1, at=n)

    # snapshots

    def export(self, path: str, snap: str | None = None) -> dict:
        """Write the live entries at a snapshot, and a manifest of how many they are and their digest."""
        snap = snap or self.freeze()
        joined = lambda df: df.withColumn("key", F.concat_ws("\x1f", "coll", "key"))
        rows = mvcc.as_of(joined(self.versions()), snap, joined(self.history())).select("coll", F.expr("substring(key, length(coll) + 2)").alias("key"), "value", "ver")
        rows.write.parquet(f"{path}/data")
        manifest = {"snap": snap} | digest(self.spark.read.parquet(f"{path}/data"))
        Files(self.spark, path).create("manifest.json", json.dumps(manifest))
        return manifest


class Documents(Mapping):
    """The collections of a store as the planner takes them: (id, doc, ver, deleted), archived versions included."""

    def __init__(self, store: Store):
        self.store, self.names = store, store.collections()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        hot, cold = self.store.versions(name), self.store.history().where(F.col("coll") == name)
        return mvcc.merge_history(hot, cold).select(F.col("key").alias("id"), F.col("value").alias("doc"), "ver", "deleted")

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def digest(rows: DataFrame) -> dict:
    r = rows.agg(F.count("*"), F.sum(F.xxhash64("coll", "key", "value", "ver").cast("decimal(38,0)"))).first()
    return {"rows": r[0], "digest": str(r[1] or 0)}


class Corrupt(ValueError):
    """A snapshot does not agree with its manifest."""


def open_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a snapshot, after verification."""
    manifest = json.loads(Files(spark, path).read("manifest.json"))
    rows = spark.read.parquet(f"{path}/data")
    if digest(rows) != {k: manifest[k] for k in ("rows", "digest")}:
        raise Corrupt(path)
    return rows


def apply_snapshot(store: Store, path: str) -> int:
    """Verify a snapshot and commit its entries to a store."""
    rows = open_snapshot(store.spark, path)
    return store.append(rows.select("coll", "key", F.lit(False).alias("deleted"), "value"), "apply")


class Transaction:
    """Writes that are committed together or not at all."""

    def __init__(self, store: Store):
        self.store, self.writes, self.open = store, {}, True

    def put(self, key: str, value: str, coll: str = "") -> None:
        self._check()
        self.writes[coll, key] = (False, value)

    def delete(self, key: str, coll: str = "") -> None:
        self._check()
        self.writes[coll, key] = (True, None)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        """Commit at the end of a with block, roll back if it raised."""
        if self.open:
            self.rollback() if kind else self.commit()

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is over")

    def commit(self) -> int | None:
        self._check()
        self.open = False
        rows = [(c, k, d, v) for (c, k), (d, v) in self.writes.items()]
        return self.store.append(self.store.spark.createDataFrame(rows, _WRITES), "tx") if rows else None

    def rollback(self) -> None:
        self._check()
        self.open = False
