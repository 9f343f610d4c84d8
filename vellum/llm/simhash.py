"""SimHash near-duplicates: pigeonhole blocks find candidates, Hamming distance decides.

The pipeline's stage is about similarity 0.8 of five-word shingles, some 10 of 64 bits: too many
for pigeonhole blocks. There anchors find candidates and exact Jaccard decides.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import as_bytes, discard, documents, keyed, materialise, possibly_in, released, ship
from vellum.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints are cut into so many blocks; close pairs agree on all but DISTANCE of them.
BLOCKS = 6
#: Fingerprints in a bucket that are compared at once; larger buckets are cut again.
BUCKET = 1024
#: Blocks of the bits that a bucket leaves free, when it is cut again.
FINE_BLOCKS = 8
#: Of the pipeline's stage: words of a shingle, and the Jaccard similarity (a fraction) of near copies.
STAGE_SHINGLE = 5
SIMILAR = (4, 5)
#: Keys of a text, and how many least hashes make one. A pair at Jaccard 0.8 shares no key of the first level
#: in 1 of 97,000 cases. The second level, of other hashes, cuts buckets that are too large to be compared
#: at once; if all buckets were, a pair at 0.8 would miss in 1 of 48,000.
LEVELS = ((16, 3), (16, 3))
#: Bits beyond which a pair is no candidate (a pair at Jaccard 0.8 differs in 10, unrelated texts in 32).
RADIUS = 24
#: A bucket is compared at once up to so many shingles, and up to so many texts times shingles.
HELD, WORK = 1 << 21, 1 << 28
_BYTES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set (index 0: the lowest bit)."""
    total = np.zeros(64, dtype=np.int64)
    pad = -len(h) % 255
    h = np.concatenate([h, np.zeros(pad, dtype=np.uint64)]).reshape(-1, 255)
    for s in range(8):  # bits s, s+8, ... are counted side by side, a byte each
        packed = ((h >> np.uint64(s)) & _BYTES).sum(axis=1, dtype=np.uint64)
        total[s::8] += packed.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; 0 where there is no word."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # on bytes both are about ASCII only
    if not words:
        return 0
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + shingle - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False)) if n > 1 or len(words) == shingle else iter([b" ".join(words)])
        counts += bit_counts(np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64))
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): every row's fingerprint as a signed 64-bit number."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(each), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(bits: list[int], n: int) -> list[int]:
    return [sum(1 << b for b in part) for part in (x.tolist() for x in np.array_split(np.array(bits), n))]


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits kept by each table: every choice of ``blocks - distance`` blocks."""
    return [sum(c) for c in combinations(_blocks(list(range(64)), blocks), blocks - distance)]


def fine_masks(mask: int, blocks: int = FINE_BLOCKS, distance: int = DISTANCE) -> list[int]:
    """``mask`` widened by every choice of ``blocks - distance`` blocks of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(c) for c in combinations(_blocks(free, blocks), blocks - distance)]


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(value, smallest value of its component) within one bucket of distinct values."""
    x, n = np.sort(values), len(values)
    u = x.view(np.uint64)
    root, todo = np.full(n, -1), np.ones(n, dtype=bool)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], todo[i], front = i, False, [i]
        while front:
            left = np.flatnonzero(todo)
            near = left[np.bitwise_count(u[left] ^ u[front.pop()]) <= distance]
            root[near], todo[near] = i, False
            front += near.tolist()
    moved = np.flatnonzero(root != np.arange(n))
    return list(zip(x[moved].tolist(), x[root[moved]].tolist(), strict=True))


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints connected by close pairs.

    ``fps`` has distinct ``fp``. Pairs within ``distance`` bits share the key of a table. A
    bucket yields a spanning star of each of its components, never all its pairs. Buckets over
    ``bucket`` values are cut by further blocks of their free bits, again by the pigeonhole
    principle; a cut bucket has at most 13 bits left and so at most 8,192 values.
    """
    import pyarrow as pa

    spark = fps.sparkSession
    ship(spark)
    tables = masks(blocks, distance)
    keys = fps.repartition("fp").select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tables])).alias("t", "k"))
    sizes = materialise(keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = keys.join(sizes, ["t", "k"])
    fine = spark.createDataFrame([(t, _signed(m)) for t, mask in enumerate(tables) for m in fine_masks(mask, distance=distance)], "t int, m long")
    # broadcast: a fixed table of len(tables) * 56 rows
    cut = members.where(F.col("n") > bucket).join(F.broadcast(fine), "t").select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    whole = members.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    parts = cut.groupBy("m", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    lists = whole.select("fps").unionByName(parts.select("fps")).where(F.size("fps") > 1).distinct()

    def each(batches):
        for batch in batches:
            found = [link for x in batch.column(0).to_pylist() for link in spanning_links(np.array(x, dtype=np.int64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return lists.mapInArrow(released(each), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``distance`` or fewer bits.
    Null and word-less texts have fingerprint zero and are linked like any other. A null doc_id
    stays null and never names a component that has an id. Repeated rows are each returned.
    A very long text is hashed in pieces. Other columns are ignored; an empty table gives an
    empty result.
    """
    fp = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    links = close_links(fp.select("fp").distinct(), distance, blocks, bucket)
    # what is joined to the documents is a table of its own, so that the join can split a hot key
    roots = materialise(connected_components(links, "a", "b").withColumnRenamed("node", "fp"), "roots")
    rooted = fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return rooted.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(documents(spark, sf_dir))


def shingle_hashes(text: bytes | None, shingle: int = STAGE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text, also an empty one, is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False)) if n > 1 else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n))


@functools.cache
def _mixers(level: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED + level)
    a, b = (r.integers(0, 1 << 64, (math.prod(LEVELS[level]), 1), dtype=np.uint64) for _ in range(2))
    return a, b | np.uint64(1)


def anchors(h: np.ndarray, level: int = 0) -> np.ndarray:
    """The keys of a text with the shingle hashes ``h``."""
    from xxhash import xxh64_intdigest

    flip, times = _mixers(level)
    least = np.min([((h[at : at + 512] ^ flip) * times).min(axis=1) for at in range(0, len(h), 512)], axis=0).reshape(LEVELS[level])
    return np.array([xxh64_intdigest(x.tobytes(), t) for t, x in enumerate(least)], dtype=np.uint64)


_SKETCH = "doc_id long, dk long, th long, sid long, n int, fp long, keys array<long>"


def _long_lists(parts: list[np.ndarray]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, and the document as keyed() has it; of its shingle set the name, size, SimHash and keys, for every row."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # sets are as large as texts
                part = batch.slice(at, 100)
                sets = [shingle_hashes(t) for t in as_bytes(part.column(3))]
                sid, fp = (np.array(x, dtype=np.uint64).view(np.int64) for x in ([xxh64_intdigest(h.tobytes()) for h in sets], [sum(1 << int(i) for i in np.flatnonzero(2 * bit_counts(h) > len(h))) for h in sets]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sid), pa.array([len(h) for h in sets], pa.int32()), pa.array(fp), _long_lists([anchors(h) for h in sets])], names=["doc_id", "dk", "th", "sid", "n", "fp", "keys"])

    return keyed(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "dk", "th", "text").mapInArrow(released(each), _SKETCH)


def shingle_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sid, fp, hashes): the shingle sets of the documents in ``chosen`` (dk, th, sid, fp; one a set).

    They are computed anew from the texts: hashes of all texts would be twice what the texts are.
    """
    import pyarrow as pa

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _long_lists([shingle_hashes(t) for t in as_bytes(part.column(2))])], names=["sid", "fp", "hashes"])

    texts = keyed(docs.select("doc_id", "text")).select("dk", "th", "text").where(possibly_in(chosen)).join(chosen, ["dk", "th"]).dropDuplicates(["dk", "th"])
    return texts.select("sid", "fp", "text").mapInArrow(released(each), "sid long, fp long, hashes array<long>")


def similar_links(sid: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(text, smallest text of its component) within one bucket, by exact Jaccard of sets that are not empty."""
    order = np.argsort(sid)
    sid, fp, sets = sid[order], fp[order].view(np.uint64), [sets[i] for i in order.tolist()]
    sizes, (p, q) = np.array([len(x) for x in sets]), SIMILAR
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mine = [names[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark, root, left = np.zeros(int(names.max()) + 1, dtype=bool), np.arange(len(sid)), np.arange(len(sid))
    flat, begin = names, ends - sizes
    while len(left) > 1:
        i, left = left[0], left[1:]
        flat, begin, front = flat[sizes[i] :], begin[1:] - sizes[i], [i]
        while front and len(left):
            j = front.pop()
            mark[mine[j]] = True
            shared = np.add.reduceat(mark[flat], begin)
            mark[mine[j]] = False
            near = ((p + q) * shared >= p * (sizes[left] + sizes[j])) & (np.bitwise_count(fp[left] ^ fp[j]) <= RADIUS)
            if near.any():
                root[left[near]] = i
                front += left[near].tolist()
                left = left[~near]
                flat = np.concatenate([mine[x] for x in left.tolist()] or [flat[:0]])
                begin = np.cumsum(sizes[left]) - sizes[left]
    moved = np.flatnonzero(root != np.arange(len(sid)))
    return list(zip(sid[moved].tolist(), sid[root[moved]].tolist(), strict=True))


def _compared(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a spanning star of each component of each list of texts, compared exactly."""
    import pyarrow as pa

    def each(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        found = similar_links(g.column("sid").to_numpy(), g.column("fp").to_numpy(), [x.values.to_numpy().view(np.uint64) for x in g.column("hashes")])
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = lists.select(F.xxhash64("sids").alias("bucket"), F.explode("sids").alias("sid")).distinct().join(sets, "sid")
    return rows.select("bucket", "sid", "fp", "hashes").groupBy("bucket").applyInArrow(each, "a long, b long")


def _finer(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(k, sid, n): the members of buckets under keys that also hold further least hashes."""
    import pyarrow as pa

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), _long_lists([anchors(x.values.to_numpy().view(np.uint64), level) for x in part.column(1)])], names=["sid", "fine"])

    fine = sets.join(members.select("sid").distinct(), "sid", "left_semi").select("sid", "hashes").mapInArrow(released(each), "sid long, fine array<long>")
    return members.join(fine, "sid").select("k", "sid", "n", F.explode("fine").alias("f")).select(F.xxhash64("k", "f").alias("k"), "sid", "n")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets are similar, exactly."""
    p, q = SIMILAR
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hb")), "b")
    shared, total = F.size(F.array_intersect("ha", "hb")).cast("long"), F.size("ha").cast("long") + F.size("hb")
    return both.where(shared * (p + q) >= total * p).select("a", "b")


def _with_leader(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of buckets that no further key cuts: members with the smallest, the rest with every member.

    The members agree in 6 hashes, so the smallest is similar to most of them.
    """
    leaders = materialise(members.groupBy("k").agg(F.min("sid").alias("b")), "leaders")
    pairs = materialise(members.join(leaders, "k").where("sid <> b").select("k", F.col("sid").alias("a"), "b"), "stars")
    star = materialise(_verified(pairs.select("a", "b").distinct(), sets), "star")
    rest = materialise(pairs.join(star, ["a", "b"], "left_anti").select("k", "a"), "rest")
    if rest.isEmpty():
        return star
    others = rest.join(members.select("k", F.col("sid").alias("b")), "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return star.unionByName(_verified(others.distinct(), sets))


def bucket_links(members: DataFrame, sets: DataFrame, level: int = 0, held: int = HELD, work: int = WORK) -> DataFrame:
    """(a, b): links that join the similar texts of each bucket; ``members`` has distinct (k, sid, n).

    A bucket is compared whole in one task if its texts are few and short enough; it yields a
    star of each component, never its pairs. A larger one is cut by the keys of the next level,
    which hold more hashes. What the last level leaves too large is compared with the bucket's
    smallest text first, see _with_leader().
    """
    sizes = members.groupBy("k").agg(F.count("*").alias("size"), F.sum("n").alias("w")).where("size > 1")
    large = (F.col("w") > held) | (F.col("size") * F.col("w") > work)
    sizes = materialise(sizes.select("k", large.alias("large")), "sizes")
    every = materialise(members.join(sizes, "k"), "members")
    lists = every.where("not large").groupBy("k").agg(F.sort_array(F.collect_list("sid")).alias("sids")).select("sids").distinct()
    links = materialise(_compared(lists, sets), "links")
    hot = every.where("large").drop("large")
    if not hot.isEmpty():
        more = _with_leader(hot, sets) if level + 1 == len(LEVELS) else bucket_links(materialise(_finer(hot, sets, level + 1).distinct(), "finer"), sets, level + 1, held, work)
        links = links.unionByName(more)
    return links


def similar_groups(docs: DataFrame, **kwargs) -> DataFrame:
    """(doc_id, th, root) for every row: rows with one root are joined by links of Jaccard SIMILAR; th is a hash of the text.

    Candidates share a key and lie within RADIUS bits; exact Jaccard of the whole sets decides.
    Links are transitive. Texts without a word are alike. A very long text is one set of 8 bytes
    a word. Other columns are ignored; further arguments are bucket_links()'s.
    """
    rows = materialise(sketches(docs), "sketches", free=True)  # also what the stage before left
    # a row a set: aggregated before any join, since copies of one text may be many; what it was aggregated from agrees in all but "at"
    named = materialise(rows.groupBy("sid").agg(F.min(F.struct("dk", "th")).alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "named")
    keys = named.select("sid", "n", F.explode(F.array_distinct("keys")).alias("k"))
    shared = materialise(keys.groupBy("k").agg(F.count("*").alias("size")).where("size > 1").select("k"), "shared")
    members = materialise(keys.join(shared, "k"), "candidates")
    chosen = materialise(named.join(members.select("sid").distinct(), "sid", "left_semi").select("at.dk", "at.th", "sid", "fp"), "chosen", free=True)
    sets = materialise(shingle_sets(docs, chosen), "sets", free=True)
    names = materialise(rows.select("doc_id", "th", "sid"), "names")
    for done in (rows, named, shared, chosen):
        discard(done)
    links = materialise(bucket_links(members, sets, **kwargs), "similar", free=True)
    for done in (members, sets):
        discard(done)
    roots = materialise(connected_components(links, "a", "b").withColumnRenamed("node", "sid"), "roots")
    return names.join(roots, "sid", "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (similar_groups()): the one with the smallest id.

    Null ids come last; of rows that repeat an id the smaller text hash comes first, and of rows
    that repeat id and text any one stays. So texts without a word are one group. Other columns
    pass through whatever their names.
    """
    groups = materialise(similar_groups(docs), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    first = keyed(first.select("first.doc_id", "first.th"), "th").select("dk", "th", F.lit(True).alias("stays"))
    # only rows that go or are repeated meet a join: most documents are neither, and their texts are not shuffled
    counts = keyed(groups, "th").groupBy("dk", "th").agg(F.count("*").alias("n")).join(materialise(first, "first"), ["dk", "th"], "left")
    touched = materialise(counts.where("n > 1 or stays is null").select("dk", "th", F.coalesce("stays", F.lit(False)).alias("stays")), "touched", free=True)
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], "doc_id", "text")
    own = keyed(own).drop("doc_id", "text").withColumn("touched", possibly_in(touched))
    some = own.where("touched").join(touched, ["dk", "th"], "left").where(F.coalesce("stays", F.lit(True))).dropDuplicates(["dk", "th"])
    kept = own.where("not touched").select(*[f"`in_{c}`" for c in docs.columns]).unionByName(some.select(*[f"`in_{c}`" for c in docs.columns]))
    return kept.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
