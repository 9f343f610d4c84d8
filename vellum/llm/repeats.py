"""Windows of units (words or bytes) that also start earlier in the corpus.

1. Every text is cut into segments of windows that share an anchor; equal windows have equal
   anchors, so only segments whose anchor recurs can hold a repeated window.
2. Segments of one content are settled by the first of them. What remains are first segments
   whose anchor also has another content.
3. Those go, by anchor, to shards where ``resolve`` finds which of their windows repeat. The
   contents of an anchor that has too many for a shard are cut again in the same way, with longer
   anchors and at last whole windows, of which each has one content.
4. The removed windows of a text are merged to runs.

All links between rows are aggregates and joins on hashes, so a passage in a third of all
documents is pre-aggregated and its join side can be split; nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import as_bytes, discard, keyed, materialise, released, ship
from vellum.llm.winnow import segments

#: Contents of one anchor that a shard takes; those of anchors with more are cut again.
CONTENTS = 250
#: First segments of a shard, about.
SHARD = 1_000
_SEG = "h long, sig long, dk long, th long, base long, q long, content binary, contents long"


@dataclass(frozen=True)
class Unit:
    """How a text is a sequence of units.

    split: text -> units; values: units -> uint64 hashes; join: units -> bytes; window and grams
    (of the anchors, from the first cut to the last, which is a window) in units, window - gram
    + 1 at most 256; strict: only a smaller doc_id counts as earlier.
    """

    split: Callable
    values: Callable
    join: Callable
    window: int
    grams: tuple[int, ...]
    strict: bool


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _long(np.concatenate([np.zeros(0, np.uint64), *parts])))


def _pieces(texts: list, most: int = 2_000_000):
    """Slices of a batch of about ``most`` bytes of text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


def segment_rows(texts: DataFrame, unit: Unit, gram: int) -> DataFrame:
    """(dk, th, base, h[], sig[], q[]) of each (dk, th, base, text); q packs base + lo, hi - lo and p - lo."""

    def each(batches):
        for batch in batches:
            rows, base = as_bytes(batch.column(3)), batch.column(2).to_pylist()
            for a, b in _pieces(rows):
                h, sig, q = [], [], []
                for t, at in zip(rows[a:b], base[a:b], strict=True):
                    s = segments(unit.values(unit.split(t or b"")), unit.window, gram)
                    h.append(s.h)
                    sig.append(s.sig)
                    q.append((((s.lo + at) << 16) | ((s.hi - s.lo) << 8) | (s.p - s.lo)).view(np.uint64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), _lists(h), _lists(sig), _lists(q)], names=["dk", "th", "base", "h", "sig", "q"])

    return texts.select("dk", "th", "base", "text").mapInArrow(released(each), "dk long, th long, base long, h array<long>, sig array<long>, q array<long>")


def contents(texts: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The content of the segments ``wanted`` (h, sig, dk, th, base, q, contents)."""

    def each(batches):
        for batch in batches:
            rows, lists = as_bytes(batch.column(3)), batch.column(4)
            for a, b in _pieces(rows):
                out = []
                for i in range(a, b):
                    units, (dk, th, base) = unit.split(rows[i] or b""), (batch.column(k)[i].as_py() for k in range(3))
                    for s in lists[i].as_py():
                        lo, n = (s["q"] >> 16) - base, s["q"] >> 8 & 255
                        out.append((s["h"], s["sig"], dk, th, base, s["q"], unit.join(units[lo : lo + n + unit.window]), s["contents"]))
                columns = list(zip(*out, strict=True)) or [[]] * 8
                kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "sig", "dk", "th", "base", "q", "content", "contents"])

    lists = wanted.groupBy("dk", "th", "base").agg(F.collect_list(F.struct("h", "sig", "q", "contents")).alias("s"))
    return texts.select("dk", "th", "base", "text").join(lists, ["dk", "th", "base"]).select("dk", "th", "base", "text", "s").mapInArrow(released(each), _SEG)


def repeated_windows(texts: DataFrame, unit: Unit, resolve: Callable[[list[tuple], Unit], list[tuple[int, int, list[int]]]], most_contents: int = CONTENTS, shard: int = SHARD, level: int = 0) -> DataFrame:
    """(dk, th, base, ranges): windows to remove of each text with any, as first start << 16 | how many.

    ``texts`` are (dk, th, base, text), base being where the text begins in its document; they
    are ordered by the first three. ``resolve`` takes the (h, sig, dk, th, q, content) rows of a
    shard and returns, for each (h, sig), the numbers of its windows that also start earlier
    among the rows.
    """
    base = materialise(segment_rows(texts, unit, unit.grams[level]), "segments")
    rows = base.select("dk", "th", "base", F.explode(F.arrays_zip("h", "sig", "q")).alias("s")).select("dk", "th", "base", "s.*")
    if unit.strict:
        again = rows.groupBy("h").agg(F.min("dk").alias("a"), F.max("dk").alias("b")).where("a < b").select("h")
    else:
        again = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # the aggregated sides are tables of their own: a join that reads both sides from exchanges can split a hot key
    again = materialise(again, "again")
    occurrences = materialise(rows.join(again, "h", "left_semi"), "occurrences", free=True)
    discard(base)
    discard(again)
    firsts = materialise(occurrences.groupBy("h", "sig").agg(F.min(F.struct("dk", "th", "q", "base")).alias("first")), "firsts", free=True)
    mixed = materialise(firsts.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1"), "mixed")
    unsettled = firsts.join(mixed, "h").select("h", "sig", "first.*", "contents")
    seg = materialise(contents(texts, unsettled, unit), "contents", free=True)
    few, many = seg.where(F.col("contents") <= most_contents), seg.where(F.col("contents") > most_contents)
    shards = -(-few.count() // shard) or 1

    def each(group: pa.Table) -> pa.Table:
        found = resolve(list(zip(*(group.column(k).to_pylist() for k in ("h", "sig", "dk", "th", "q", "content")), strict=True)), unit)
        columns = list(zip(*found, strict=True)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["h", "sig", "js"])

    flags = few.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(each, "h long, sig long, js array<int>")
    lo = F.shiftright("q", 16)
    if level + 1 < len(unit.grams) and not many.isEmpty():
        parts = many.select("dk", "th", lo.alias("base"), F.col("content").alias("text"))
        ranges = repeated_windows(parts, unit, resolve, most_contents, shard, level + 1)
        starts = F.flatten(F.transform("ranges", lambda r: F.sequence(F.shiftright(r, 16), F.shiftright(r, 16) + r.bitwiseAND(F.lit(0xFFFF)) - 1)))
        cut = many.select("h", "sig", "dk", "th", lo.alias("base")).join(ranges, ["dk", "th", "base"])
        flags = flags.unionByName(cut.select("h", "sig", F.transform(starts, lambda x: (x - F.col("base")).cast("int")).alias("js")))
    flags = flags.where(F.size("js") > 0).dropDuplicates(["h", "sig"])
    flagged = materialise(firsts.join(flags, ["h", "sig"], "left"), "flags", free=True)
    for done in (firsts, mixed, seg):
        discard(done)
    o = occurrences.join(flagged, ["h", "sig"])
    n = F.shiftright("q", 8).bitwiseAND(F.lit(255))
    later = F.col("dk") > F.col("first.dk") if unit.strict else F.struct("dk", "th", "q") > F.struct("first.dk", "first.th", "first.q")
    pack = lambda start, count: F.shiftleft(start, 16) + count
    ranges = F.when(later, F.array(pack(lo, n + 1))).otherwise(F.transform("js", lambda j: pack(lo + j, F.lit(1).cast("long"))))
    o = o.select("dk", "th", "base", ranges.alias("r")).where("r is not null")
    return o.groupBy("dk", "th", "base").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def remove_repeats(docs: DataFrame, unit: Unit, resolve: Callable, **kwargs) -> DataFrame:
    """(doc_id, n_units, n_removed, runs, kept binary) for every row of ``docs``.

    runs: the removed stretches (begin, end) in units, sorted and disjoint; kept: what is left,
    joined. A null text is an empty one; texts shorter than a window stay whole; very long ones
    are cut at every anchor and held whole by one task. Null ids come
    first in the order of documents. Rows that repeat both id and text are one document and get
    the same result each; rows that repeat an id with another text are ordered by a hash of the
    text, unless only a smaller id counts. Windows are judged on the input. Other columns are
    ignored.
    """
    window = unit.window
    own = docs.select("doc_id", "text")
    ship(docs.sparkSession)
    texts = keyed(own).select("dk", "th", F.lit(0).cast("long").alias("base"), "text")
    ranges = repeated_windows(texts, unit, resolve, **kwargs).drop("base")

    def each(batches):
        for batch in batches:
            texts, lists = as_bytes(batch.column(1)), batch.column(2)
            for a, b in _pieces(texts):
                sizes, runs, kept = [], [], []
                for i in range(a, b):
                    units, r = unit.split(texts[i] or b""), lists[i]
                    sizes.append(len(units))
                    if not r.is_valid:
                        runs.append([])
                        kept.append(unit.join(units))
                        continue
                    packed = r.values.to_numpy()
                    start, n = packed >> 16, packed & 0xFFFF
                    step = np.zeros(len(units) + 2, dtype=np.int32)
                    np.add.at(step, start + 1, 1)
                    np.add.at(step, start + n + window, -1)
                    edge = np.flatnonzero(np.diff((np.cumsum(step) > 0).astype(np.int8)))
                    begin, end = edge[::2].tolist(), edge[1::2].tolist()
                    runs.append([{"begin": x, "end": y} for x, y in zip(begin, end, strict=True)])
                    left = [units[x:y] for x, y in zip([0, *end], [*begin, len(units)], strict=True)]
                    kept.append(unit.join(b"".join(left) if isinstance(units, bytes) else [w for p in left for w in p]))
                spans = pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_units", "runs", "kept"])

    rows = keyed(own).join(ranges, ["dk", "th"], "left").select(F.col("doc_id").cast("long"), "text", "ranges")
    out = rows.mapInArrow(released(each), "doc_id long, n_units long, runs array<struct<begin:long,end:long>>, kept binary")
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["begin"])
    return out.select("doc_id", "n_units", removed.alias("n_removed"), "runs", "kept")
