"""Benchmark decontamination: templates with typed placeholders, window hashes, slot consistency."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vellum.llm.common import as_bytes, bitmap, documents, keyed, materialise, passing, released, ship

#: Template tokens of a window, and how many of them must be plain words.
WINDOW = 8
PLAIN = 4
#: Items of fewer tokens say too little as templates: they must occur with their own values.
SHORTEST = 5
#: A document holds an item if its windows cover this share of the item's tokens.
COVER = 0.6
#: Bits of the filter that windows of documents pass before the join, for each window of the benchmark.
FILTER_BITS = 256

UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams ton tons lb lbs oz pound pounds ml l liter liters litre litres
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent usd eur dollar dollars cent cents euro euros
    mph kmh km/h m/s degree degrees celsius fahrenheit kelvin meter meters metre metres kilometer kilometers watt watts volt volts""".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/^-]*%?")
_MEASURE = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_]+(?:/[^\W\d_]+)?|%)")
_EDGE = "\"'`()[]{}<>.,;:!?¿¡…«»„“”‘’*_"
_ASCII_EDGE, _ASCII_UNITS = bytes(b for b in _EDGE.encode() if b < 128), frozenset(u.encode() for u in UNITS)
_ASCII_STOP = re.compile(rb"[.!?][\"')\]]*$")
_STOP = re.compile(r"[.!?…][\"'”’)\]]*$")
_NUM, _UNIT, _NAME, _STOPS, _TAIL, _HEAD = 1, 2, 4, 8, 16, 32
#: The low bits of a code.
_KINDS = np.uint64(63)
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the placeholders.
_SLOTS = {k: np.uint64(v) for k, v in ((_NUM, 0xA24BAED4963EE407), (_UNIT, 0x9FB21C651E98DF25), (_NAME, 0xC3A5C85C97CB3127))}


class _Codes(dict):
    """word -> hash of its plain form, the low bits telling what it can be; remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        plain = word.strip(_ASCII_EDGE)
        if plain.isalpha() and word.isascii():  # most words
            low = plain.lower()
            kind = _UNIT if low in _ASCII_UNITS else _NAME if plain[:1].isupper() else 0
            if len(plain) < len(word):
                kind |= _TAIL * (word[-1] in _ASCII_EDGE) | _HEAD * (word[0] in _ASCII_EDGE) | (_STOPS if _ASCII_STOP.search(word) else 0)
        else:
            w = word.decode("utf-8", "replace")
            text = w.strip(_EDGE)
            low, kind = text.lower().encode(), 0
            if _NUMBER.fullmatch(text) or _MEASURE.fullmatch(text):
                kind = _NUM
            elif text.lower() in UNITS:
                kind = _UNIT
            elif text[:1].isupper():
                kind = _NAME
            kind |= _TAIL * (w[-1:] in _EDGE) | _HEAD * (w[:1] in _EDGE) | (_STOPS if _STOP.search(w) else 0)
        code = self[word] = xxh64_intdigest(low, 7) & ~63 | kind
        return code


_CODES = _Codes()


class Template:
    """The tokens of a text in one form: their hashes ``h`` and which of them are ``slots``."""

    def __init__(self, words: list[bytes], h: np.ndarray, slots: np.ndarray, joined: np.ndarray):
        self.words, self.at = words, np.flatnonzero(~joined)
        self.h, self.slots = h[self.at], slots[self.at]

    def value(self, j: int) -> int:
        """A hash of the words of a token; odd if there are several, 0 for a plain token."""
        if not self.slots[j]:
            return 0
        end = self.at[j + 1] if j + 1 < len(self.at) else len(self.words)
        h = xxh64_intdigest(b" ".join(w.strip(_EDGE.encode()) for w in self.words[self.at[j] : end]), 3) >> 1
        return h & ~1 | (end - self.at[j] > 1) | 2

    def values(self, j: int, n: int) -> list[int]:
        return [self.value(i) for i in range(j, j + n)]


def templates(text: bytes | None) -> list[Template]:
    """The text's forms, one or two.

    A number (also with its unit attached) is one placeholder; a unit is one after a number; a
    name is a run of capitalised words with no punctuation in between. Where a capitalised word
    begins a sentence it can be a name or not: it is a plain word in the first form and (part
    of) a name in the second.
    """
    words = (text or b"").split()
    code = np.fromiter(map(_CODES.__getitem__, words), dtype=np.uint64, count=len(words))
    kind = (code & _KINDS).astype(np.uint8)
    before = np.concatenate([[np.uint8(_STOPS | _TAIL)], kind[:-1]])[: len(kind)]
    number, capital = (kind & _NUM) > 0, (kind & _NAME) > 0
    unit = ((kind & _UNIT) > 0) & ((before & _NUM) > 0)
    begins = capital & ((before & _STOPS) > 0)
    apart = ((before & _TAIL) > 0) | ((kind & _HEAD) > 0)
    plain = code & ~_KINDS
    plain[unit], plain[number] = _SLOTS[_UNIT], _SLOTS[_NUM]
    out = []
    for name in [capital & ~begins, capital] if begins.any() else [capital]:
        joined = name & np.concatenate([[False], name[:-1]])[: len(name)] & ~apart
        out.append(Template(words, np.where(name, _SLOTS[_NAME], plain), number | unit | name, joined))
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    mixed = h ^ (h >> np.uint64(29))
    for j in range(n):
        out *= _MULT
        out += mixed[j : j + len(out)]
    return out ^ (out >> np.uint64(32))


def item_windows(text: bytes | None) -> list[tuple]:
    """(w, form, o, n, values, length, coverable, short) of the windows that an item is looked for by."""
    out = []
    for form, t in enumerate(templates(text)):
        length, short = len(t.h), len(t.words) < SHORTEST
        if not length or (form and short):
            continue
        n = min(WINDOW, length)
        good = np.convolve(~t.slots, np.ones(n, dtype=int), "valid") >= min(PLAIN, n)
        if not good.any() and not form:
            good[:] = True
        covered = np.zeros(length, dtype=bool)
        for o in np.flatnonzero(good):
            covered[o : o + n] = True
        if form and 2 * covered.sum() < length:  # too little besides placeholders; the first form has it
            continue
        w = window_hashes(t.h, n).view(np.int64).tolist()
        out += [(w[o], form, o, n, t.values(o, n), length, int(covered.sum()), short) for o in np.flatnonzero(good).tolist()]
    return out


def holds(hits: Iterable[tuple]) -> bool:
    """Whether the matched windows of one form, at one shift or all together, are the item.

    ``hits`` are (form, shift, o, n, own values, values, length, coverable, short). At one shift
    each slot value of the item must stand for one value of the document; then the item is
    there, with other values or the same. New values may coincide. A name at the item's edge can
    have run on into the text around it, and says nothing then. A short item must have its own
    values.
    """
    shifts: dict = defaultdict(list)
    for form, shift, *rest in hits:
        shifts[form, shift].append(rest)
    union: dict = defaultdict(set)
    for (form, _), rows in sorted(shifts.items()):
        covered, pairs = set(), set()
        for o, n, own, values, length, coverable, short in rows:
            covered.update(range(o, o + n))
            pairs.update((a, b) for j, (a, b) in enumerate(zip(own, values, strict=True), o) if a and not (b & 1 and j in (0, length - 1) and not short))
        if short and any(a != b for a, b in pairs):
            continue
        if len({a for a, _ in pairs}) == len(pairs):
            union[form] |= covered
            if len(union[form]) >= (length if short else COVER * coverable):
                return True
    return False


_WINDOWS = "item_id long, ik long, w long, item_form int, o int, n int, own array<long>, length int, coverable int, short boolean"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of each distinct benchmark row that has an id and a word; ik names the row."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()

    def each(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            rows = [(item, ik, *row) for item, ik, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts, strict=True) for row in item_windows(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.list_(pa.int64())] + [pa.int32()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _WINDOWS.split(", ")])

    return items.select("item_id", F.xxhash64("item_id", "text").alias("ik"), "text").mapInArrow(released(each), _WINDOWS)


def window_filter(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The lengths of the windows, and a bitmap of their hashes: all that the driver gets of the benchmark."""
    sizes = windows.groupBy("n").agg(F.count("*").alias("c")).collect()
    return sorted(r["n"] for r in sizes), bitmap(windows.select("w"), sum(r["c"] for r in sizes), FILTER_BITS)


def document_windows(docs: DataFrame, lengths: list[int], seen: np.ndarray) -> DataFrame:
    """(dk, th, form, p, w, values) of the windows of (dk, th, text) that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(seen)

    def rows_of(dk: int, th: int, text: bytes | None, seen: np.ndarray):
        for form, t in enumerate(templates(text)):
            for n in lengths:
                w = window_hashes(t.h, n)
                for p in passing(w, seen).tolist():
                    yield dk, th, form, p, int(w[p].view(np.int64)), t.values(p, n)

    def each(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            rows = [r for d, h, t in zip(ids, hashes, texts, strict=True) for r in rows_of(d, h, t, sent.value)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dk", "th", "form", "p", "w", "values"])

    return docs.select("dk", "th", "text").mapInArrow(released(each), "dk long, th long, form int, p int, w long, values array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(dk, th, item_ids): the sorted ids of the benchmark items that a document holds, where it holds any.

    The windows of the documents' templates are hash-joined to the benchmark's; a bitmap of the
    latter keeps windows from the join that cannot match. Hits of one document and item are then
    checked. Items without an id or a word are not looked for; shorter ones than SHORTEST only
    with their own values.
    """
    windows = materialise(benchmark_windows(benchmark), "windows")
    lengths, seen = window_filter(windows)
    hits = materialise(document_windows(keyed(docs.select("doc_id", "text")), lengths, seen).distinct(), "hits")
    hit = F.struct(F.concat("form", F.lit(":"), "item_form").alias("form"), (F.col("p") - F.col("o")).alias("shift"), "o", "n", "own", "values", "length", "coverable", "short")
    pairs = hits.join(windows, "w").where(F.size("values") == F.col("n")).groupBy("dk", "th", "ik", "item_id").agg(F.collect_list(hit).alias("hits"))

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([holds(tuple(h.values()) for h in x) for x in batch.column(3).to_pylist()], pa.bool_())], names=["dk", "th", "item_id", "found"])

    found = pairs.select("dk", "th", "item_id", "hits").mapInArrow(released(each), "dk long, th long, item_id long, found boolean").where("found")
    return found.groupBy("dk", "th").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_ids) for every row of ``docs``: the benchmark items that its text holds, see contaminated().

    A null or empty text holds none; repeated rows get the same result each; repeated items count
    each. Very long texts are one task's. Other columns are ignored; an empty table gives an
    empty result.
    """
    found = materialise(contaminated(docs, benchmark), "found")  # a table, so that the join can split a repeated key
    out = keyed(docs.select("doc_id", "text")).select("doc_id", "dk", "th").join(found, ["dk", "th"], "left")
    return out.select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids for every document."""
    out = found_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds an item of the benchmark; other columns pass through whatever their names."""
    found = materialise(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "found")
    own = keyed(docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], "doc_id", "text"))
    return own.join(found, ["dk", "th"], "left_anti").select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
