"""Suffix-array deduplication: difference-cover suffix sorting over shards of candidate text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents
from vellum.llm.repeats import Unit, remove_repeats
from vellum.llm.winnow import mix

WINDOW = 100
#: Bytes of an anchor, at each cut.
GRAMS = (32, 66, 100)
#: Segments in a shard, about: some 150 KB of text, of which sorting takes some hundred bytes a byte.
SHARD = 1_000
_COMPARE = 20_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _values(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, dtype=np.uint8)]


def _unit(window: int, grams: tuple[int, ...]) -> Unit:
    return Unit(lambda t: t, _values, bytes, window, grams, False)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the rows, equal rows alike, in lexicographic order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _packed(bits: int, *columns: np.ndarray) -> np.ndarray:
    """The columns in one number, which orders like them, if that fits in 63 bits."""
    if bits * len(columns) > 63:
        return _names(*columns)
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = (out << bits) | c
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of non-negative numbers in order, by a difference cover of 3.

    Triples at places not divisible by 3 are sorted and named; if names repeat, the sequence of
    names is sorted the same way. The suffixes left are sorted by their first number and the
    rank of what follows, and merged in.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    x = np.concatenate([t.astype(np.int64) + 1, np.zeros(4, np.int64)])
    end = n + 1 if n % 3 == 1 else n  # one more sample ends the names of the first kind
    one, two = np.arange(1, end, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    bits = int(x.max()).bit_length()
    _, name = np.unique(_packed(bits, x[sample], x[sample + 1], x[sample + 2]), return_inverse=True)
    if name.max() + 1 == len(name):
        order = np.argsort(name)
    else:
        order = suffix_array(name)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    s12 = sample[order]
    s12 = s12[s12 < n]
    zero = np.arange(0, n, 3)
    wide = max(bits, int(len(order) + 1).bit_length())
    s1, s2 = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    # against the first kind: (number, rank after it); against the second: (two numbers, rank after them)
    both = np.concatenate([zero, s1])
    k1 = _packed(wide, x[both], rank[both + 1])
    by = np.argsort(k1[: len(zero)], kind="stable")
    s0 = zero[by]
    less1 = np.searchsorted(k1[len(zero) :], k1[: len(zero)][by])
    both = np.concatenate([s0, s2])
    k2 = _packed(wide, x[both], x[both + 1], rank[both + 2])
    less2 = np.searchsorted(k2[len(s0) :], k2[: len(s0)])
    out = np.full(n, -1, dtype=np.int64)
    out[np.arange(len(s0)) + less1 + less2] = s0
    out[out < 0] = s12
    return out


def compare_adjacent(rows: list[tuple], unit: Unit) -> list[tuple[int, int, list[int]]]:
    """Sort the suffixes of a shard's segments; windows that agree with a neighbour are grouped.

    Each group keeps its first window by (document, place).
    """
    window = unit.window
    length = np.array([len(r[5]) for r in rows], dtype=np.int64)
    n = np.array([(r[4] >> 8 & 255) + 1 for r in rows], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    t = np.zeros(int((length + 1).sum()), dtype=np.int64)  # 0 stands between segments
    raw = np.frombuffer(b"\0".join(r[5] for r in rows) + b"\0", dtype=np.uint8)
    t[:] = raw.astype(np.int64) + 1
    t[begin + length] = 0
    row = np.repeat(np.arange(len(rows)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + j
    which = np.full(len(t), -1, dtype=np.int64)
    which[start] = np.arange(len(start))
    sa = suffix_array(t)
    w = which[sa]
    w = w[w >= 0]  # windows, sorted by what begins there
    same, short = np.zeros(len(w), dtype=bool), t.astype(np.int16)
    for a in range(1, len(w), _COMPARE):
        b = min(len(w), a + _COMPARE)
        part = short[start[w[a - 1 : b], None] + np.arange(window)]
        same[a:b] = (part[1:] == part[:-1]).all(axis=1)
    dk, th, pos = (np.array(c, dtype=np.int64)[row] for c in ([r[2] for r in rows], [r[3] for r in rows], [r[4] >> 16 for r in rows]))
    place = _names(dk, th, pos + j)[w]
    heads = np.flatnonzero(~same)
    first = np.minimum.reduceat(place, heads)[np.cumsum(~same) - 1] if len(w) else place
    gone = w[place > first]
    out: list[list[int]] = [[] for _ in rows]
    for r, k in zip(row[gone].tolist(), j[gone].tolist(), strict=True):
        out[r].append(k)
    return [(r[0], r[1], sorted(js)) for r, js in zip(rows, out, strict=True)]


def dedup_bytes(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, shard: int = SHARD, **kwargs) -> DataFrame:
    """(doc_id, n_units, n_removed, runs, kept): bytes of windows that also start earlier go.

    Units are the bytes of the UTF-8 text; a window lies within one document. Earlier is a
    smaller doc_id, or the same document before. See remove_repeats for nulls, short and very
    long texts and repeated rows.
    """
    return remove_repeats(docs, _unit(window, grams), compare_adjacent, shard=shard, **kwargs)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_bytes() over all documents, the remaining bytes as a digest."""
    out = dedup_bytes(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: For ids that are unique.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS pos FROM d
), w AS (
  SELECT doc_id, pos, b[pos : pos] AS byte, CASE WHEN pos + 99 <= octet_length(b) THEN b[pos : pos + 99] END AS win FROM p
), m AS (
  SELECT doc_id, pos, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM w
), c AS (
  SELECT doc_id, pos, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c
), s AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(hex(byte), '' ORDER BY pos) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
