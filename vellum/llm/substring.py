"""Substring deduplication: recurring passages, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Words, documents
from vellum.llm.repeats import Unit, remove_repeats

WINDOW = 50
#: Words of an anchor, at each cut.
GRAMS = (16, 33, 50)
#: Segments in a shard, about.
SHARD = 1_000
#: Words of all patterns in one automaton.
PATTERN_WORDS = 500_000


@functools.cache
def _words() -> Words:
    return Words(23)


def _unit(window: int, grams: tuple[int, ...]) -> Unit:
    return Unit(lambda t: t.split(), lambda w: _words().of(w), b" ".join, window, grams, True)


def confirmed(texts: list[tuple[int, ...]], dk: list[int], window: int) -> dict[tuple[int, ...], int]:
    """window -> smallest document, for the windows that more than one document holds."""
    least: dict[tuple[int, ...], int] = {}
    again: set[tuple[int, ...]] = set()
    for text, d in zip(texts, dk, strict=True):
        for j in range(len(text) - window + 1):
            w = text[j : j + window]
            other = least.setdefault(w, d)
            if other != d:
                again.add(w)
                least[w] = min(d, other)
    return {w: least[w] for w in again}


def locate(rows: list[tuple], unit: Unit) -> list[tuple[int, int, list[int]]]:
    """Confirm the recurring windows of a shard, compile them, stream every segment past them.

    The automaton reads numbers of words, so a window matches whole words only; each hit tells
    where a segment holds a recurring window and who held it first. Very many patterns are
    compiled and streamed part by part.
    """
    import ahocorasick

    number: dict[bytes, int] = {}
    texts = [tuple(number.setdefault(w, len(number)) for w in r[5].split(b" ")) for r in rows]
    found: list[set[int]] = [set() for _ in rows]
    waiting = list(confirmed(texts, [r[2] for r in rows], unit.window).items())
    for at in range(0, len(waiting), max(1, PATTERN_WORDS // unit.window)):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, owner in waiting[at : at + max(1, PATTERN_WORDS // unit.window)]:
            automaton.add_word(w, owner)
        automaton.make_automaton()
        for r, text, js in zip(rows, texts, found, strict=True):
            js.update(end - unit.window + 1 for end, owner in automaton.iter(text) if owner < r[2])
    return [(r[0], r[1], sorted(js)) for r, js in zip(rows, found, strict=True)]


def dedup_passages(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, shard: int = SHARD, **kwargs) -> DataFrame:
    """(doc_id, n_units, n_removed, runs, kept): words of windows that start in a smaller doc_id go.

    Units are words `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by one blank. See
    remove_repeats for nulls, short and very long texts and repeated rows.
    """
    return remove_repeats(docs, _unit(window, grams), locate, shard=shard, **kwargs)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_passages() over all documents, the kept words as a digest."""
    out = dedup_passages(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: For ids that are unique.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d
), w AS (
  SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 49 <= len(words) THEN array_to_string(words[pos : pos + 49], ' ') END AS win FROM p
), m AS (
  SELECT doc_id, pos, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM w
), c AS (
  SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m
), s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
