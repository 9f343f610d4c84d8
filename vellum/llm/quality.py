"""Quality rules: simple counts of a text; lines that many documents of its host share are removed."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import as_bytes, discard, documents, keyed, materialise, released, ship

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows beyond which a text fails.
MAX_REPEAT = 50
#: A line is frequent beyond this many documents of a host if it is in more than this share of
#: them, and beyond LINE_MOST documents whatever their share.
LINE_DOCS = 10
LINE_SHARE = 0.02
LINE_MOST = 1000
#: A text is depleted if less than this share of its words is outside frequent lines.
LEFT_SHARE = 0.3
_SYMBOLS = b"#*$%&|<>"
_STATS = "dk long, th long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = bytearray(len(words))
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def line_hash(line: bytes) -> tuple[int, int]:
    """Hash of a line, A-Z lower-cased and white space made single blanks; how many words it has."""
    from xxhash import xxh64_intdigest

    tokens = line.lower().split()
    h = xxh64_intdigest(b" ".join(tokens))
    return h - (h >> 63 << 64), len(tokens)


def text_stats(text: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {line hash: words in it}."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    hashed: dict[int, int] = {}
    for x in lines:
        h, n = line_hash(x)
        hashed[h] = hashed.get(h, 0) + n
    return len(words), len(b"".join(words).decode()), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), hashed


def statistics(docs: DataFrame) -> DataFrame:
    """One row per row (dk, th, host, text): the base counts and the hashes of its normalised lines."""
    import pyarrow as pa

    ship(docs.sparkSession)
    line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))

    def each(batches):
        for batch in batches:
            rows = [text_stats(t) for t in as_bytes(batch.column(3))]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            lines = pa.array([[{"h": h, "w": w} for h, w in r[5].items()] for r in rows], line)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts, lines], names=["dk", "th", "host", *_COUNTS, "lines"])

    return docs.select("dk", "th", "host", "text").mapInArrow(released(each), _STATS)


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST) -> DataFrame:
    """(host, h): lines in more than ``line_docs`` documents of a host and ``line_share`` of them, or in more than ``line_most``.

    ``rows`` has each document of a host once. Both sides of the join are tables, so that a hot
    host's lines can be split.
    """
    hosts = materialise(rows.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    lines = rows.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    lines = materialise(lines, "lines")
    often = (F.col("n") > F.col("docs") * line_share) | (F.col("n") > line_most)
    return lines.join(hosts, "host").where(often).select("host", "h")


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, line_most: int = LINE_MOST) -> DataFrame:
    """Base counts, ``n_frequent_words``, ``base_failed``, ``kept`` and ``clean_text`` for every row of ``docs``.

    clean_text is the text without its frequent lines; a text that keeps too few of its words is
    depleted and not kept. Lines are compared with A-Z lower-cased and white space made single
    blanks; lines without a word are never frequent. A document counts once a line, and rows that
    repeat id, text and host are one document; all get the same result. The host is ``source``;
    rows without one share the empty host. A null or empty text has no words and fails; a null
    one stays null. Of tied lines each is judged alone. Very long texts are held whole by a task.
    Other columns are ignored; an empty table gives an empty result.
    """
    import pyarrow as pa

    key = ["dk", "th", "host"]
    own = keyed(docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")))
    rows = materialise(statistics(own).dropDuplicates(key), "quality", free=True)
    often = materialise(frequent_lines(rows, line_docs, line_share, line_most), "frequent")
    hit = rows.select(*key, F.explode("lines").alias("l")).select(*key, "l.h", "l.w").join(often, ["host", "h"])
    hit = hit.groupBy(*key).agg(F.sum("w").alias("n_frequent_words"), F.collect_list("h").alias("gone"))
    # a table of its own, so that the join with the texts can split a key that is repeated very often
    flags = materialise(rows.drop("lines").join(hit, key, "left"), "flags", free=True)
    discard(rows)

    def each(batches):
        for batch in batches:
            texts, gone = as_bytes(batch.column(1)), batch.column(2)
            clean = []
            for t, g in zip(texts, gone, strict=True):
                drop = set(g.as_py() or ())
                clean.append(b"\n".join(x for x in t.split(b"\n") if line_hash(x)[0] not in drop) if t and drop else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(clean, pa.binary()).cast(pa.string())], names=["doc_id", *_COUNTS, "n_frequent_words", "clean_text"])

    joined = own.join(flags, key).select(F.col("doc_id").cast("long"), "text", "gone", *_COUNTS, F.coalesce("n_frequent_words", F.lit(0)).alias("n_frequent_words"))
    out = joined.mapInArrow(released(each), f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, n_frequent_words long, clean_text string")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_frequent_words") < F.col("n_words") * left_share
    return out.select("doc_id", *_COUNTS, "n_frequent_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "clean_text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality() over all documents, what is left of a text as a digest."""
    return quality(documents(spark, sf_dir)).withColumn("clean_sha256", F.sha2(F.coalesce("clean_text", F.lit("")), 256)).drop("clean_text")


#: For ids that are unique.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), al AS (
  SELECT rid, host, pos, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
), l AS (
  SELECT rid, host, line, norm FROM al WHERE norm <> ''
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid
), f AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM l GROUP BY ALL) JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host) WHERE n > 10 AND (n > docs * 0.02 OR n > 1000)
), often AS (
  SELECT rid, sum(len(string_split(norm, ' '))) AS n_frequent_words FROM l JOIN f USING (host, norm) GROUP BY rid
), c2 AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (f.norm IS NULL) AS clean FROM al LEFT JOIN f USING (host, norm) GROUP BY rid
), p AS (
  SELECT rid, generate_subscripts(words, 1) AS pos, unnest(words) AS w FROM d
), g AS (
  SELECT rid, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)
), c AS (
  SELECT rid, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS again FROM g
), r AS (
  SELECT rid, count(*) FILTER (hit) AS n_repeat_words FROM (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c) GROUP BY rid
), s AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_frequent_words, 0) AS BIGINT) AS n_frequent_words, sha256(coalesce(clean, '')) AS clean_sha256
  FROM d LEFT JOIN c2 USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN often USING (rid) LEFT JOIN r USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= n_words * 0.3 AS kept FROM s
"""
