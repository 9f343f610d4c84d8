"""Line deduplication over overlapping windows of three lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import documents, keyed, materialise

WINDOW = 3


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(dk, th, pos, h1, h2): every run of ``window`` consecutive lines, by 96 bits of hash."""
    lines = keyed(docs.select("doc_id", "text")).select("dk", "th", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= window)
    hashed = lines.select("dk", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda i: F.slice("h", i + 1, window))
    return hashed.select("dk", "th", F.posexplode(grams).alias("pos", "g")).select("dk", "th", "pos", F.xxhash64("g").alias("h1"), F.hash("g").alias("h2"))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(dk, th, pos): windows whose lines also start earlier, by (doc_id, text hash, line)."""
    w = windows(docs, window)
    at = F.struct("dk", "th", "pos")
    first = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").drop("n")
    first = materialise(first, "lines")  # so that the join can split a line that is very common
    return w.join(first, ["h1", "h2"]).where(at > F.col("first")).select("dk", "th", "pos")


def covered(starts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(dk, th, runs): the covered lines of a document as sorted, disjoint runs (begin, end)."""
    w = Window.partitionBy("dk", "th").orderBy("pos")
    new = F.coalesce((F.col("pos") > F.lag("pos").over(w) + window).cast("int"), F.lit(1))
    runs = starts.distinct().withColumn("new", new).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("dk", "th", "run").agg(F.min("pos").alias("begin"), (F.max("pos") + window).alias("end"))
    return runs.groupBy("dk", "th").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def _dedup(docs: DataFrame, window: int) -> DataFrame:
    """The columns of ``docs`` as in_..., and clean_text, n_lines and n_removed."""
    k = keyed(docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], "doc_id", "text"))
    k = k.join(covered(repeated(docs, window), window), ["dk", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    ends = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    begins = F.concat(F.transform("runs", lambda r: r["begin"]), F.array(F.size("lines")))
    k = k.withColumns({"e": ends, "b": begins})
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice("lines", F.get("e", i) + 1, F.get("b", i) - F.get("e", i))))
    k = k.withColumn("kept", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return k.select(
        *[F.col(f"`in_{c}`") for c in docs.columns],
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("clean_text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("runs").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``clean_text`` (later occurrences removed), ``n_lines`` and ``n_removed``.

    A window is ``window`` consecutive \\n-split lines, compared exactly (blank lines count).
    One that also starts earlier in the order (doc_id, line) is removed with all its lines;
    windows are judged on the input, so overlapping ones in a document count. Texts of fewer
    lines have no window and stay whole. A null text has no lines and stays null; an empty one
    is one empty line. Null ids come first in the order. Rows that repeat both id and text are
    one document and get the same result; of rows that repeat an id only, the one with the
    smaller text hash comes first. A text that loses all lines becomes empty. Windows are equal
    if 96 bits of hash are: of 10**12 different windows two agree with odds of 1 in 100,000. Very
    long texts are arrays of their lines. Other columns pass through; ones of the three names are
    replaced (the stage keeps them).
    """
    new = ("clean_text", "n_lines", "n_removed")
    return _dedup(docs, window).select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns if c not in new], *new)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() over all documents, the remaining text as a digest."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(pos, 2) OVER d IS NOT NULL AS whole FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) > 1 AS again FROM w WHERE whole
), c AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(bool_or(r.again), false) AS gone
  FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.pos BETWEEN l.pos - 2 AND l.pos GROUP BY ALL
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by what line deduplication leaves; n_chars follows. Texts that lose every line go."""
    out = _dedup(docs, WINDOW)
    gone = (F.col("n_removed") > 0) & (F.col("clean_text") == "")
    new = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col("in_n_chars")) if "n_chars" in docs.columns else None}
    return out.where(~F.coalesce(gone, F.lit(False))).select(*[new[c].alias(c) if c in new else F.col(f"`in_{c}`").alias(c) for c in docs.columns])
