"""Language identification: nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import crc_mod, documents, release, released, ship

#: Centroids are fitted on at most so many labelled texts of a language, those with the smallest
#: hash of the id; of a longer text on a stretch of SAMPLE_CHARS. IDF is counted on all.
SAMPLE = 400
SAMPLE_CHARS = 65_536
CENTROIDS = 3
DIMENSIONS = 1 << 13
HELD_OUT = 5
#: A text is rejected if its cosine is below this share of the lowest centile in training.
REJECT_SHARE = 0.3
#: Documents whose vectors are held at once, and characters of a text that are.
_ROWS, _CHUNK = 64, 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngram_counts(text: str | None, dims: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed counts of the letter n-grams, n = 1 to 3, of a lower-cased text; None: no letter.

    Whatever stands between letters counts as one blank.
    """
    out, tail, any_letter = np.zeros(dims, dtype=np.float32), np.array([32], dtype=np.uint64), False
    shift = np.uint64(64 - dims.bit_length() + 1)
    for at in range(0, len(text or ""), _CHUNK):
        cp = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[cp]
        any_letter |= bool(letter.any())
        x = np.where(letter, cp, 32).astype(np.uint64)
        before = np.concatenate([[tail[-1] != 32], letter[:-1]])
        new = x[letter | before]
        n_old, x = len(tail), np.concatenate([tail, new])
        h = x
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
            fresh = h[max(0, n_old - n + 1) :] if n_old >= n else h
            if n == 1:
                fresh = fresh[fresh != 32]
            k = ((fresh + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> shift
            out += np.bincount(k.astype(np.int64), minlength=dims)
        tail = x[-2:]
    return out if any_letter else None


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) * idf."""
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids of the unit rows x: spherical k-means from far-apart seeds."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    c = [unit(x.mean(axis=0))]
    while len(c) < min(k, len(x)):
        c.append(x[int(np.argmin((x @ np.array(c).T).max(axis=1)))])
    c = np.array(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32)


def document_frequencies(texts: DataFrame, dims: int = DIMENSIONS) -> tuple[int, np.ndarray]:
    """How many of all texts have a letter, and in how many each dimension occurs; one vector a task."""

    def count(batches):
        total = np.zeros(dims + 1, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                if (v := ngram_counts(t.as_py(), dims)) is not None:
                    total[:dims] += v > 0
                    total[dims] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(total)], names=["dim", "n"])

    ship(texts.sparkSession)
    out = np.zeros(dims + 1, dtype=np.int64)
    for r in texts.select("text").mapInArrow(released(count), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        out[r["dim"]] = r["n"]
    return int(out[dims]), out[:dims]


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, dims: int = DIMENSIONS) -> dict:
    """Centroids of each language from (doc_id, text, lang) rows; rows with a null are left out.

    The rows of a language are thinned by a hash of the id to about ``sample``; one task a
    language clusters those. The driver gets a count a language, the document frequencies of
    all texts and the centroids. A language whose texts have no letter is not learned.
    """
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    none = {"langs": [], "of": np.zeros(0, int), "c": np.zeros((0, dims), np.float32), "idf": np.ones(dims, np.float32), "floor": np.zeros(0)}
    if not sizes:
        return none
    every, has = document_frequencies(rows, dims)
    idf = np.log((1 + every) / (1 + has)).astype(np.float32) + 1
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 40) * min(1.0, 1.5 * sample / n)))])
    spare = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0))
    picked = rows.withColumn("rank", rank).where(F.col("rank") < F.element_at(share, F.col("lang")))
    picked = picked.select("lang", "rank", "doc_id", F.substring("text", F.pmod(F.xxhash64("doc_id", "lang"), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text"))

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        counts = [v for v in (ngram_counts(t, dims) for t in group.column("text").to_pylist()) if v is not None][:sample]
        if not counts:
            return pa.table({"lang": pa.array([], pa.string()), "c": pa.array([], pa.binary()), "floor": pa.array([], pa.float64())})
        v = vectors(np.array(counts), idf)
        own = clusters(v, centroids)
        floor = REJECT_SHARE * float(np.quantile((v @ own.T).max(axis=1), 0.01))
        return pa.table({"lang": group.column("lang").slice(0, 1), "c": pa.array([own.tobytes()], pa.binary()), "floor": pa.array([floor])})

    found = sorted(tuple(r) for r in picked.groupBy("lang").applyInArrow(cluster, "lang string, c binary, floor double").collect())
    if not found:
        return none
    c = [np.frombuffer(x, dtype=np.float32).reshape(-1, dims) for _, x, _ in found]
    return {"langs": [lang for lang, _, _ in found], "of": np.repeat(np.arange(len(c)), [len(x) for x in c]), "c": np.concatenate(c), "idf": idf, "floor": np.array([f for _, _, f in found])}


def predictor(spark: SparkSession, model: dict):
    """A column function text -> struct(lang_pred, score, rejected).

    The model is a few centroids per language, of a fixed number of dimensions.
    """

    ship(spark)
    dims = model["c"].shape[1]

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(text: pa.Array) -> pa.Array:
        n = len(text)
        lang, score, bad = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
        for at in range(0, n, _ROWS):
            counts = [ngram_counts(t, dims) for t in text[at : at + _ROWS].to_pylist()]
            rows = [i for i, v in enumerate(counts) if v is not None]
            if not rows or not model["langs"]:
                continue
            near = vectors(np.array([counts[i] for i in rows]), model["idf"]) @ model["c"].T
            best = near.argmax(axis=1)
            for i, b, s in zip(rows, best, near.max(axis=1), strict=True):
                which = model["of"][b]
                lang[at + i], score[at + i], bad[at + i] = model["langs"][which], min(1.0, max(0.0, float(s))), s < model["floor"][which]
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(bad)], ["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, from its whole text alone.

    ``und``, score 0 and rejected if the text is null or has no letter, or if no language was
    learned. Otherwise the language of the centroid with the largest cosine, the first on a tie,
    rejected if it is farther from it than texts of that language are. A null id is not held out.
    Very long texts are counted in pieces, repeated rows each predicted, other columns ignored.
    """
    p = predictor(docs.sparkSession, model)
    out = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held_out"), p("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def train(docs: DataFrame, **kwargs) -> dict:
    """The model of the documents that are not held out."""
    return fit(docs.where(crc_mod(F.col("doc_id"), HELD_OUT) != 0), **kwargs)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of every document, trained on those that are not held out."""
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is rejected (no letters, or far from every language); a null lang is filled in.

    Other columns pass through whatever their names.
    """
    p = predictor(spark, train(docs))
    out = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], p("text").alias("p")).where("not p.rejected")
    return out.select(*[F.coalesce("in_lang", "p.lang_pred").alias(c) if c == "lang" else F.col(f"`in_{c}`").alias(c) for c in docs.columns])
