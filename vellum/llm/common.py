"""Shared pieces of the text operators: shared-folder tables, keys of documents, word splitting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where an order is needed: before every other id.
NULL_ID = -(2**63)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where a local session names none (tests, a laptop)
    a temporary one is made and set. On a cluster that is an error: its machines share no
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{scratch_root(spark)}/vellum/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: whatever reads the result does not recompute ``df``, and it survives the
    loss of any executor. ``free`` lets the driver collect its garbage then: Spark keeps the
    shuffle files of finished jobs until it does, which in a long-running driver can be hours.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    few = "spark.sql.adaptive.coalescePartitions.parallelismFirst"  # files of the advisory size, not one a core
    before = spark.conf.get(few)
    spark.conf.set(few, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(few, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    if free:
        spark._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, when nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._vellum_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch. Texts are long: the usual 10,000 of them would be tens of MB, several
#: times over in a worker.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that have no copy of the repository.

    Also lowers the session's limit of rows in an Arrow batch to BATCH_ROWS, if it is higher.
    """
    sc, limit = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, BATCH_ROWS)
    if getattr(sc, "_vellum_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="vellum-code-"), "vellum_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(archive)
    sc._vellum_shipped = True


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine: allocators keep it, and workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(each: Callable) -> Callable:
    """A function of batches that gives its memory back when its partition is done."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            release()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, th: str | None = None) -> DataFrame:
    """``dk`` (doc_id, null first) and ``th`` (64-bit hash of the text, or a column) identify a document.

    Rows that agree in both are one document that is listed twice: they get the same result.
    """
    text_hash = F.col(th) if th else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "th": text_hash})


#: Bits that a bitmap of hashes has at most (16 MB).
BITMAP_MOST = 1 << 27


def bitmap(hashes: DataFrame, n: int, share: int) -> np.ndarray:
    """A bitmap of the ``n`` 64-bit values in the one column of ``hashes``: two bits a value, ``share`` bits for each.

    It grows with n up to BITMAP_MOST; beyond that a fuller one only lets more through.
    """
    bits = min(BITMAP_MOST, 1 << max(16, (share * n).bit_length()))
    h = F.col(hashes.columns[0])
    places = [F.shiftrightunsigned(h, 64 - bits.bit_length() + 1), h.bitwiseAND(F.lit(bits - 1))]
    words = hashes.select(F.explode(F.array(*places)).alias("i")).groupBy(F.shiftright("i", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("bits"))
    out, words = np.zeros(bits >> 6, dtype=np.int64), words.toArrow()
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def passing(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose two bits are set in the bitmap ``seen``."""
    bits = len(seen) * 8
    at = np.arange(len(h))
    for i in (lambda x: x >> np.uint64(64 - bits.bit_length() + 1), lambda x: x & np.uint64(bits - 1)):
        place = i(h[at]).astype(np.int64)
        at = at[(seen[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
    return at


#: Bits of a bitmap for each document that possibly_in() is about: it lets 2 in 100 others through.
POSSIBLE_BITS = 16


def possibly_in(keys: DataFrame) -> Column:
    """Whether a row's (dk, th) may be among those of ``keys``; false only where it is not.

    It keeps long rows from the shuffle of a join that would drop them. Beyond some 10 million
    keys it lets more and more through, and the join gets what it would get without.
    """
    spark = keys.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("dk", "th").alias("h")), keys.count(), POSSIBLE_BITS))

    @F.arrow_udf("boolean")
    def seen(h: pa.Array) -> pa.Array:
        out = np.zeros(len(h), dtype=bool)
        out[passing(h.to_numpy(zero_copy_only=False).view(np.uint64), sent.value)] = True
        return pa.array(out)

    return seen(F.xxhash64("dk", "th"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one aggregate; only the sum comes to the driver)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 of an Arrow string column, without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


class Words(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``most`` words."""

    def __init__(self, seed: int, most: int = 200_000):
        from xxhash import xxh64_intdigest

        self.seed, self.most, self.digest = seed, most, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
