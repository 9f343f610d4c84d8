"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result
is a table in the shared folder before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontaminate, langid, linededup, simhash
from vellum.llm.common import discard, documents, materialise

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: SQL can't express centroids, fingerprints or merges; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents that all stages keep, from the whole documents table; stages say what nulls and repeats give.

    A stage's table is deleted once the next one's is written.
    """
    docs, done = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name, free=True)
        if done is not None:
            discard(done)
        done = docs
    return docs
