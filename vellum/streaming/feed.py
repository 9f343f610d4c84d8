"""The change feed of (seq, ts, kind, shard, key, ver, deleted, value) events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import mvcc

KINDS = ("mutation", "compaction", "prune", "archive", "refusal")
SCHEMA = "seq bigint, ts timestamp, kind string, shard int, key string, ver string, deleted boolean, value string"


def kind_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def latest_state(log: DataFrame) -> DataFrame:
    """The live entries that the mutations lead to; a repeated delivery changes nothing."""
    return mvcc.latest(log.where("kind = 'mutation'").select("key", "ver", "deleted", "value").dropDuplicates(["key", "ver"]))


def lag_by_shard(log: DataFrame) -> DataFrame:
    """(shard, last_seq, lag): how far each shard's last event is behind the last of all."""
    last = log.groupBy("shard").agg(F.max("seq").alias("last_seq"))
    return last.withColumn("lag", F.max("last_seq").over(Window.partitionBy()) - F.col("last_seq"))  # a row a shard


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 100) -> DataFrame:
    """The feed as a stream of Parquet files, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


def sliding(events: DataFrame, size: str, step: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Stretches of a key's events that are less than a gap apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def once(events: DataFrame, late: str) -> DataFrame:
    """Each (key, ver) once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "ver"])


def replicate(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand each batch, with its number, to a sink that is idempotent by that number."""
    w = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")).start()


class ReplicaSink:
    """Keeps a replica as one folder a batch; a batch that is delivered again replaces itself."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.select("key", "ver", "deleted", "value").write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def state(self, spark: SparkSession) -> DataFrame:
        return mvcc.latest(spark.read.parquet(self.path).drop("batch").dropDuplicates(["key", "ver"]))
