"""Keeping a graph up to date: changed files arrive as a stream and replace what was known of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import hadoop_path

#: A row of the landing folder: an edge of a file, or a file without one (src null) that has lost its edges.
LANDED = "file string, version long, src string, dst string, kind string, weight long, source string, certainty string"


def merge_batch(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Known edges without those of the files in a batch, and the batch's rows of each file's last version.

    The last version's rows stay even where a file has no edge (src null), so
    that an older version that comes late does not bring edges back.
    """
    last = batch.unionByName(known).groupBy("file").agg(F.max("version").alias("version"))
    return known.unionByName(batch).join(last, ["file", "version"], "left_semi").distinct()


class EdgeTable:
    """A table in versions, on any file system: each batch writes a new one whole, and the last one that is complete counts.

    The last two versions stay, so that a reader of the one before can finish.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _versions(self) -> list[str]:
        fs, done = hadoop_path(self.spark, f"{self.folder}/v*/_SUCCESS")
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(done) or [])

    def current(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], LANDED)
        return self.spark.read.schema(LANDED).parquet(f"{self.folder}/{versions[-1]}")

    def edges(self) -> DataFrame:
        return self.current().where("src is not null")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merging is idempotent: a batch that is run again leaves the same rows."""
        versions = self._versions()
        following = int(versions[-1].split("-")[0][1:]) + 1 if versions else 0
        merge_batch(self.current(), batch).write.parquet(f"{self.folder}/v{following:012d}-{uuid.uuid4().hex[:8]}")
        for old in versions[:-1]:
            fs, path = hadoop_path(self.spark, f"{self.folder}/{old}")
            fs.delete(path, True)


def refresh(spark: SparkSession, landing: str, table: EdgeTable, checkpoint: str) -> StreamingQuery:
    """Takes in all that has landed since the last call."""
    stream = spark.readStream.schema(LANDED).parquet(landing)
    return stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by tumbling windows of event time, closed when the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
