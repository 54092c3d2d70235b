"""An index that follows a folder of change events (an addition: batch runs do the same work at once).

Each batch of (path, content, mtime) rows replaces the stored lines of its paths. Batches are written under
their own number, so one that runs again after a failure overwrites itself, and the newest row of a path
counts when the index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators.index import Index

SCHEMA = "path string, content string, mtime timestamp"


def follow(spark: SparkSession, source: str, index: str, checkpoint: str) -> StreamingQuery:
    """Runs over all changes that are there, then ends."""

    def store(batch: DataFrame, number: int) -> None:
        batch.groupBy("path").agg(F.max_by("content", "mtime").alias("content"), F.max("mtime").alias("mtime")).write.mode("overwrite").parquet(f"{index}/batch={number}")

    events = spark.readStream.schema(SCHEMA).parquet(source)
    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """path, content, mtime: the newest state of each path."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(index)
    newest = F.max_by(F.struct("content", "mtime"), F.struct("mtime", "batch"))
    return rows.groupBy("path").agg(newest.alias("x")).select("path", "x.content", "x.mtime")


def follow_code(spark: SparkSession, source: str, index: Index, checkpoint: str) -> StreamingQuery:
    """Keeps a code index up to date with change events; content null is a file that is gone. A batch that runs again changes nothing."""

    def update(batch: DataFrame, number: int) -> None:
        # A struct: the last event may be that the file is gone, and a null alone would be passed over.
        last = batch.groupBy("path").agg(F.max_by(F.struct("content"), "mtime").alias("x")).select("path", F.col("x.content").alias("text"))
        index.change(last.select("path", t.language(F.col("path")).alias("language"), "text"))

    events = spark.readStream.schema(SCHEMA).parquet(source)
    return events.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
