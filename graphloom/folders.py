"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that may be sent to the driver and all tasks.
SENT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new local one, which only a local master can share."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-graphloom-")
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read back: a lost executor repeats nothing above it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: they'd stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def beside(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as the smaller side of a join: sent to all tasks only if it is known to have few rows, else dealt by its keys.

    Spark goes by the size of files, and compressed keys take a hundredth of what they take in the driver's memory.
    """
    return F.broadcast(df) if rows is not None and rows <= SENT else df.hint("shuffle_hash")


def counted(df: DataFrame) -> DataFrame:
    """df written, and beside() by its number of rows."""
    rows = written(df)
    return beside(rows, rows.count())


def bucketed(df: DataFrame, key: str, path: str | None = None, buckets: int | None = None, once: bool = False) -> DataFrame:
    """df written in buckets of a column, in the shared folder if no path is given: joins on it need not move these rows. once: equal rows are one."""
    spark = df.sparkSession
    name = f"graphloom_{uuid.uuid4().hex}"
    n = buckets or min(1024, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Each task writes one bucket.
    rows = df.repartition(n, key)
    # Equal rows are in one task already, so they don't move again.
    rows = (rows.distinct() if once else rows).sortWithinPartitions(key)
    rows.write.format("parquet").option("compression", "zstd").option("path", path or f"{shared_folder(spark)}/{name}").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def bucketed_table(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table that bucketed() has written, in another session."""
    name = f"graphloom_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({schema}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    return spark.table(name)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    at, system = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(at):
        system.delete(at, False)
    if not system.rename(part, at):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    at, system = _path(spark, path)
    reader = system.open(at)
    try:
        return bytes(reader.readAllBytes()).decode()
    finally:
        reader.close()
