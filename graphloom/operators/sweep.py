"""Which of a file's ranges holds each line: one sorted pass, without the product of lines and ranges.

Places (path, line) are dealt to shards at splitters, so that a file with very many lines is the work of several
tasks. A range goes to every shard that it reaches into. A task walks its places in order with a heap of open
ranges; it holds as many rows as there are ranges open at once. Splitters are places at equal ranks of a
sample and decide only how even the shards are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sampled places for each splitter.
SAMPLED = 32


class Reversed:
    """A name that sorts the other way round; null is the least of all."""

    __slots__ = ("name",)

    def __init__(self, name: str | None):
        self.name = name

    def __lt__(self, other: Reversed) -> bool:
        return (self.name is not None, self.name or "") > (other.name is not None, other.name or "")


def splitters(places: DataFrame, shards: int) -> list[tuple[str, int]]:
    """Up to shards - 1 of places(path, line), at about equal ranks."""
    n = places.count()
    if n == 0 or shards < 2:
        return []
    every = max(1, n // (SAMPLED * shards))
    some = places.select("path", "line").withColumn("_key", F.xxhash64("path", "line", F.monotonically_increasing_id())).filter(F.pmod("_key", F.lit(every)) == 0)
    rank = F.ntile(shards).over(Window.orderBy("path", "line"))  # over the sample
    cut = some.withColumn("_of", rank).groupBy("_of").agg(F.min(F.struct("path", "line")).alias("x")).select("x.*").distinct().orderBy("path", "line").collect()
    return [(r.path, r.line) for r in cut[1:]]


def containing(calls: DataFrame, ranges: DataFrame, shards: int | None = None) -> DataFrame:
    """calls(path, call_line, ...) with caller: the name of the last, by ord, of ranges(path, ord, name, start_line, end_line) that holds the line.

    Lines that no range holds have no caller (null); of ranges with one ord the greater name counts. Null paths and
    lines are held by nothing; ranges whose end is before their start hold nothing.
    """
    spark = calls.sparkSession
    ranges = ranges.filter("path is not null and start_line <= end_line and ord is not null")
    row = F.struct(*[F.col(f"`{c}`") for c in calls.columns])
    none = F.lit(None)
    one = calls.select(F.col("path"), F.col("call_line").cast("long").alias("line"), none.cast("long").alias("end"), none.cast("long").alias("ord"), none.cast("string").alias("name"), row.alias("row"))
    two = ranges.select("path", F.col("start_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end"), F.col("ord").cast("long").alias("ord"), "name", none.cast(one.schema["row"].dataType).alias("row"))
    held = one.filter("path is not null and line is not null")
    cuts = splitters(held.select("path", "line").unionByName(two.select("path", "line")), shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(cuts)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            paths, lines, ends = (batch.column(i).to_pylist() for i in range(3))
            at, shard = [], []
            for i, (path, line, end) in enumerate(zip(paths, lines, ends, strict=True)):
                first = bisect_right(shared.value, (path, line))
                for k in range(first, (first if end is None else bisect_right(shared.value, (path, end))) + 1):
                    at.append(i)
                    shard.append(k)
            yield pa.record_batch([*batch.take(pa.array(at, pa.int64())).columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, []
        for batch in frames:
            shards_, paths, lines, ends, ords, names = (batch.column(i).to_pylist() for i in range(6))
            keep, callers = [], []
            for i, place in enumerate(zip(shards_, paths, strict=True)):
                if place != here:
                    here, open_ = place, []
                if ends[i] is not None:
                    heappush(open_, (-ords[i], Reversed(names[i]), ends[i]))
                    continue
                while open_ and open_[0][2] < lines[i]:
                    heappop(open_)
                keep.append(i)
                callers.append(open_[0][1].name if open_ else None)
            rows = batch.column(6).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows, pa.array(callers, pa.string())], ["row", "caller"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema if f.name != "row")
    kind = one.schema["row"].dataType.simpleString()
    dealt = held.unionByName(two).mapInArrow(deal, f"{kinds}, row {kind}, shard int")
    # Ranges that begin at a line come before its calls.
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "path", "line", F.col("end").isNull(), "ord")
    found = ordered.select("shard", "path", "line", "end", "ord", "name", "row").mapInArrow(walk, f"row {kind}, caller string")
    lost = one.filter("path is null or line is null").select("row", none.cast("string").alias("caller"))
    return found.unionByName(lost).select("row.*", "caller")
