"""What several operators share: durable intermediate tables, exact global row numbers, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_folder, written

__all__ = ["ROW_BITS", "WORD", "alone", "batches", "column", "documents", "free", "met", "numbered", "row_mark", "shared_folder", "written"]

#: A word is a run of characters other than the six ASCII white-space characters (Java regex).
WORD = r"[^\x20\x09-\x0D]+"
#: Low 33 bits of monotonically_increasing_id() count the rows of one partition.
ROW_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, also where names hold dots."""
    return df[f"`{name}`"]


def free(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got, also where names are compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def row_mark(df: DataFrame, id_col: str = "doc_id") -> Column:
    """A string that only rows with equal values in all columns share: the id, and a hash of all columns."""
    cells = [F.to_json(F.struct(column(df, f.name).alias("x"))) if "map<" in f.dataType.simpleString() else column(df, f.name) for f in df.schema]
    own = column(df, id_col)
    return F.concat_ws(":", own.isNull().cast("string"), *[F.xxhash64(F.lit(seed), *[F.struct(c.isNull(), c) for c in cells]).cast("string") for seed in (1, 2)], F.coalesce(own.cast("string"), F.lit("")))


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """df with a gapless global row number from 0 in the given order.

    Rows are sorted by range; each partition numbers its own rows, and the counts of the
    partitions before it are added. No task holds more than one range, and only one count
    for each partition meets in one place. The table is written in between, as the numbers
    must not change when a task runs again.
    """
    spark, sorted_rows = df.sparkSession, df.repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    made = made.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)})
    counts, offset, offsets = made.groupBy("_part").count().orderBy("_part").collect(), 0, []
    for part, n in counts:  # one number for each partition
        offsets.append((part, offset))
        offset += n
    offsets = spark.createDataFrame(offsets, "_part long, _offset long")
    return made.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row")).drop("_id", "_part", "_row", "_offset")


#: Rows of one key that a join leaves together, and keys with more that are looked up by broadcast.
MOST_OF_A_KEY, MOST_HOT_KEYS = 512, 50_000


def met(rows: DataFrame, groups: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with groups, which has one row for each key and its number of rows, `members`.

    Rows of a key with more than MOST_OF_A_KEY are spread over parts by a hash of their column `by`, and
    the key's group row is repeated for each part. Only such keys are broadcast, and only if they are few;
    else the join is left to the engine's own handling of skew.
    """
    parts = F.ceil(F.col("members") / F.lit(MOST_OF_A_KEY)).cast("int")
    hot = groups.filter(F.col("members") > MOST_OF_A_KEY).select(key, parts.alias("_parts"))
    if not 0 < hot.count() <= MOST_HOT_KEYS:
        return rows.join(groups, key)
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(repeated, [key, "_part"]).drop("_part")


_HELD: dict[str, Callable[[], None]] = {}


def alone(name: str, free: Callable[[], None]) -> None:
    """Said by a task at its start: workers live on, so what tasks of other operators have left in this one is freed.

    free lets go of what this operator remembers between its tasks.
    """
    for other in [x for x in _HELD if x != name]:
        _HELD.pop(other)()
    _HELD[name] = free


def batches(frames: Iterator, most: int = 8 << 20) -> Iterator:
    """The record batches of mapInArrow cut so that each holds few bytes, and one row at least."""
    for batch in frames:
        n = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
