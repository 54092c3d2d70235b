"""Tables that change by key: logs in a folder, merged when they are read.

Every write adds one version: rows by key, with a mark on those that are removed. The newest row of a key counts. A
version is there once its commit file is, so a write that fails or runs again leaves nothing behind; there is one
writer at a time. compact() and clear() begin a new base, before which nothing is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..folders import exists, read_text, shared_folder, write_text, written
from . import answers, search


class Keyed:
    """A table by key. schema: its columns, the key first. A put row replaces the one with its key; of put rows with one key one counts, a null key is an error."""

    def __init__(self, spark: SparkSession, schema: str, folder: str | None = None):
        self.spark, self.schema = spark, schema
        self.folder = folder or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.key = self.columns[0]

    def commit(self, n: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/commits/{n}.json"))

    def versions(self) -> int:
        n = 0
        while exists(self.spark, f"{self.folder}/commits/{n}.json"):
            n += 1
        return n

    def meta(self) -> dict:
        """What the newest commit says."""
        n = self.versions()
        return self.commit(n - 1) if n else {"base": 0}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as they are now, or as they were after so many versions."""
        n = self.versions() if version is None else version
        base = self.commit(n - 1)["base"] if n else 0
        paths = [p for k in range(base, n) if exists(self.spark, p := f"{self.folder}/rows/version={k}")]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        log = self.spark.read.schema(f"{self.schema}, gone boolean, version int").option("basePath", f"{self.folder}/rows").parquet(*paths)
        rest = F.struct(*self.columns[1:], "gone", "version")
        newest = log.groupBy(self.key).agg(F.max_by(rest, "version").alias("x")).filter("not x.gone")
        return newest.select(self.key, *[f"x.{c}" for c in self.columns[1:]])

    def _write(self, rows: DataFrame | None, **meta) -> None:
        n = self.versions()
        if rows is not None:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/rows/version={n}")
        write_text(self.spark, f"{self.folder}/commits/{n}.json", json.dumps(self.meta() | meta))

    def put(self, rows: DataFrame, **meta) -> None:
        key = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a key is null"))).otherwise(F.col(self.key)).alias(self.key)
        one = rows.select(key, *self.columns[1:]).groupBy(self.key).agg(F.max(F.struct(*self.columns[1:])).alias("x"))
        self._write(one.select(self.key, *[f"x.{c}" for c in self.columns[1:]], F.lit(False).alias("gone")), **meta)

    def drop(self, keys: DataFrame) -> None:
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in self.schema.split(", ")[1:]]
        self._write(keys.select(self.key).distinct().select(self.key, *none, F.lit(True).alias("gone")))

    def has(self, keys: DataFrame) -> DataFrame:
        """keys with a last column `there`."""
        own = self.read().select(self.key, F.lit(True).alias("there"))
        return keys.join(own, self.key, "left").withColumn("there", F.coalesce("there", F.lit(False)))

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        self._write(None, base=self.versions() + 1)

    def compact(self) -> None:
        """Begins a new base with the rows as they are."""
        self._write(self.read().withColumn("gone", F.lit(False)), base=self.versions())


class VectorTable(Keyed):
    """node_id, vector, text. All vectors have one dimension, that of the first; it stays when the table is cleared."""

    def __init__(self, spark: SparkSession, folder: str | None = None, dimension: int = 0):
        super().__init__(spark, "node_id string, vector array<double>, text string", folder)
        self._dimension = dimension

    def dimension(self) -> int:
        return self.meta().get("dimension", self._dimension)

    def add(self, rows: DataFrame) -> None:
        """Puts rows(node_id, vector, text). An empty vector, or one of another dimension, is an error, and nothing is written."""
        size = F.coalesce(F.size("vector"), F.lit(0))
        least, most = rows.agg(F.min(size), F.max(size)).first()
        if least is None:
            return
        expected = self.dimension() or most
        if least <= 0:
            raise ValueError("a vector is empty")
        if (least, most) != (expected, expected):
            raise ValueError(f"vectors must have {expected} dimensions, not {least if least != expected else most}")
        self.put(rows, dimension=expected)

    def remove(self, ids: DataFrame) -> None:
        """Takes out ids(node_id). One that isn't there is an error, and nothing is written."""
        missing = self.has(ids.select("node_id").distinct()).filter("not there").select("node_id").head(1)
        if missing:
            raise KeyError(missing[0][0])
        self.drop(ids)

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """node_id, score of the k nearest; none of an empty table."""
        if self.dimension() and query and len(query) != self.dimension():
            raise ValueError(f"the query must have {self.dimension()} dimensions")
        return search.nearest(self.read(), query, k)

    def save(self, folder: str) -> VectorTable:
        """The table as it is, in another folder."""
        out = VectorTable(self.spark, folder, self.dimension())
        out._write(self.read().withColumn("gone", F.lit(False)), base=out.versions(), dimension=self.dimension())
        return out


class AnswerStore(Keyed):
    """key, operation, model, response, created_at, tokens: answers of a provider, with a time to live and counters.

    The counters are this object's, as those of a process are.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, ttl_days: int = 0):
        super().__init__(spark, "key string, operation string, model string, response string, created_at timestamp, tokens long", folder)
        self.ttl_days, self.counts = ttl_days, dict.fromkeys(("hits", "misses", "writes", "evictions", "bytes"), 0)

    def get(self, requests: DataFrame, now) -> DataFrame:
        """requests(key) with response, created_at, tokens and hit. An answer that has expired is taken out and is a miss.

        Hits and misses are observed while the result is written; no second pass counts them.
        """
        own = self.read().select("key", "response", "created_at", "tokens", answers.live(F.col("created_at"), now, self.ttl_days).alias("_live"))
        both = requests.join(own, "key", "left").withColumn("hit", F.coalesce("_live", F.lit(False)))
        seen = Observation()
        both = both.observe(seen, F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if(~F.col("_live")).alias("expired"))
        out = written(both)
        self.counts["hits"] += seen.get["hits"]
        self.counts["misses"] += seen.get["misses"]
        if seen.get["expired"]:
            self.drop(out.filter("not _live").select("key"))
        good = [F.when(F.col("hit"), F.col(c)).alias(c) for c in ("response", "created_at", "tokens")]
        return out.select(*requests.columns, *good, "hit")

    def set(self, rows: DataFrame) -> None:
        """Puts answers; bytes counts their responses."""
        seen = Observation()
        self.put(rows.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("response")), F.lit(0)).alias("bytes")))
        self.counts["writes"] += seen.get["n"]
        self.counts["bytes"] += seen.get["bytes"]

    def delete(self, keys: DataFrame) -> None:
        keys = written(keys.select("key").distinct())
        self.drop(keys)
        self.counts["evictions"] += keys.count()

    def clean(self, now) -> None:
        """Takes out what has expired."""
        if self.ttl_days > 0:
            self.delete(self.read().filter(~answers.live(F.col("created_at"), now, self.ttl_days)))

    def clear(self) -> None:
        self.counts["evictions"] += self.count()
        self.counts["bytes"] = 0
        super().clear()

    def size(self) -> int:
        return self.count()

    def stats(self) -> dict[str, float]:
        looked = self.counts["hits"] + self.counts["misses"]
        return self.counts | {"hit_rate": self.counts["hits"] / looked if looked else 0.0}
