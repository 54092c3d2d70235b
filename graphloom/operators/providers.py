"""Completions and embeddings by a provider, with cached answers in front.

A provider is an object with complete(prompt) and embed(text) that can be sent to tasks; the mock one
answers from its input alone. Requests that the cache answers never reach it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import batches
from ..folders import written
from ..functions import text as t
from ..functions.fixed import EMBEDDING_SIZE
from .answers import live
from .search import pending
from .tables import VectorTable


class Mock:
    name = "mock"

    def complete(self, prompt: str) -> str:
        return f"A mock answer to {len(prompt)} characters."

    def embed(self, text: str) -> list[float]:
        """The numbers of functions.text.mock_embedding."""
        sizes = [len(c.encode()) for c in text]
        at = [0, *accumulate(sizes)]
        a, b = sum(ord(c) * k for c, k in zip(text, at, strict=False)), sum(map(ord, text))
        return [(a + i * b) % 1000 / 1000.0 for i in range(1, EMBEDDING_SIZE + 1)]


def retried(call, value: str, retries: int = 3, wait: float = 1.0):
    """The call's result; after a failure it waits 1, 2, 4... times `wait` seconds. None after the last retry."""
    for n in range(retries + 1):
        try:
            return call(value)
        except Exception:  # whatever a provider raises
            if n < retries:
                time.sleep(wait * 2**n)
    return None


def answered(requests: DataFrame, cache: DataFrame, now, provider=None, operation: str = "explain", ttl_days: int = 0) -> DataFrame:
    """key, response, from_cache of requests(content_hash, prompt); keys name the model that is asked."""
    provider = provider or Mock()
    keyed = requests.withColumn("key", t.cache_key(F.col("content_hash"), F.lit(operation), F.lit(provider.name))).select("key", "prompt").dropDuplicates(["key"])
    good = cache.filter(live(F.col("created_at"), now, ttl_days)).groupBy("key").agg(F.max_by("response", "created_at").alias("response"))
    hits = keyed.join(good, "key").select("key", "response", F.lit(True).alias("from_cache"))

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = [retried(provider.complete, p.as_py()) for p in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string()), pa.array([False] * len(found))], ["key", "response", "from_cache"])

    return hits.unionByName(keyed.join(good, "key", "left_anti").select("key", "prompt").mapInArrow(ask, "key string, response string, from_cache boolean"))


def embedded(texts: DataFrame, provider=None, wait: float = 1.0, retries: int = 3) -> DataFrame:
    """node_id, vector, status of texts(node_id, text): embedded, skipped where the text is empty, or failed after all retries."""
    provider = provider or Mock()
    kind = texts.schema["node_id"].dataType.simpleString()

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 1 << 20):
            found = [retried(provider.embed, x.as_py(), retries, wait) for x in batch.column(1)]
            status = ["failed" if v is None else "embedded" for v in found]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.float64())), pa.array(status, pa.string())], ["node_id", "vector", "status"])

    some = F.coalesce(F.col("text") != "", F.lit(False))
    skipped = texts.filter(~some).select("node_id", F.lit(None).cast("array<double>").alias("vector"), F.lit("skipped").alias("status"))
    return texts.filter(some).select("node_id", "text").mapInArrow(ask, f"node_id {kind}, vector array<double>, status string").unionByName(skipped)


def embed_graph(nodes: DataFrame, table: VectorTable, provider=None, parts: int = 8, skip_existing: bool = True, wait: float = 1.0, retries: int = 3) -> dict[str, int]:
    """Embeds the functions, methods and types of nodes(id, kind, name, signature, doc, path) into a table; counts by status, and in all.

    Nodes are dealt to parts by a hash of their ids, and each part is one version of the table. A run that ends early
    has kept the parts before; the next one finds their vectors there and asks for the others only. Nodes
    that failed are asked for again by the next run.
    """
    text = t.node_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc"), F.col("path"))
    todo = pending(nodes, table.read()) if skip_existing else nodes.filter(F.col("kind").isin(2, 3, 4))
    todo = written(todo.select(F.col("id").alias("node_id"), text.alias("text"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")))
    out = {"embedded": 0, "skipped": 0, "failed": 0}
    for part in [r[0] for r in todo.select("part").distinct().orderBy("part").collect()]:
        own = todo.filter(F.col("part") == part).select("node_id", "text")
        found = written(embedded(own, provider, wait, retries))
        for r in found.groupBy("status").count().collect():
            out[r["status"]] += r["count"]
        table.add(found.filter("status = 'embedded'").join(own, "node_id").select("node_id", "vector", "text"))
    return out | {"total": sum(out.values())}
