"""What a symbol is and does: its source, who calls it and whom it calls, and a provider's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import written
from ..functions import prompts
from ..functions import text as t
from ..functions.fixed import NODE_KINDS
from ..sources import code
from . import providers, search
from .tables import AnswerStore


def with_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes(id, kind, name, signature, doc, path, line, end_line) with source, source_hash and language; null without a file or lines.

    files(path, content): of these only the files of the nodes are decoded.
    """
    return nodes.join(code.source_slice(files, nodes).dropDuplicates(["id"]), "id", "left")


def node_texts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """node_id, text of nodes, with their source where there is one."""
    own = t.node_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc"), F.col("path"))
    return with_source(nodes, files).select(F.col("id").alias("node_id"), t.with_code(own, F.col("language"), F.col("source")).alias("text"))


def snippets(results: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """results(node_id, ...) with snippet: the beginning of each hit's source, empty without one. The few results are the small side."""
    own = nodes.join(F.broadcast(results.select(F.col("node_id").alias("id"))), "id", "left_semi")
    found = with_source(own, files).select(F.col("id").alias("node_id"), t.snippet(F.col("source")).alias("snippet"))
    return results.join(found, "node_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def explained(nodes: DataFrame, files: DataFrame, nodes_all: DataFrame, edges: DataFrame, store: AnswerStore, now, provider=None, most: int = 5) -> DataFrame:
    """node_id, key, response, from_cache of nodes: an answer to a prompt with the source and the names around it.

    Answers in the store are taken from there, by the source, the operation and the model; new ones are put into it.
    """
    provider = provider or providers.Mock()
    around = search.linked(nodes.select(F.col("id").alias("node_id")), nodes_all, edges, most).withColumnRenamed("node_id", "id")
    both = with_source(nodes, files).join(around, "id")
    kind = F.element_at(F.array(*map(F.lit, NODE_KINDS)), F.col("kind") + 1)
    source = F.coalesce("source", F.lit(""))
    prompt = F.concat(prompts.explain(kind, F.col("name"), F.col("path"), F.coalesce("language", F.lit("text")), source), F.lit("\n\n"), prompts.called(F.col("name"), F.col("callers"), F.col("callees")))
    asked = written(both.select("id", t.cache_key(F.sha2(source, 256), F.lit("explain"), F.lit(provider.name)).alias("key"), F.sha2(source, 256).alias("content_hash"), prompt.alias("prompt")))
    # One prompt for each key: the first by id.
    first = asked.groupBy("key").agg(F.min_by(F.struct("content_hash", "prompt"), "id").alias("x")).select("key", "x.*")
    known = written(store.get(first, now))
    none = store.read(0).select("key", "response", "created_at")
    fresh = written(providers.answered(known.filter("not hit").select("content_hash", "prompt"), none, now, provider).select("key", "response"))
    store.set(fresh.filter("response is not null").select("key", F.lit("explain").alias("operation"), F.lit(provider.name).alias("model"), "response", now.cast("timestamp").alias("created_at"), t.text_tokens(F.col("response")).cast("long").alias("tokens")))
    answers = known.filter("hit").select("key", "response", F.lit(True).alias("from_cache")).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return asked.select(F.col("id").alias("node_id"), "key").join(answers, "key").select("node_id", "key", "response", "from_cache")
