"""Vector search, name search and their fusion by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import CALLS, FILE, NAME_WEIGHT, PACKAGE, RRF_K, VECTOR_WEIGHT


def nearest(vectors: DataFrame, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """node_id, score of the k nearest vectors by cosine; ties by id. Each task keeps k rows; none move but those.

    The query vector is a literal. An empty one, or one of another dimension, is an error.
    """
    if not query:
        raise ValueError("the query vector is empty")
    n = len(query)
    right = F.assert_true(F.size("vector") == n, f"vectors must have {n} dimensions")
    # Summed from left to right over literals: generated code without arrays in between.
    terms = [F.get("vector", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(query)]
    dot = sum(terms[1:], terms[0])
    own = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    length = sum(x * x for x in query) ** 0.5
    score = F.when((own == 0) | F.lit(length == 0), 0.0).otherwise(dot / F.nullif(own * length, F.lit(0.0)))
    return vectors.filter(right.isNull()).select("node_id", F.round(score, digits).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def by_name(nodes: DataFrame, query: str, limit: int, fuzzy: bool = True) -> DataFrame:
    """node_id, score, reason of the best name matches; files and packages are left out; ties by id."""
    if not query.strip():
        raise ValueError("the query is empty")
    match = t.match_score(F.col("name"), F.col("signature"), F.col("doc"), F.col("path"), query, fuzzy)
    rows = nodes.filter(~F.col("kind").isin(FILE, PACKAGE)).select(F.col("id").alias("node_id"), match.alias("m"))
    return rows.select("node_id", F.round("m.score", 6).alias("score"), F.col("m.reason").alias("reason")).filter("score > 0").orderBy(F.desc("score"), "node_id").limit(limit)


def ranked(hits: DataFrame) -> DataFrame:
    """hits (at most a branch limit of rows) with a rank from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")) - 1)


def fused(vector_hits: DataFrame, name_hits: DataFrame, limit: int, weights=(VECTOR_WEIGHT, NAME_WEIGHT), k: int = RRF_K) -> DataFrame:
    """node_id, score, reason: weighted reciprocal ranks of two ranked lists."""
    a = ranked(vector_hits).select("node_id", (F.lit(weights[0]) / (k + F.col("rank"))).alias("_a"))
    b = ranked(name_hits).select("node_id", (F.lit(weights[1]) / (k + F.col("rank"))).alias("_b"), F.concat("reason", F.lit(" name match")).alias("_why"))
    both = a.join(b, "node_id", "full_outer")
    score = F.round(F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)), 9)
    reason = F.concat_ws(", ", F.when(F.col("_a").isNotNull(), "semantic match"), F.col("_why"))
    return both.select("node_id", score.alias("score"), reason.alias("reason")).orderBy(F.desc("score"), "node_id").limit(limit)


def hybrid(nodes: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 10, mode: str = "hybrid") -> DataFrame:
    """Fused search. Each branch is cut at twice the limit before fusion; vectors without a node fall away."""
    hits = nearest(vectors, vector, 2 * limit) if mode != "graph" else None
    names = by_name(nodes, query, 2 * limit) if mode != "vector" else None
    if hits is not None:
        hits = hits.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    empty = nodes.filter(F.lit(False))
    hits = hits if hits is not None else empty.select(F.col("id").alias("node_id"), F.lit(0.0).alias("score"))
    names = names if names is not None else empty.select(F.col("id").alias("node_id"), F.lit(0.0).alias("score"), F.lit("").alias("reason"))
    return fused(hits, names, limit)


def expanded(results: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """results with the numbers of calls to and from each node. The few results are the small side of both joins."""
    calls = edges.filter(F.col("kind") == CALLS)
    ids = results.select(F.col("node_id").alias("id"))
    out = calls.join(ids, calls["src"] == ids["id"]).groupBy("id").agg(F.count("*").alias("callees"))
    into = calls.join(ids, calls["dst"] == ids["id"]).groupBy("id").agg(F.count("*").alias("callers"))
    both = results.withColumnRenamed("node_id", "id").join(out, "id", "left").join(into, "id", "left")
    named = both.join(nodes.select("id", "name", "path"), "id")
    return named.withColumns({"callers": F.coalesce("callers", F.lit(0)), "callees": F.coalesce("callees", F.lit(0))})


def upserted(vectors: DataFrame, updates: DataFrame, dimension: int) -> DataFrame:
    """vectors with updates put in place of those with their ids; another dimension is an error."""
    right = F.assert_true(F.size("vector") == dimension, f"vectors must have {dimension} dimensions").isNull()
    return vectors.join(updates.select("node_id"), "node_id", "left_anti").unionByName(updates.filter(right))


def pending(nodes: DataFrame, vectors: DataFrame, kinds: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Functions, methods and types that have no vector yet."""
    return nodes.filter(F.col("kind").isin(*kinds)).join(vectors.select(F.col("node_id").alias("id")), "id", "left_anti")


def linked(results: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """results(node_id, ...) with callers and callees: the first names of those that call a hit and that it calls.

    Only calls that touch a hit are looked at, and each task keeps `most` names of a hit.
    """
    ids = results.select(F.col("node_id").alias("hit"))
    calls, named = edges.filter(F.col("kind") == CALLS), nodes.select(F.col("id").alias("other"), "name")

    def names(here: str, there: str, label: str) -> DataFrame:
        ends = calls.select(F.col(here).alias("hit"), F.col(there).alias("other")).join(F.broadcast(ids), "hit").distinct().join(named, "other").select("hit", "name").distinct()
        first = ends.withColumn("_n", F.row_number().over(Window.partitionBy("hit").orderBy("name"))).filter(F.col("_n") <= most)
        return first.groupBy(F.col("hit").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(label))

    out = results.join(names("dst", "src", "callers"), "node_id", "left").join(names("src", "dst", "callees"), "node_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("callers", "callees")})


def embedding_stats(embedded: DataFrame) -> DataFrame:
    """status, n of embedded(node_id, vector, status)."""
    return embedded.groupBy("status").agg(F.count("*").alias("n"))
