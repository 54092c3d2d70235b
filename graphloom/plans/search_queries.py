"""Queries on vector and name search, their fusion, and cached answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers, search
from ..sources import views as v
from ..sources.views import sql

NOW, TTL = "2024-01-31 00:00:00", 7


def _query(spark, d):
    return v.vectors(spark, d).filter("node_id = 0").first()["vector"]


def _part_vectors(spark, d):
    """Vectors of parts: each vector belongs to the part with its number."""
    parts = v.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), t.node_id(F.concat(F.col("p_brand"), F.lit("/part_"), F.col("p_partkey").cast("string")), F.col("p_name")).alias("id"))
    return v.vectors(spark, d).join(parts, "node_id").select(F.col("id").alias("node_id"), "vector")


def vector_topk(spark, d):
    return search.nearest(v.vectors(spark, d), _query(spark, d), 10)


def cosine_by_label(spark, d):
    query = F.array(*[F.lit(float(x)) for x in _query(spark, d)])
    rows = v.vectors(spark, d).select("label", t.cosine(F.col("vector"), query).alias("score"))
    return rows.groupBy("label").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def name_search(spark, d):
    return search.by_name(v.nodes(spark, d), "widget red", 20)


def name_search_exact(spark, d):
    return search.by_name(v.nodes(spark, d), "red widget", 20, fuzzy=False)


def hybrid_search(spark, d):
    return search.hybrid(v.nodes(spark, d), _part_vectors(spark, d), "red widget", _query(spark, d), 10)


def search_expand(spark, d):
    return search.expanded(hybrid_search(spark, d), v.nodes(spark, d), v.edges(spark, d)).select("id", "score", "callers", "callees", "name")


def embed_pending(spark, d):
    return search.pending(v.nodes(spark, d), _part_vectors(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def vector_upsert(spark, d):
    own = v.vectors(spark, d).select("node_id", "vector")
    updates = own.filter("node_id >= 100").select("node_id", F.transform("vector", lambda x: -x).alias("vector"))
    return search.upserted(own, updates, 64).select("node_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", 64), 6).alias("last"))


def mock_embed(spark, d):
    """Three numbers of the deterministic embedding of each part's text."""
    p = v.table(spark, d, "part").select("p_partkey", t.mock_embedding(F.concat_ws(" ", "p_name", "p_brand")).alias("e"))
    return p.select("p_partkey", F.col("e")[0].alias("e1"), F.col("e")[1].alias("e2"), F.col("e")[767].alias("e768"))


def cache_lookup(spark, d):
    users = v.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return answers.looked_up(users, v.cached(spark, d), F.lit(NOW).cast("timestamp"), TTL)


def cache_stats(spark, d):
    return answers.hit_rate(cache_lookup(spark, d))


def cache_cleanup(spark, d):
    return answers.cleaned(v.cached(spark, d), F.lit(NOW).cast("timestamp"), TTL).select("key", "operation", "event_id")


COSINE = "list_cosine_similarity(vector, (select vector from vectors_v where node_id = 0))"
SCORES = """select id as node_id, round(case when lower(name) = 'widget red' then 1.0 when starts_with(lower(name), 'widget red') then 0.9 when contains(lower(name), 'widget red') then 0.7
  when hits * 0.5 / 6.0 > 0.1 then hits * 0.5 / 6.0 when contains(lower(path), 'widget red') then 0.4 else 0 end::double, 6) as score,
  case when lower(name) = 'widget red' then 'exact' when starts_with(lower(name), 'widget red') then 'prefix' when contains(lower(name), 'widget red') then 'contains' when hits * 0.5 / 6.0 > 0.1 then 'words' else 'path' end as reason
  from (select *, (contains(lower(name), 'widget'))::int + (contains(lower(name), 'red'))::int + (contains(signature, 'widget'))::int + (contains(signature, 'red'))::int as hits from nodes_v where kind not in (0, 1))"""
EXACT = "select id as node_id, round(case when lower(name) = 'red widget' then 1.0 when starts_with(lower(name), 'red widget') then 0.9 when {fuzzy} and contains(lower(name), 'red widget') then 0.7 when {fuzzy} and ((contains(lower(name), 'red'))::int + (contains(lower(name), 'widget'))::int + (contains(signature, 'red'))::int + (contains(signature, 'widget'))::int) / 12.0 > 0.1 then ((contains(lower(name), 'red'))::int + (contains(lower(name), 'widget'))::int + (contains(signature, 'red'))::int + (contains(signature, 'widget'))::int) / 12.0 when {fuzzy} and contains(lower(path), 'red widget') then 0.4 else 0 end::double, 6) as score, case when lower(name) = 'red widget' then 'exact' when starts_with(lower(name), 'red widget') then 'prefix' when contains(lower(name), 'red widget') then 'contains' when contains(lower(path), 'red widget') then 'path' else 'words' end as reason from nodes_v where kind not in (0, 1)"
FUSED = f"""select coalesce(a.node_id, b.node_id) as node_id, round(coalesce(0.6::double / (60 + a.r), 0) + coalesce(0.4::double / (60 + b.r), 0), 9) as score, concat_ws(', ', case when a.node_id is not null then 'semantic match' end, b.reason || ' name match') as reason
  from (select node_id, row_number() over (order by score desc, node_id) - 1 as r from (select id as node_id, round({COSINE}, 6) as score from vectors_v join part on p_partkey = node_id join nodes_v n on n.path = p_brand || '/part_' || p_partkey order by score desc, id limit 20)) a
  full join (select node_id, reason, row_number() over (order by score desc, node_id) - 1 as r from (select * from ({EXACT.format(fuzzy='true')}) where score > 0 order by score desc, node_id limit 20)) b on a.node_id = b.node_id order by score desc, node_id limit 10"""
ALL = {
    "vector_topk": (vector_topk, f"select node_id, round({COSINE}, 6) as score from vectors_v order by score desc, node_id limit 10"),
    "cosine_by_label": (cosine_by_label, f"select label, round(avg({COSINE}), 6) as mean, count(*) as n from vectors_v group by label"),
    "name_search": (name_search, f"select * from ({SCORES}) where score > 0 order by score desc, node_id limit 20"),
    "name_search_exact": (name_search_exact, f"select * from ({EXACT.format(fuzzy='false')}) where score > 0 order by score desc, node_id limit 20"),
    "hybrid_search": (hybrid_search, FUSED),
    "search_expand": (search_expand, f"select h.node_id as id, score, (select count(*) from edges_v where kind = 1 and dst = h.node_id) as callers, (select count(*) from edges_v where kind = 1 and src = h.node_id) as callees, n.name from ({FUSED}) h join nodes_v n on n.id = h.node_id"),
    "embed_pending": (embed_pending, "select kind, count(*) as n from nodes_v where kind in (2, 3, 4) and id not in (select id from nodes_v join part on path = p_brand || '/part_' || p_partkey join vectors_v on node_id = p_partkey) group by kind"),
    "vector_upsert": (vector_upsert, "select node_id, round(case when node_id >= 100 then -vector[1] else vector[1] end, 6) as first, round(case when node_id >= 100 then -vector[64] else vector[64] end, 6) as last from vectors_v"),
    "mock_embed": (mock_embed, "select p_partkey, ((a + b) % 1000) / 1000.0::double as e1, ((a + 2 * b) % 1000) / 1000.0::double as e2, ((a + 768 * b) % 1000) / 1000.0::double as e768 from (select p_partkey, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]) * (i - 1))) as bigint) as a, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]))) as bigint) as b from (select p_partkey, p_name || ' ' || p_brand as s from part))"),
    "cache_lookup": (cache_lookup, f"select c_custkey as key, c_custkey in (select key from cache_v where epoch(timestamp '{NOW}') - floor(epoch(created_at)) <= {TTL * 86400}) as hit from customer"),
    "cache_stats": (cache_stats, f"select hits, misses, round(hits / (hits + misses), 6) as hit_rate from (select count_if(hit) as hits, count_if(not hit) as misses from (select c_custkey in (select key from cache_v where epoch(timestamp '{NOW}') - floor(epoch(created_at)) <= {TTL * 86400}) as hit from customer))"),
    "cache_cleanup": (cache_cleanup, f"select key, operation, event_id from cache_v where epoch(timestamp '{NOW}') - floor(epoch(created_at)) <= {TTL * 86400}"),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: sql(s) for name, (_, s) in ALL.items()}
