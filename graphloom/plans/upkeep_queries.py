"""Queries on embeddings, cached answers' upkeep, projects and source ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..folders import shared_folder
from ..operators import answers, explain, files, graph, providers, search
from ..operators.tables import AnswerStore
from ..sources import code
from ..sources import views as v
from ..sources.views import sql
from .file_queries import DEPS
from .file_queries import ORACLES as FILE_ORACLES
from .file_queries import internal_deps
from .search_queries import FUSED, hybrid_search


def list_projects(spark, d):
    return files.projects(v.files(spark, d), "SRC1")


def graph_meta(spark, d):
    return graph.meta(v.nodes(spark, d), v.edges(spark, d), 2, d).select("version", "node_count", "edge_count")


def _part_texts(spark, d):
    """Parts' nodes with their texts; those of one size have none."""
    n = v.nodes(spark, d).filter("kind = 2")
    text = t.node_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc"), F.col("path"))
    return n.select(F.col("id").alias("node_id"), F.when(F.col("param_count") == 50, "").otherwise(text).alias("text"))


def embed_nodes(spark, d):
    e = providers.embedded(_part_texts(spark, d))
    return e.select("node_id", "status", F.get("vector", F.lit(0)).alias("e1"), F.get("vector", F.lit(767)).alias("e768"))


def embed_stats(spark, d):
    return search.embedding_stats(providers.embedded(_part_texts(spark, d)))


def cache_store(spark, d):
    cache = v.cached(spark, d)
    return answers.stored(cache.filter("operation = 'click'"), cache.filter("operation = 'purchase'")).select("key", "operation", "event_id")


def cache_delete(spark, d):
    cache = v.cached(spark, d)
    left = answers.deleted(answers.cleared(cache, "click"), v.table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("key")))
    return left.select("key", "operation", "event_id")


def hit_links(spark, d):
    return search.linked(hybrid_search(spark, d).select("node_id", "score"), v.nodes(spark, d), v.edges(spark, d))


def source_context(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    nodes = docs.select(F.col("path").alias("id"), "path", F.lit(2).alias("kind"), F.lit(3).alias("line"), F.lit(4).alias("end_line"))
    return code.with_context(docs, nodes, 2).select("id", "source", "before", "after")


def _pages_of(spark, d):
    """Documents as files of code, and in each one symbol, on lines 2 to 3, that calls the next document's."""
    docs = v.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path, name = F.col("doc_id").cast("string"), F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    files_ = docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    nodes = docs.select(path.alias("id"), F.lit(2).alias("kind"), name.alias("name"), F.lit("").alias("signature"), F.lit("").alias("doc"), path.alias("path"), F.lit(2).alias("line"), F.lit(3).alias("end_line"))
    edges = docs.select(path.alias("src"), (F.col("doc_id") + 1).cast("string").alias("dst"), F.lit(1).alias("kind"))
    return files_, nodes, edges


def node_text_source(spark, d):
    files_, nodes, _ = _pages_of(spark, d)
    return explain.node_texts(nodes, files_)


def hit_snippets(spark, d):
    files_, nodes, _ = _pages_of(spark, d)
    hits = search.by_name(nodes, "s1", 20).select("node_id", "score")
    return explain.snippets(hits, nodes, files_)


def explain_symbols(spark, d):
    """Symbols whose source is in the store by an earlier run, those of every third document, and all the others."""
    files_, nodes, edges = _pages_of(spark, d)
    store, now = AnswerStore(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"), F.lit("2024-01-31 00:00:00").cast("timestamp")
    explain.explained(nodes.filter("cast(id as long) % 3 = 0"), files_, nodes, edges, store, now)
    return explain.explained(nodes, files_, nodes, edges, store, now)


def module_sources(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return code.module_source(v.files(spark, d).select("doc_id", "path").join(docs, "doc_id"), "src1/en").select("path", "source_hash")


def field_names(spark, d):
    """Fields of a type for each part."""
    p = v.table(spark, d, "part")
    block = F.concat(F.lit("{\n  // note\n  "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(": string,\n  "), "p_brand", F.lit("\tint\n  b"), F.col("p_size").cast("string"), F.lit(",\n\n}"))
    return p.select("p_partkey", F.array_join(t.field_names(F.regexp_replace(block, r"[{}]", "")), "|").alias("fields"))


def part_headers(spark, d):
    """The comments in front of a source file for each part."""
    p = v.table(spark, d, "part")
    text = F.concat(F.lit("// "), "p_name", F.lit("\n\n/* of\n  "), "p_brand", F.lit(" */\n\npackage x\n// later"))
    return p.select("p_partkey", code.file_header(text).alias("header"))


def api_names(spark, d):
    n = v.nodes(spark, d)
    return files.api_symbols(n.withColumn("exported", F.col("param_count") > 25))


def deps_totals(spark, d):
    """Dependencies between files, with the functions of orders and a type for each part."""
    functions = v.table(spark, d, "lineitem").select(F.col("l_orderkey"), (F.col("l_partkey") % 7).alias("f")).distinct()
    return files.dependency_totals(internal_deps(spark, d), functions, v.table(spark, d, "part").select("p_type").distinct())


def line_ranges(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", code.line_range(F.coalesce("text", F.lit("")), F.lit(2), F.lit(4)).alias("lines"))


TEXT = "'function: ' || name || chr(10) || 'Signature: ' || signature || chr(10) || 'Location: ' || path"
LINES = "string_split(coalesce(text, ''), chr(10))"
SOURCE = f"array_to_string({LINES}[2:3], chr(10))"
BASE = "'function: s' || doc_id || chr(10) || 'Location: ' || doc_id"
FENCE = "chr(10) || '```'"
ALL = {
    "node_text_source": (node_text_source, f"select doc_id::varchar as node_id, {BASE} || chr(10) || chr(10) || 'Code:' || {FENCE} || 'text' || chr(10) || case when length(s) > 1000 then left(s, 1000) || chr(10) || '// ... truncated' else s end || {FENCE} as text from (select doc_id, {SOURCE} as s from documents)"),
    "hit_snippets": (hit_snippets, f"select doc_id::varchar as node_id, score, case when length(s) > 500 then left(s, 500) || chr(10) || '// ...' else s end as snippet from (select doc_id, {SOURCE} as s, round(case when 's' || doc_id = 's1' then 1.0::double else 0.9::double end, 6) as score from documents where starts_with('s' || doc_id, 's1')) order by score desc, doc_id::varchar limit 20"),
    "explain_symbols": (explain_symbols, f"""with p as (select d.doc_id, s, substr(sha256(sha256(s) || ':explain:mock'), 1, 32) as key, length('Explain what this function does.') + length('Name: s' || d.doc_id) + length('File: ' || d.doc_id) + length(s) + length('```text') + length('```') + 6 + 2 + length('Describe the part that s' || d.doc_id || ' plays.') + length('Called by: ') + length('Calls: ') + 2
        + coalesce((select length('s' || e.doc_id) from documents e where e.doc_id = d.doc_id - 1), 0) + coalesce((select length('s' || e.doc_id) from documents e where e.doc_id = d.doc_id + 1), 0) as n from (select doc_id, {SOURCE} as s from documents) d),
      a as (select key, arg_min(n, doc_id::varchar) as n from p where doc_id % 3 = 0 group by key), b as (select key, arg_min(n, doc_id::varchar) as n from p group by key)
      select p.doc_id::varchar as node_id, p.key, 'A mock answer to ' || coalesce(a.n, b.n) || ' characters.' as response, a.key is not null as from_cache from p join b using (key) left join a using (key)"""),
    "module_sources": (module_sources, "select path, sha256(coalesce(text, '')) as source_hash from files_v join documents using (doc_id) where regexp_replace(path, '/[^/]*$', '') = 'src1/en'"),
    "field_names": (field_names, "select p_partkey, replace(p_name, ' ', '_') || '|' || p_brand || '|b' || p_size as fields from part"),
    "part_headers": (part_headers, "select p_partkey, '// ' || p_name || chr(10) || chr(10) || '/* of' || chr(10) || '  ' || p_brand || ' */' as header from part"),
    "api_names": (api_names, "select regexp_replace(path, '/[^/]*$', '') as package, case when kind in (2, 3) then 'function' else 'type' end as what, name, count(*) as n from nodes_v where param_count > 25 and kind in (2, 3, 4) group by all"),
    "deps_totals": (deps_totals, f"select count(*) as internal_deps, count(distinct path) as files_with_deps, count(distinct target) as targets, (select count(*) from (select distinct l_orderkey, l_partkey % 7 from lineitem)) as functions, (select count(distinct p_type) from part) as types from ({DEPS})"),
    "list_projects": (list_projects, f"select * from ({FILE_ORACLES['project_stats']}) where contains(lower(project), 'src1')"),
    "graph_meta": (graph_meta, "select 2 as version, (select count(*) from nodes_v) as node_count, (select count(*) from edges_v) as edge_count"),
    "embed_nodes": (embed_nodes, f"select id as node_id, case when param_count = 50 then 'skipped' else 'embedded' end as status, case when param_count <> 50 then ((a + b) % 1000) / 1000.0::double end as e1, case when param_count <> 50 then ((a + 768 * b) % 1000) / 1000.0::double end as e768 from (select id, param_count, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]) * (i - 1))) as bigint) as a, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]))) as bigint) as b from (select id, param_count, {TEXT} as s from nodes_v where kind = 2))"),
    "embed_stats": (embed_stats, "select case when param_count = 50 then 'skipped' else 'embedded' end as status, count(*) as n from nodes_v where kind = 2 group by 1"),
    "cache_store": (cache_store, "select key, operation, event_id from cache_v where operation = 'purchase' or (operation = 'click' and key not in (select key from cache_v where operation = 'purchase'))"),
    "cache_delete": (cache_delete, "select key, operation, event_id from cache_v where operation <> 'click' and key not in (select c_custkey from customer where c_nationkey < 5)"),
    "hit_links": (hit_links, f"select h.node_id, score, coalesce((select array_to_string(list_sort(list(distinct n.name))[1:5], ', ') from edges_v e join nodes_v n on n.id = e.src where e.kind = 1 and e.dst = h.node_id), '') as callers, coalesce((select array_to_string(list_sort(list(distinct n.name))[1:5], ', ') from edges_v e join nodes_v n on n.id = e.dst where e.kind = 1 and e.src = h.node_id), '') as callees from ({FUSED}) h"),
    "source_context": (source_context, f"select doc_id::varchar as id, array_to_string({LINES}[3:4], chr(10)) as source, array_to_string({LINES}[1:2], chr(10)) as before, array_to_string({LINES}[5:6], chr(10)) as after from documents"),
    "line_ranges": (line_ranges, f"select doc_id, array_to_string({LINES}[2:4], chr(10)) as lines from documents"),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: sql(s) for name, (_, s) in ALL.items()}
