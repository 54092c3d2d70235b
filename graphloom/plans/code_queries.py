"""Queries that run the code readers, prompts and providers over texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as t
from ..operators import files, folds, providers, search
from ..sources import code
from ..sources import views as v
from ..sources.views import sql
from .search_queries import COSINE, EXACT, _part_vectors, _query


def _orders_as_code(spark, d):
    """A Python file for each order: a function for each part of it, which calls the supplier's."""
    item = v.table(spark, d, "lineitem")
    whole = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("all"))

    def body(x: Column) -> Column:
        return F.concat(F.lit("def f"), x["l_partkey"].cast("string"), F.lit("(a, b):\n    g"), x["l_suppkey"].cast("string"), F.lit("("), F.when(x["l_linenumber"] > 2, "x, y").otherwise(""), F.lit(")\n"))

    text = F.concat(F.lit("# order\nimport lib.o\n\n"), F.array_join(F.transform("all", body), "\n"))
    return whole.select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def _python(spark, d):
    return _orders_as_code(spark, d).select("path", F.lit("python").alias("language"), "text")


def extract_functions(spark, d):
    return code.facts(_python(spark, d), ("function",))["functions"].select("path", "name", "param_count", "signature", "exported")


def extract_calls(spark, d):
    return code.call_counts(_python(spark, d), "caller", "callee", "args")


def extract_imports(spark, d):
    return code.facts(_python(spark, d), ("import",))["imports"].groupBy("imp").agg(F.count("*").alias("n"))


def file_headers(spark, d):
    return _orders_as_code(spark, d).groupBy(code.file_header(F.col("text")).alias("header")).agg(F.count("*").alias("n"))


def manifest_deps(spark, d):
    """A go.mod for each host, with its pages as requirements."""
    url = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    pages = v.table(spark, d, "pages").select(F.split(url, "/")[0].alias("host"), url.alias("dep")).distinct()

    def line(at: int, dep: Column, text: Column) -> list[Column]:
        """A line at its place: files are made of lines, as a host's file can be too long for one row."""
        return [F.concat("host", F.lit("/go.mod")).alias("path"), F.lit("").alias("language"), F.struct(F.lit(at).alias("at"), dep.alias("dep")).alias("line"), text.alias("text")]

    hosts = pages.select("host").distinct()
    lines = pages.select(*line(4, F.col("dep"), F.concat(F.lit("\t"), F.col("dep"), F.lit(" v1"))))
    for at, text in enumerate(("module m", "", "require (", "\t// pages", None, ")", "require other v1", "")):
        if text is not None:
            lines = lines.unionByName(hosts.select(*line(at, F.lit(""), F.lit(text))))
    return code.manifests(lines).select("path", "language", "dep")


def diff_numstat(spark, d):
    """Order lines as a change list: quantity added, line number removed; returned ones count as binary."""
    item = v.table(spark, d, "lineitem")
    added = F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    text = F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), F.concat(F.lit("o "), F.col("l_orderkey").cast("string")))
    return code.numstat(item.select(text.alias("text"))).groupBy("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def source_slices(spark, d):
    """Lines 2 and 3 of each document, as a symbol's source."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    nodes = docs.select(F.col("path").alias("id"), F.lit(2).alias("kind"), "path", F.lit(2).alias("line"), F.lit(3).alias("end_line"))
    return code.source_slice(docs, nodes).select("id", "source_hash", "language")


def explain_prompts(spark, d):
    docs = v.table(spark, d, "documents")
    prompt = prompts.explain(F.lit("file"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("source"), F.col("lang"), F.col("text"))
    return docs.select("doc_id", F.sha2(prompt, 256).alias("prompt_hash"))


def summarize_prompts(spark, d):
    docs = v.table(spark, d, "documents")
    hashed = folds.joined_hash(docs, F.col("source"), F.col("doc_id"), prompts.section(F.col("lang"), F.col("text")), prompts.summary_head(F.col("key")), prompts.BETWEEN, "")
    return hashed.select(F.col("key").alias("source"), F.col("hash").alias("prompt_hash"))


def explain_answers(spark, d):
    """Each text is asked about once; those of labelled documents are in the cache."""
    docs = v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("text").alias("prompt"))
    key = t.cache_key(F.col("content_hash"), F.lit("explain"), F.lit("mock"))
    cache = docs.join(v.table(spark, d, "labels").select("doc_id"), "doc_id").select(key.alias("key"), F.lit("kept").alias("response"), F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"))
    return providers.answered(docs, cache, F.lit("2024-01-31 00:00:00").cast("timestamp"), ttl_days=7)


def skyline_order(spark, d):
    return files.arranged(files.skyline(v.files(spark, d))).select("label", "height", "seat")


def methods_by_type(spark, d):
    part = v.table(spark, d, "part")
    path = F.concat(F.col("p_brand"), F.lit("/part_"), F.col("p_partkey").cast("string"))
    methods = part.select(path.alias("path"), F.lit(3).alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("(x *"), F.col("p_type"), F.lit(")")).alias("receiver"), (F.col("p_size") > 10).alias("exported"))
    types = part.select(path.alias("path"), F.lit(4).alias("kind"), F.col("p_type").alias("name"), F.lit("").alias("receiver"), (F.col("p_size") > 45).alias("exported"))
    return files.methods(methods.unionByName(types))


def function_json(spark, d):
    part = v.table(spark, d, "part")
    sign = F.when(F.col("p_size") > 25, F.concat(F.lit("func "), F.col("p_name"))).otherwise("")
    json = t.function_json(F.col("p_name"), sign, F.lit(""), F.col("p_size") > 40, F.lit(0))
    return part.select("p_partkey", json.alias("json"), t.function_name(json).alias("name"))


def semantic_search(spark, d):
    return search.hybrid(v.nodes(spark, d), _part_vectors(spark, d), "red widget", _query(spark, d), 10, mode="vector")


def name_only_search(spark, d):
    return search.hybrid(v.nodes(spark, d), _part_vectors(spark, d), "red widget", _query(spark, d), 10, mode="graph")


ALL = {
    "extract_functions": (extract_functions, "select distinct 'orders/o' || l_orderkey || '.py' as path, 'f' || l_partkey as name, 2 as param_count, 'def f' || l_partkey || '(a, b)' as signature, true as exported from lineitem"),
    "extract_calls": (extract_calls, "select 'orders/o' || l_orderkey || '.py' as path, 'f' || l_partkey as caller, 'g' || l_suppkey as callee, case when l_linenumber > 2 then 2 else 0 end as args, count(*) as n from lineitem group by all"),
    "extract_imports": (extract_imports, "select 'lib.o' as imp, count(distinct l_orderkey) as n from lineitem"),
    "file_headers": (file_headers, "select '# order' as header, count(distinct l_orderkey) as n from lineitem"),
    "manifest_deps": (manifest_deps, "select min(split_part(dep, '/', 1)) || '/go.mod' as path, 'go' as language, dep from (select distinct regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as dep from pages) group by dep"),
    "diff_numstat": (diff_numstat, "select 'o ' || l_orderkey as path, sum(case when l_returnflag = 'R' then 0 else floor(l_quantity) end)::bigint as added, sum(l_linenumber)::bigint as removed from lineitem group by l_orderkey"),
    "source_slices": (source_slices, "select doc_id::varchar as id, sha256(array_to_string(string_split(text, chr(10))[2:3], chr(10))) as source_hash, 'text' as language from documents"),
    "explain_prompts": (explain_prompts, "select doc_id, sha256('Explain what this file does.' || chr(10) || 'Name: doc_' || doc_id || chr(10) || 'File: ' || source || chr(10) || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```') as prompt_hash from documents"),
    "summarize_prompts": (summarize_prompts, "select source, sha256('Summarize the module ' || source || '.' || chr(10) || chr(10) || string_agg('## ' || lang || chr(10) || array_to_string(string_split(text, chr(10))[1:100], chr(10)), chr(10) || chr(10) order by doc_id)) as prompt_hash from documents group by source"),
    "explain_answers": (explain_answers, "select substr(sha256(sha256(text) || ':explain:mock'), 1, 32) as key, case when bool_or(doc_id in (select doc_id from labels)) then 'kept' else 'A mock answer to ' || length(text) || ' characters.' end as response, bool_or(doc_id in (select doc_id from labels)) as from_cache from documents group by text"),
    "skyline_order": (skyline_order, "select label, height, cast(case when r % 2 = 0 then r // 2 else -((r + 1) // 2) end as int) as seat from (select *, row_number() over (order by height desc, label) - 1 as r from (select label, cast(2 + floor(sqrt((size - min(size) over ()) / case when max(size) over () = min(size) over () then 1.0 else max(size) over () - min(size) over () end) * 10) as int) as height from (select ext as label, sum(size)::bigint as size from files_v group by 1)))"),
    "methods_by_type": (methods_by_type, "select p_brand as package, p_type as type, count_if(p_size > 10) as methods from part where (p_brand, p_type) in (select (p_brand, p_type) from part where p_size > 45) group by all"),
    "function_json": (function_json, """select p_partkey, case when p_size <= 25 then '"' || p_name || '"' else '{"name":"' || p_name || '","signature":"func ' || p_name || '"' || case when p_size > 40 then ',"is_exported":true' else '' end || '}' end as json, p_name as name from part"""),
    "semantic_search": (semantic_search, f"select node_id, round(0.6::double / (59 + row_number() over (order by score desc, node_id)), 9) as score, 'semantic match' as reason from (select id as node_id, round({COSINE}, 6) as score from vectors_v join part on p_partkey = node_id join nodes_v n on n.path = p_brand || '/part_' || p_partkey order by score desc, id limit 10)"),
    "name_only_search": (name_only_search, f"select node_id, round(0.4::double / (59 + row_number() over (order by score desc, node_id)), 9) as score, reason || ' name match' as reason from ({EXACT.format(fuzzy='true')}) where score > 0 order by score desc, node_id limit 10"),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: sql(s) for name, (_, s) in ALL.items()}
