"""Queries on the property graph, its traversal and its upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import beside, passing, written
from ..functions import text as t
from ..functions.fixed import CALLS, EDGE_KINDS, FUNCTION, METHOD, NODE_KINDS
from ..operators import files as file_ops
from ..operators import graph
from ..sources import views as v
from ..sources.views import sql


def _named(kind, names):
    return F.element_at(F.array(*map(F.lit, names)), kind + 1)


def graph_stats(spark, d):
    return graph.stats(v.nodes(spark, d), v.edges(spark, d))


def nodes_by_kind(spark, d):
    return v.nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n")).select(_named(F.col("kind"), NODE_KINDS).alias("kind"), "n")


def edges_by_kind(spark, d):
    return v.edges(spark, d).groupBy("kind").agg(F.count("*").alias("n")).select(_named(F.col("kind"), EDGE_KINDS).alias("kind"), "n")


def node_ids(spark, d):
    return v.nodes(spark, d).select("id", "path", "name")


def node_text(spark, d):
    n = v.nodes(spark, d)
    return n.select("id", t.node_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc"), F.col("path")).alias("text"))


def find_nodes(spark, d):
    return graph.find(v.nodes(spark, d), "RED widget", (FUNCTION, METHOD)).select("id", "name", "path")


def symbol_search(spark, d):
    return file_ops.symbols(v.nodes(spark, d), "ring", "function", "Brand#1").select("path", "name")


def symbol_counts(spark, d):
    hits = file_ops.symbols(v.nodes(spark, d), "o")
    return hits.agg(F.count_if(F.col("kind").isin(FUNCTION, METHOD)).alias("functions"), F.count_if(F.col("kind") == 4).alias("types"))


def exported_names(spark, d):
    n = v.nodes(spark, d).filter(F.col("kind").isin(0, 2))
    return n.select("id", t.is_exported(F.col("name"), F.lit("go")).alias("go"), t.is_exported(F.col("name"), F.lit("python")).alias("python"))


def receiver_type(spark, d):
    p = v.table(spark, d, "part")
    receiver = F.concat(F.lit("(r *"), F.col("p_type"), F.lit(")"))
    params = F.concat(F.lit("(a map["), F.col("p_brand"), F.lit(", int], b "), F.col("p_type"), F.when(F.col("p_size") > 25, ", c ...int").otherwise(""), F.lit(")"))
    return p.select("p_partkey", t.receiver_type(receiver).alias("receiver"), t.count_params(params).alias("params"), t.count_args(params).alias("args"), t.signature(F.lit("go"), F.lit("F"), params, receiver).alias("signature"))


def outgoing(spark, d):
    nodes = v.nodes(spark, d)
    return graph.neighbours(graph.find(nodes, "NATION_1"), nodes, v.edges(spark, d))


def incoming(spark, d):
    nodes = v.nodes(spark, d)
    return graph.neighbours(graph.find(nodes, "supplier_1"), nodes, v.edges(spark, d), outgoing=False)


def callees_1hop(spark, d):
    nodes = v.nodes(spark, d)
    return graph.neighbours(graph.find(nodes, "orders/order_1"), nodes, v.edges(spark, d), kinds=(CALLS,)).groupBy("seed_name", "name").agg(F.count("*").alias("calls"))


def callers_1hop(spark, d):
    nodes = v.nodes(spark, d)
    return graph.neighbours(graph.find(nodes, "red widget"), nodes, v.edges(spark, d), outgoing=False, kinds=(CALLS,)).groupBy("id").agg(F.count("*").alias("calls"))


def filter_calls(spark, d):
    return graph.filter_calls(v.edges(spark, d), v.nodes(spark, d)).groupBy("kind", "arg_count").agg(F.count("*").alias("n"))


def filter_calls_imported(spark, d):
    """Parts as files of their brands: an order line that names a brand imports it, and calls stay where counts and imports agree."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    parts = v.table(spark, d, "part").select("p_partkey", F.concat(brand, F.lit("/part_"), F.col("p_partkey").cast("string")).alias("path"), brand.alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    src = parts.select(F.col("p_partkey").alias("src"), F.col("brand").alias("from_brand"), F.col("name").alias("caller"))
    dst = parts.select(F.col("p_partkey").alias("dst"), "brand", F.col("name").alias("callee"))
    with passing(spark):  # names and keys are short, ids are not: they are made of the written rows
        ends = written(v.copurchases(spark, d).join(beside(src), "src").join(beside(dst), "dst"))

    def path(brand: str, key: str):
        return F.concat(F.col(brand), F.lit("/part_"), F.col(key).cast("string"))

    none = F.lit("")
    files = parts.select(t.node_id(F.col("path"), none).alias("id"), F.lit(0).alias("kind"), t.base(F.col("path")).alias("name"), "path", F.lit(0).alias("param_count"))
    functions = parts.select(t.node_id(F.col("path"), F.col("name")).alias("id"), F.lit(2).alias("kind"), "name", "path", (F.col("size") % 8).alias("param_count"))
    packages = parts.select("brand").distinct().select(t.node_id(F.col("brand"), none).alias("id"), F.lit(1).alias("kind"), F.col("brand").alias("name"), F.col("brand").alias("path"), F.lit(0).alias("param_count"))
    nodes = files.unionByName(functions).unionByName(packages)
    calls = ends.select(t.node_id(path("from_brand", "src"), F.col("caller")).alias("src"), t.node_id(path("brand", "dst"), F.col("callee")).alias("dst"), F.lit(1).alias("kind"), F.col("line").alias("arg_count"))
    imports = ends.filter("line = 1").select(t.node_id(path("from_brand", "src"), none).alias("src"), t.node_id(F.col("brand"), none).alias("dst"), F.lit(0).alias("kind"), F.lit(0).alias("arg_count"))
    return graph.filter_calls(calls.unionByName(imports), nodes).groupBy("kind", "arg_count").agg(F.count("*").alias("n"))


def resolve_calls(spark, d):
    """Suppliers call customers by nation name, which several places define: by count, nation and resolution."""
    cust = v.table(spark, d, "customer").select(F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string"), F.lit("/c_"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("f_"), F.col("c_nationkey").cast("string")).alias("name"))
    supp = v.table(spark, d, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/s_"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_nationkey").alias("k"))
    nodes = cust.select(t.node_id(F.col("path"), F.col("name")).alias("id"), F.lit(2).alias("kind"), "name", "path")
    nodes = nodes.unionByName(supp.select(t.node_id(F.col("path"), F.lit("main")).alias("id"), F.lit(2).alias("kind"), F.lit("main").alias("name"), "path"))
    site = F.concat(F.lit("f_"), F.col("k").cast("string"))
    calls = supp.select(t.node_id(F.col("path"), F.lit("main")).alias("src"), t.node_id(F.lit(""), site).alias("dst"), F.lit(1).alias("kind"), F.lit(1).alias("line"), site.alias("callsite"), F.lit(0).alias("arg_count"))
    return graph.resolve(calls, nodes).select("src", "dst", "callsite")


def containing_function(spark, d):
    """Events as call lines of users' files; purchases open a range of a day in microseconds' place."""
    e = v.table(spark, d, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line"), "event_type", "event_id")
    ranges = e.filter("event_type = 'purchase'").select("path", F.col("event_id").alias("ord"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), F.col("line").alias("start_line"), (F.col("line") + 400).alias("end_line"))
    calls = e.filter("event_type = 'click'").select("path", F.col("line").alias("call_line"))
    return graph.containing(calls, ranges)


def _facts(spark, d):
    f = v.files(spark, d)
    functions = v.table(spark, d, "lineitem").select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.lit("").alias("receiver"), (F.col("l_suppkey") % 3).cast("int").alias("param_count"), "l_suppkey", "l_quantity", "l_partkey")
    functions = graph.first_by(functions.withColumn("k", F.concat_ws(":", "path", "name")), "k", "ord", "l_suppkey", "l_quantity", "l_partkey").drop("k", "l_suppkey", "l_quantity", "l_partkey")
    calls = v.table(spark, d, "lineitem").select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("caller"), F.concat(F.lit("f"), (F.col("l_suppkey") % 9).cast("string")).alias("callee"), (F.col("l_quantity") % 3).cast("int").alias("args"))
    types = f.filter("ext = '.rs'").select("path", F.lit(0).alias("ord"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("name"), F.lit("struct").alias("kind"))
    imports = v.imports(spark, d).select("path", F.lit(0).alias("ord"), "imp")
    paths = f.select("path").unionByName(functions.select("path").distinct())
    return functions, types, imports, calls, paths


def build_nodes(spark, d):
    return graph.build(*_facts(spark, d))[0].select("id", "kind", "name", "path")


def build_edges(spark, d):
    return graph.build(*_facts(spark, d))[1].groupBy("src", "dst", "kind", "arg_count").agg(F.count("*").alias("n"))


def _zero(spark):
    return spark.createDataFrame([(0,)], "root long")


def bfs_levels(spark, d):
    return graph.levels(v.copurchases(spark, d), _zero(spark)).select("node", "depth")


def reverse_levels(spark, d):
    return graph.levels(v.copurchases(spark, d), _zero(spark), reverse=True).select("node", "depth")


def _seeds(spark, d):
    return v.table(spark, d, "part").filter("p_name = 'red widget' and p_size = 50").select(F.col("p_partkey").alias("root"))


def callees_tree(spark, d):
    return graph.levels(v.copurchases(spark, d), _seeds(spark, d)).filter("depth >= 1").groupBy("root", "depth").agg(F.count("*").alias("n"))


def callers_tree(spark, d):
    return graph.levels(v.copurchases(spark, d), _seeds(spark, d), reverse=True).filter("depth >= 1").groupBy("root", "depth").agg(F.count("*").alias("n"))


def shortest_path(spark, d):
    return graph.shortest_path(v.copurchases(spark, d), 0, 7).select(F.lit(0).cast("long").alias("from"), F.lit(7).cast("long").alias("to"), "length")


def all_paths(spark, d):
    return graph.all_paths(v.copurchases(spark, d), 0).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


def trace_path(spark, d):
    tos = v.table(spark, d, "part").filter("p_name = 'blue bolt'").select(F.col("p_partkey").alias("node"))
    return graph.trace(v.copurchases(spark, d), _seeds(spark, d), tos).groupBy("root", "depth").agg(F.count("*").alias("n"))


def api_surface(spark, d):
    n = v.nodes(spark, d)
    return file_ops.api_surface(n.withColumn("exported", F.col("param_count") > 25))


def _disk(spark, d):
    """Customers' files on disk: their balance's thousands say when they changed; those in debt are gone."""
    path = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit("/customer_"), F.col("c_custkey").cast("string"))
    return v.table(spark, d, "customer").filter("c_acctbal >= 0").select(path.alias("path"), F.col("c_acctbal").alias("mtime"))


def stale_files(spark, d):
    nodes = v.nodes(spark, d).filter(F.col("path").contains("customer"))
    return graph.stale(nodes, _disk(spark, d), F.lit(5000.0))


def new_files(spark, d):
    return _disk(spark, d).join(v.nodes(spark, d).filter("name like '%0'").select("path"), "path", "left_anti").select("path")


def deleted_files(spark, d):
    return stale_files(spark, d).filter("state = 'deleted'").select("path")


def remove_path(spark, d):
    nodes, edges = graph.remove_paths(v.nodes(spark, d), v.edges(spark, d), deleted_files(spark, d))
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes")).join(edges.groupBy("kind").agg(F.count("*").alias("edges")), "kind", "full_outer")


NAMES = "['file', 'package', 'function', 'method', 'type']"
EDGES = "['imports', 'calls', 'defines', 'contains', 'references']"
NEXT = "select l.seed_id, l.seed_name, l.edge_kind, l.line, n.id, n.name from ({}) l join nodes_v n on n.id = l.other"
DISK = "select 'nation_' || c_nationkey || '/customer_' || c_custkey as path, c_acctbal as mtime from customer where c_acctbal >= 0"
STALE = f"select * from (select path, case when mtime is null then 'deleted' when mtime > 5000 then 'modified' end as state from (select distinct path from nodes_v where kind = 0 and contains(path, 'customer')) left join ({DISK}) using (path)) where state is not null"
SEEDS = "select p_partkey as root from part where p_name = 'red widget' and p_size = 50"


def _bfs(seeds: str, hops: int, a: str = "src", b: str = "dst") -> str:
    return f"r as (select root, root as node, 0 as depth from ({seeds}) union select root, {b}, depth + 1 from r join copurchase_v on {a} = node where depth < {hops}), lv as (select root, node, min(depth) as depth from r group by all)"


FILTERED = """select kind, arg_count, count(*) as n from (select 1 as kind, line as arg_count from (
    select c.line, c.src, c.dst, a.p_brand as from_brand, b.p_brand as to_brand, b.p_size % 8 as params, a.path as from_path, b.path as to_path from copurchase_v c join p a on a.p_partkey = c.src join p b on b.p_partkey = c.dst)
    where params = line and (from_path = to_path or exists (select 1 from i where i.src = from_path and i.brand = to_brand))
    union all select 0, 0 from copurchase_v c join p a on a.p_partkey = c.src join p b on b.p_partkey = c.dst where line = 1) group by all"""
FUNCTIONS = "select distinct 'o/' || l_orderkey as path, 'f' || (l_partkey % 7) as name from lineitem"
BUILT = f"""select substr(sha256(path || ':'), 1, 32) as id, 0 as kind, regexp_replace(path, '^.*/', '') as name, path, 0 as o from (select path from files_v union all select distinct path from fn)
  union all select substr(sha256(path || ':' || name), 1, 32), 2, name, path, 1 from fn
  union all select substr(sha256(path || ':T' || doc_id), 1, 32), 4, 'T' || doc_id, path, 2 from files_v where ext = '.rs'
  union all select substr(sha256(imp || ':'), 1, 32), 1, regexp_replace(imp, '^.*/', ''), imp, 3 from imports_v"""
GRAPH = {
    "graph_stats": (graph_stats, "select *, round(case when node_count = 0 then 0 else edge_count / node_count end, 6) as avg_edges from (select count(*) as node_count, count_if(kind = 0) as file_count, count_if(kind in (2, 3)) as function_count from nodes_v), (select count(*) as edge_count from edges_v)"),
    "nodes_by_kind": (nodes_by_kind, f"select {NAMES}[kind + 1] as kind, count(*) as n from nodes_v group by all"),
    "edges_by_kind": (edges_by_kind, f"select {EDGES}[kind + 1] as kind, count(*) as n from edges_v group by all"),
    "node_ids": (node_ids, "select id, path, name from nodes_v"),
    "node_text": (node_text, f"select id, concat_ws(chr(10), {NAMES}[kind + 1] || ': ' || name, case when signature <> '' then 'Signature: ' || signature end, 'Location: ' || path) as text from nodes_v"),
    "find_nodes": (find_nodes, "select id, name, path from nodes_v where kind in (2, 3) and (contains(lower(name), 'red widget') or contains(lower(path), 'red widget'))"),
    "symbol_search": (symbol_search, "select path, name from nodes_v where contains(lower(name), 'ring') and contains(path, 'Brand#1') and kind in (2, 3)"),
    "symbol_counts": (symbol_counts, "select count_if(kind in (2, 3)) as functions, count_if(kind = 4) as types from nodes_v where contains(lower(name), 'o')"),
    "exported_names": (exported_names, r"select id, regexp_matches(name, '^\p{Lu}') as go, not starts_with(name, '_') as python from nodes_v where kind in (0, 2)"),
    "receiver_type": (receiver_type, "select p_partkey, p_type as receiver, case when p_size > 25 then -1 else 2 end as params, case when p_size > 25 then 4 else 3 end as args, 'func (r *' || p_type || ') F(a map[' || p_brand || ', int], b ' || p_type || case when p_size > 25 then ', c ...int' else '' end || ')' as signature from part"),
    "outgoing": (outgoing, NEXT.format("select s.id as seed_id, s.name as seed_name, e.kind as edge_kind, e.line, e.dst as other from edges_v e join nodes_v s on s.id = e.src where contains(lower(s.name), 'nation_1') or contains(lower(s.path), 'nation_1')")),
    "incoming": (incoming, NEXT.format("select s.id as seed_id, s.name as seed_name, e.kind as edge_kind, e.line, e.src as other from edges_v e join nodes_v s on s.id = e.dst where contains(lower(s.name), 'supplier_1') or contains(lower(s.path), 'supplier_1')")),
    "callees_1hop": (callees_1hop, "select s.name as seed_name, n.name, count(*) as calls from edges_v e join nodes_v s on s.id = e.src join nodes_v n on n.id = e.dst where e.kind = 1 and (contains(lower(s.name), 'orders/order_1') or contains(s.path, 'orders/order_1')) group by all"),
    "callers_1hop": (callers_1hop, "select n.id, count(*) as calls from edges_v e join nodes_v s on s.id = e.dst join nodes_v n on n.id = e.src where e.kind = 1 and contains(lower(s.name), 'red widget') group by all"),
    "filter_calls": (filter_calls, "select kind, arg_count, count(*) as n from edges_v where kind <> 1 group by all"),
    "containing_function": (containing_function, "select c.path, c.call_line, arg_max('f' || r.event_id, r.event_id) as caller from (select distinct 'user_' || user_id as path, event_id as call_line from events where event_type = 'click') c join (select 'user_' || user_id as path, event_id from events where event_type = 'purchase') r on c.path = r.path and c.call_line between r.event_id and r.event_id + 400 group by all"),
    "api_surface": (api_surface, "select regexp_replace(path, '/[^/]*$', '') as package, count_if(kind in (2, 3)) as functions, count_if(kind = 4) as types from nodes_v where param_count > 25 group by 1"),
    "stale_files": (stale_files, STALE),
    "deleted_files": (deleted_files, f"select path from ({STALE}) where state = 'deleted'"),
    "new_files": (new_files, f"select path from ({DISK}) where path not in (select path from nodes_v where name like '%0')"),
    "remove_path": (remove_path, f"select * from (select kind, count(*) as nodes from nodes_v where path not in (select path from ({STALE}) where state = 'deleted') group by 1) full join (select kind, count(*) as edges from edges_v where src not in (select id from gone) and dst not in (select id from gone) group by 1) using (kind)"),
}
QUERIES = {name: q for name, (q, _) in GRAPH.items()}
ORACLES = {name: sql(s) for name, (_, s) in GRAPH.items()}
ORACLES["remove_path"] = sql(f"select 1 from nodes_v, edges_v").replace("select 1 from nodes_v, edges_v", "") + f", gone as (select id from nodes_v where path in (select path from ({STALE}) where state = 'deleted')) " + GRAPH["remove_path"][1]
QUERIES |= {"filter_calls_imported": filter_calls_imported, "resolve_calls": resolve_calls, "build_nodes": build_nodes, "build_edges": build_edges, "bfs_levels": bfs_levels, "reverse_levels": reverse_levels, "callees_tree": callees_tree, "callers_tree": callers_tree, "shortest_path": shortest_path, "all_paths": all_paths, "trace_path": trace_path}
_copurchases = f"copurchase_v as ({v.SQL['copurchase_v']})"
_files = f"files_v as ({v.SQL['files_v']}), imports_v as ({v.SQL['imports_v']}), fn as ({FUNCTIONS})"
ORACLES["filter_calls_imported"] = f"with {_copurchases}, p as (select *, lower(replace(p_brand, '#', '_')) || '/part_' || p_partkey as path from part), i as (select distinct a.path as src, b.p_brand as brand from copurchase_v c join p a on a.p_partkey = c.src join p b on b.p_partkey = c.dst where line = 1) {FILTERED}"
ORACLES["resolve_calls"] = """with c as (select 'n' || (c_nationkey % 5) as package, 'n' || (c_nationkey % 5) || '/c_' || c_custkey as path, 'f_' || c_nationkey as name from customer), s as (select 'n' || (s_suppkey % 5) as package, 'n' || (s_suppkey % 5) || '/s_' || s_suppkey as path, 'f_' || s_nationkey as callsite from supplier),
  k as (select name, count(*) as n, min(path) as only_path from c group by name), m as (select name, package, min(path) as path from c group by all)
  select substr(sha256(s.path || ':main'), 1, 32) as src, case when k.n = 1 then substr(sha256(k.only_path || ':' || k.name), 1, 32) when m.path is not null then substr(sha256(m.path || ':' || m.name), 1, 32) else substr(sha256(':' || s.callsite), 1, 32) end as dst, s.callsite from s left join k on k.name = s.callsite left join m on m.name = s.callsite and m.package = s.package"""
ORACLES["build_nodes"] = f"with {_files} select id, kind, name, path from (select *, row_number() over (partition by id order by path, o) as n from ({BUILT})) where n = 1"
ORACLES["build_edges"] = f"""with {_files} select src, dst, kind, arg_count, count(*) as n from (
  select substr(sha256(path || ':'), 1, 32) as src, substr(sha256(path || ':' || name), 1, 32) as dst, 3 as kind, 0 as arg_count from fn
  union all select substr(sha256(path || ':'), 1, 32), substr(sha256(path || ':T' || doc_id), 1, 32), 3, 0 from files_v where ext = '.rs'
  union all select substr(sha256(path || ':'), 1, 32), substr(sha256(imp || ':'), 1, 32), 0, 0 from imports_v
  union all select substr(sha256(path || ':' || caller), 1, 32), case when (path, callee) in (select (path, name) from fn) then substr(sha256(path || ':' || callee), 1, 32) else substr(sha256(':' || callee), 1, 32) end, 1, args from (select 'o/' || l_orderkey as path, 'f' || (l_partkey % 7) as caller, 'f' || (l_suppkey % 9) as callee, cast(floor(l_quantity % 3) as int) as args from lineitem)) group by all"""
ORACLES["bfs_levels"] = f"with recursive {_copurchases}, {_bfs('select 0::bigint as root', 5)} select node, depth from lv"
ORACLES["reverse_levels"] = f"with recursive {_copurchases}, {_bfs('select 0::bigint as root', 5, 'dst', 'src')} select node, depth from lv"
ORACLES["callees_tree"] = f"with recursive {_copurchases}, {_bfs(SEEDS, 5)} select root, depth, count(*) as n from lv where depth >= 1 group by all"
ORACLES["callers_tree"] = f"with recursive {_copurchases}, {_bfs(SEEDS, 5, 'dst', 'src')} select root, depth, count(*) as n from lv where depth >= 1 group by all"
ORACLES["shortest_path"] = f"with recursive {_copurchases}, {_bfs('select 0::bigint as root', 9)} select 0::bigint as \"from\", node as \"to\", depth as length from lv where node = 7"
ORACLES["all_paths"] = f"with recursive {_copurchases}, w as (select [0::bigint] as p union all select list_append(p, dst) from w join copurchase_v on src = p[-1] where len(p) < 5 and not list_contains(p, dst)) select array_to_string(p, '>') as path, cast(len(p) - 1 as int) as length from w"
ORACLES["trace_path"] = f"with recursive {_copurchases}, {_bfs(SEEDS, 4)} select root, depth, count(*) as n from lv where root <> node and node in (select p_partkey from part where p_name = 'blue bolt') group by all"
