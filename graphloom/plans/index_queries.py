"""Queries on an index that is updated, graphs that are saved, paths, and tables by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..functions import text as t
from ..operators import graph, providers
from ..operators.index import Index
from ..operators.tables import AnswerStore, VectorTable
from ..sources import code
from ..sources import views as v
from ..sources.views import sql
from .graph_queries import _bfs, _copurchases


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _orders(spark, d, changed: bool):
    """A Python file for each order; later a quarter of the files is new, one is changed and one is gone."""
    item = v.table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0" if changed else "l_orderkey % 4 <> 3")
    added = F.when(F.lit(changed) & (F.col("l_orderkey") % 4 == 1), 1).otherwise(0)

    def body(x):
        return F.concat(F.lit("def f"), ((x["l_partkey"] + added) % 40).cast("string"), F.lit("(a):\n    f"), (x["l_suppkey"] % 60).cast("string"), F.lit("(a,\n      1)\n\n"))

    whole = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("all"))
    whole = whole.select("l_orderkey", F.array_join(F.transform("all", body), "").alias("text"))
    path = F.concat(F.lit("d"), (F.col("l_orderkey") % 7).cast("string"), F.lit("/o"), F.col("l_orderkey").cast("string"), F.lit(".py"))
    return whole.select(path.alias("path"), F.lit("python").alias("language"), "text")


def index_update(spark, d):
    """Call edges of an index that was built, and then brought up to date."""
    index = Index(spark, _folder(spark, "index"))
    index.update(_orders(spark, d, False))
    index.update(_orders(spark, d, True))
    return index.call_edges().groupBy("src", "dst", "callsite", "arg_count").agg(F.count("*").alias("n"))


def index_nodes(spark, d):
    """Nodes and edges by kind of the same index, read again from its folder."""
    folder = _folder(spark, "index")
    Index(spark, folder).update(_orders(spark, d, False))
    Index(spark, folder).update(_orders(spark, d, True))
    nodes, edges = Index(spark, folder).graph()
    one = nodes.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    return one.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("edge")))


def saved_graph(spark, d):
    """Callers of the red widgets, from a graph that was saved and loaded in buckets."""
    folder = _folder(spark, "graph")
    graph.save(v.nodes(spark, d), v.edges(spark, d), folder)
    nodes, edges = graph.load(spark, folder, incoming=True)
    return graph.neighbours(graph.find(nodes, "red widget"), nodes, edges, outgoing=False, kinds=(1,))


def _purchases(spark, d):
    return v.copurchases(spark, d).select("src", "dst", F.lit(1).alias("kind"))


def _part_nodes(spark, d):
    part = v.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.lit(2).alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("path"))


def find_path(spark, d):
    """The nodes of a path from the first part of one description to one of another."""
    return graph.find_path(_part_nodes(spark, d), _purchases(spark, d), "brand#11/50", "brand#23/1").select("step", "id", "name", "edge_kind")


def shortest_path_nodes(spark, d):
    """The parts on the way from 0 to 7."""
    found = graph.shortest_path(v.copurchases(spark, d), 0, 7)
    return found.select(F.posexplode("path").alias("step", "node"), "length")


def _part_vectors(spark, d, low: int, high: int):
    vec = v.vectors(spark, d).filter((F.col("label") >= low) & (F.col("label") < high))
    return vec.select(F.col("node_id").cast("string").alias("node_id"), "vector", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))


def vector_table(spark, d):
    """Vectors of all labels but two, put in twice, without those of one label; saved and loaded."""
    table = VectorTable(spark, _folder(spark, "vectors"))
    table.add(_part_vectors(spark, d, 0, 6))
    table.add(_part_vectors(spark, d, 4, 8).withColumn("vector", F.transform("vector", lambda x: -x)))
    table.remove(_part_vectors(spark, d, 2, 3).select("node_id"))
    saved = table.save(_folder(spark, "vectors"))
    table.clear()
    loaded = VectorTable(spark, saved.folder)
    return loaded.read().select("node_id", "text", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").alias("dimension"), F.lit(table.count()).cast("long").alias("left"))


def answer_store(spark, d):
    """The last event of a user as an answer that is kept for 20 days; customers ask for theirs."""
    e = v.table(spark, d, "events")
    last = e.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("operation"), F.max("ts").cast("timestamp").alias("created_at"), F.max("event_id").cast("string").alias("response"), F.count("*").alias("tokens"))
    store = AnswerStore(spark, _folder(spark, "answers"), ttl_days=20)
    store.set(last.withColumn("model", F.lit("mock")))
    store.delete(last.filter("operation = 'signup'").select("key"))
    asked = v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    found = store.get(asked, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    stats = store.stats()
    return found.select("key", "response", "tokens", "hit", F.lit(stats["hits"]).cast("long").alias("hits"), F.lit(stats["misses"]).cast("long").alias("misses"), F.lit(stats["evictions"]).cast("long").alias("evictions"))


def embed_resumed(spark, d):
    """Parts' vectors, of which those of small parts were there before."""
    nodes = v.nodes(spark, d).filter("kind = 2")
    table = VectorTable(spark, _folder(spark, "vectors"))
    providers.embed_graph(nodes.filter("param_count < 25"), table, parts=2)
    done = providers.embed_graph(nodes, table, parts=2)
    whole = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return table.read().select("node_id", "text", F.round(whole, 6).alias("total"), F.lit(done["embedded"]).cast("long").alias("asked"))


def manifest_kinds(spark, d):
    """A package.json in one line for each brand, requirements for each nation, two kinds of Swift lists for each supplier."""
    part, cust, supp = (v.table(spark, d, n) for n in ("part", "customer", "supplier"))
    key = F.col("p_partkey")
    one = part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("@s/p"), key.cast("string")), F.lit("^1")))).alias("dependencies"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("dev-"), key.cast("string")), F.lit("}:{")))).alias("devDependencies"))
    js = one.select(F.concat("p_brand", F.lit("/package.json")).alias("path"), F.to_json(F.struct(F.lit("x").alias("name"), "dependencies", F.struct(F.lit("y").alias("dependencies")).alias("other"), "devDependencies")).alias("text"))
    pins = F.array(*map(F.lit, ("==1", ">=2", "~=3 ; python_version<'3'", "[x]<4", "", " # note")))
    need = F.concat(F.lit("dep"), F.col("c_custkey").cast("string"), F.element_at(pins, (F.col("c_custkey") % 6 + 1).cast("int")))
    py = cust.groupBy("c_nationkey").agg(F.array_join(F.collect_list(need), "\n").alias("text")).select(F.concat(F.col("c_nationkey").cast("string"), F.lit("/requirements.txt")).alias("path"), F.concat(F.lit("# pins\n\n"), "text").alias("text"))
    own = F.col("s_suppkey").cast("string")
    pod = supp.select(F.concat(own, F.lit("/Podfile")).alias("path"), F.concat(F.lit("target 'x' do\n  pod 'Pod"), own, F.lit("', '~> 1'\nend")).alias("text"))
    swift = supp.select(F.concat(own, F.lit("/Package.swift")).alias("path"), F.concat(F.lit('  .package(url: "https://x.y/u/swift'), own, F.lit('.git", from: "1"),')).alias("text"))
    return code.manifests_of(js.unionByName(py).unionByName(pod).unionByName(swift)).select("path", "language", "dep")


FINAL = """l as (select 'd' || (l_orderkey % 7) || '/o' || l_orderkey || '.py' as path, 'd' || (l_orderkey % 7) as package, 'f' || ((l_partkey + case when l_orderkey % 4 = 1 then 1 else 0 end) % 40) as caller, 'f' || (l_suppkey % 60) as callee from lineitem where l_orderkey % 4 <> 0),
  fn as (select distinct path, package, caller as name from l)"""
PAIR = f"""with recursive {_copurchases}, froms as (select p_partkey as id from part where contains(lower(p_name), 'brand#11/50') or contains(lower(p_brand || '/' || p_size), 'brand#11/50')), tos as (select p_partkey as id from part where contains(lower(p_name), 'brand#23/1') or contains(lower(p_brand || '/' || p_size), 'brand#23/1')),
  {_bfs('select id as root from froms', 4)}, best as (select root, node, depth from lv where root <> node and node in (select id from tos) order by root, node limit 1),
  bk as (select node as spot, 0 as away from best union select src, away + 1 from bk join copurchase_v on dst = spot where away < 4), near as (select spot, min(away) as away from bk group by spot),
  w as (select [root] as p from best union select list_append(p, dst) from w join copurchase_v on src = p[-1] join near on spot = dst, best where len(p) <= depth and away = depth - len(p)),
  one as (select min(p) as p from w, best where len(p) = depth + 1)
select cast(step as int) as step, p[step + 1] as id, (select p_name from part where p_partkey = p[step + 1]) as name, case when step < len(p) - 1 then 1 end as edge_kind from (select p, unnest(generate_series(0, len(p) - 1)) as step from one where p is not null)"""
ALL = {
    "index_update": (index_update, f"""with {FINAL}, k as (select name, count(*) as n, min(substr(sha256(path || ':' || name), 1, 32)) as id from fn group by name), m as (select name, package, min(path) as path from fn group by all)
      select src, dst, callsite, 2 as arg_count, count(*) as n from (select substr(sha256(l.path || ':' || caller), 1, 32) as src, callee as callsite,
        case when (l.path, callee) in (select (path, name) from fn) then substr(sha256(l.path || ':' || callee), 1, 32) when k.n = 1 then k.id when m.path is not null then substr(sha256(m.path || ':' || callee), 1, 32) else substr(sha256(':' || callee), 1, 32) end as dst
        from l left join k on k.name = callee left join m on m.name = callee and m.package = l.package) group by all"""),
    "index_nodes": (index_nodes, f"with {FINAL} select 'node' as what, 0 as kind, count(distinct path) as n from fn union all select 'node', 2, count(*) from fn union all select 'edge', 3, count(*) from fn union all select 'edge', 1, count(*) from l"),
    "saved_graph": (saved_graph, sql("select s.id as seed_id, s.name as seed_name, e.kind as edge_kind, e.line, n.id, n.name from edges_v e join nodes_v s on s.id = e.dst join nodes_v n on n.id = e.src where e.kind = 1 and (contains(lower(s.name), 'red widget') or contains(lower(s.path), 'red widget'))")),
    "find_path": (find_path, PAIR),
    "shortest_path_nodes": (shortest_path_nodes, f"""with recursive {_copurchases}, {_bfs('select 0::bigint as root', 9)}, goal as (select depth from lv where node = 7),
      bk as (select 7::bigint as spot, 0 as away union select src, away + 1 from bk join copurchase_v on dst = spot where away < 9), near as (select spot, min(away) as away from bk group by spot),
      w as (select [0::bigint] as p union select list_append(p, dst) from w join copurchase_v on src = p[-1] join near on spot = dst, goal where len(p) <= depth and away = depth - len(p)),
      one as (select min(p) as p from w, goal where len(p) = depth + 1)
      select cast(step as int) as step, p[step + 1] as node, cast(len(p) - 1 as int) as length from (select p, unnest(generate_series(0, len(p) - 1)) as step from one where p is not null)"""),
    "vector_table": (vector_table, "select vec_id::varchar as node_id, 'label ' || label as text, round(case when label >= 4 then -(embedding[1]::double) else embedding[1]::double end, 6) as first, cast(len(embedding) as int) as dimension, 0::bigint as left from embeddings where label < 8 and label <> 2"),
    "answer_store": (answer_store, """with a as (select user_id::varchar as key, arg_max(event_type, (ts, event_id)) as operation, max(ts) as created_at, max(event_id)::varchar as response, count(*) as tokens from events group by 1),
      h as (select c_custkey::varchar as key, a.* exclude (key), a.key is not null and epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(created_at)) <= 20 * 86400 as hit from customer left join (select * from a where operation <> 'signup') a on a.key = c_custkey::varchar)
      select key, case when hit then response end as response, case when hit then tokens end as tokens, hit, (select count(*) from h where hit) as hits, (select count(*) from h where not hit) as misses, (select count(*) from a where operation = 'signup') as evictions from h"""),
    "embed_resumed": (embed_resumed, sql("""select id as node_id, s as text, (select count(*) from nodes_v where kind = 2 and param_count >= 25) as asked, round(list_sum(list_transform(generate_series(1, 768), lambda i: ((a + i * b) % 1000) / 1000.0::double)), 6) as total from (
      select id, s, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]) * (i - 1))) as bigint) as a, cast(list_sum(list_transform(generate_series(1, length(s)), lambda i: ascii(s[i]))) as bigint) as b from (select id, 'function: ' || name || chr(10) || 'Signature: ' || signature || chr(10) || 'Location: ' || path as s from nodes_v where kind = 2))""")),
    "manifest_kinds": (manifest_kinds, """select p_brand || '/package.json' as path, 'javascript' as language, unnest(['@s/p' || p_partkey, 'dev-' || p_partkey]) as dep from part union all select c_nationkey || '/requirements.txt', 'python', 'dep' || c_custkey || case when c_custkey % 6 = 5 then ' ' else '' end from customer
      union all select s_suppkey || '/Podfile', 'swift', 'Pod' || s_suppkey from supplier union all select s_suppkey || '/Package.swift', 'swift', 'swift' || s_suppkey from supplier"""),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: s for name, (_, s) in ALL.items()}
