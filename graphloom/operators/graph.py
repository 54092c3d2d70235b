"""The property graph: building it from facts, resolving and filtering calls, statistics, traversal.

nodes(id, kind, name, path, ...) and edges(src, dst, kind, line, callsite, arg_count) are DataFrames;
edges are a bag. Where order matters, rows are ordered by stated columns, so results never depend on
partitioning. Traversals are loops over frontiers of DataFrames: one join and one anti-join a level.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import beside, bucketed, bucketed_table, passing, read_text, write_text
from ..folders import written as kept
from ..functions import text as t
from ..functions.fixed import CALLS, CONTAINS, FILE, FUNCTION, IMPORTS, METHOD, PACKAGE, TYPE
from . import sweep


# -- build -------------------------------------------------------------------------------------


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the first in the given order. Each task keeps one row of a key."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def build(functions: DataFrame, types: DataFrame, imports: DataFrame, calls: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of facts.

    functions(path, ord, name, receiver, param_count), types(path, ord, name, kind), imports(path, ord, imp),
    calls(path, ord, caller, callee, args), paths(path). The first node with an id stays: files, then in each
    file functions, types and imports. Contains edges stay even where the node fell away. A call goes to the
    callee of the same file, or to a placeholder id that resolve() replaces; calls from unknown callers fall away.
    """
    none = F.lit("")
    col = F.col
    part = [
        paths.select(t.node_id(col("path"), none).alias("id"), F.lit(FILE).alias("kind"), t.base(col("path")).alias("name"), "path", F.lit(0).alias("param_count"), F.lit(0).alias("_of"), F.lit(0).alias("ord")),
        functions.select(t.node_id(col("path"), col("name")).alias("id"), F.when(col("receiver") != "", METHOD).otherwise(FUNCTION).alias("kind"), "name", "path", "param_count", F.lit(1).alias("_of"), "ord"),
        types.select(t.node_id(col("path"), col("name")).alias("id"), F.lit(TYPE).alias("kind"), "name", "path", F.lit(0).alias("param_count"), F.lit(2).alias("_of"), "ord"),
        imports.select(t.node_id(col("imp"), none).alias("id"), F.lit(PACKAGE).alias("kind"), t.base(col("imp")).alias("name"), col("imp").alias("path"), F.lit(0).alias("param_count"), F.lit(3).alias("_of"), "ord"),
    ]
    rows = part[0]
    for p in part[1:]:
        rows = rows.unionByName(p)
    nodes = first_by(rows, "id", "path", "_of", "ord").drop("_of", "ord").withColumn("package", F.when(col("kind") == FILE, t.package_of(col("path"))).otherwise(""))

    def edge(df, src, dst, kind, callsite=None, args=None):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (none if callsite is None else callsite).alias("callsite"), (F.lit(0) if args is None else args).alias("arg_count"))

    file_id = t.node_id(col("path"), none)
    defined = functions.select("path", col("name").alias("caller")).distinct()
    local = functions.select("path", col("name").alias("callee")).distinct().withColumn("_here", F.lit(True))
    known = calls.join(defined, ["path", "caller"]).join(local, ["path", "callee"], "left")
    target = F.when(col("_here"), t.node_id(col("path"), col("callee"))).otherwise(t.node_id(none, col("callee")))
    edges = edge(functions, file_id, t.node_id(col("path"), col("name")), CONTAINS)
    edges = edges.unionByName(edge(types, file_id, t.node_id(col("path"), col("name")), CONTAINS))
    edges = edges.unionByName(edge(imports, file_id, t.node_id(col("imp"), none), IMPORTS))
    return nodes, edges.unionByName(edge(known, t.node_id(col("path"), col("caller")), target, CALLS, col("callee"), col("args")))


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the placeholders of calls replaced by a function or method of the called name.

    One candidate is taken; of several, the first by path and id that has the caller's path or package.
    Names are counted and, for callers' paths and packages, reduced to one candidate before the join, so a
    name that is defined very often meets each call once.
    """
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_known"))
    place = nodes.select("id", "name", "kind", "path", t.package_of(F.col("path")).alias("package"))
    callee = place.filter(F.col("kind").isin(FUNCTION, METHOD))
    first = F.min(F.struct("path", "id"))["id"]
    one = callee.groupBy(F.col("name").alias("callsite")).agg(F.count("*").alias("n"), F.min("id").alias("any"))
    by_path = callee.groupBy(F.col("name").alias("callsite"), "path").agg(first.alias("same_path"))
    by_package = callee.groupBy(F.col("name").alias("callsite"), "package").agg(first.alias("same_package"))
    caller = place.select(F.col("id").alias("src"), "path", "package")
    calls = edges.filter(F.col("kind") == CALLS).join(known, "dst", "left").join(caller, "src", "left")
    found = calls.join(one, "callsite", "left").join(by_path, ["callsite", "path"], "left").join(by_package, ["callsite", "package"], "left")
    chosen = F.when(F.col("n") == 1, F.col("any")).otherwise(F.coalesce("same_path", "same_package"))
    resolved = found.withColumn("dst", F.when(F.col("_known"), F.col("dst")).otherwise(F.coalesce(chosen, "dst")))
    return edges.filter(F.col("kind") != CALLS).unionByName(resolved.select(*edges.columns))


def filter_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges without the calls whose ends are unknown, whose argument count differs, or that leave the file for a package it doesn't import.

    Nodes may be many, so they are dealt by their ids and never sent to all tasks.
    """
    calls, rest = edges.filter(F.col("kind") == CALLS), edges.filter(F.col("kind") != CALLS)
    side = nodes.select("id", "path", "param_count")
    a = side.select(F.col("id").alias("src"), F.col("path").alias("_from"))
    b = side.select(F.col("id").alias("dst"), F.col("path").alias("_to"), F.col("param_count").alias("_params"))
    # Counts first: calls that don't fit move once only.
    fits = calls.join(beside(b), "dst").filter((F.col("_params") < 0) | (F.col("_params") == F.col("arg_count"))).join(beside(a), "src")
    files = nodes.filter(F.col("kind") == FILE).select(F.col("id").alias("src"), F.col("path").alias("_from"))
    packages = nodes.select(F.col("id").alias("dst"), F.col("name").alias("_package"))
    imported = rest.filter(F.col("kind") == IMPORTS).join(beside(files), "src").join(beside(packages), "dst").select("_from", "_package").distinct().withColumn("_ok", F.lit(True))
    ok = fits.withColumn("_package", t.package_of(F.col("_to"))).join(beside(imported), ["_from", "_package"], "left").filter((F.col("_from") == F.col("_to")) | F.col("_ok"))
    return rest.unionByName(ok.select(*edges.columns))


def containing(calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, call_line, caller: each line of calls(path, call_line) once, with the last of ranges(path, ord, name, start_line, end_line) that holds it."""
    return sweep.containing(calls.select("path", "call_line").distinct(), ranges).filter("caller is not null")


# -- statistics and one-hop queries ------------------------------------------------------------


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, files, functions (with methods), edges for each node."""
    sums = [F.count_if(F.col("kind") >= 0).alias("node_count"), F.count_if(F.col("kind") == FILE).alias("file_count"), F.count_if(F.col("kind").isin(FUNCTION, METHOD)).alias("function_count"), F.count_if(F.col("kind") < 0).alias("edge_count")]
    both = nodes.select("kind").unionAll(edges.select(F.lit(-1).alias("kind")))
    average = F.when(F.col("node_count") == 0, 0.0).otherwise(F.col("edge_count") / F.nullif("node_count", F.lit(0)))
    return both.agg(*sums).withColumn("avg_edges", F.round(average, 6))


def find(nodes: DataFrame, pattern: str, kinds: tuple[int, ...] = ()) -> DataFrame:
    """Nodes whose name or path holds the pattern, whatever the case."""
    p = pattern.lower()
    out = nodes.filter(F.lower("name").contains(p) | F.lower("path").contains(p))
    return out.filter(F.col("kind").isin(*kinds)) if kinds else out


def neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, outgoing: bool = True, kinds: tuple[int, ...] = ()) -> DataFrame:
    """seed_id, seed_name, edge_kind, line, id, name: an edge of a seed and its other end, one row for each edge."""
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    s = seeds.select(F.col("id").alias("seed_id"), F.col("name").alias("seed_name"))
    n = nodes.select("id", "name")
    return e.select(F.col(here).alias("seed_id"), F.col(there).alias("id"), F.col("kind").alias("edge_kind"), "line").join(s, "seed_id").join(n, "id").select("seed_id", "seed_name", "edge_kind", "line", "id", "name")


# -- traversal ---------------------------------------------------------------------------------


def levels(edges: DataFrame, seeds: DataFrame, max_hops: int = 5, reverse: bool = False) -> DataFrame:
    """root, node, depth: every node within max_hops of each root, at its least depth, roots included.

    edges(src, dst), seeds(root). Each level joins the frontier with the edges and leaves out what was seen.
    Edges move once; the shuffles of a level are gone before the next.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    spark = edges.sparkSession
    with passing(spark):
        # In buckets of the node that is left, so that no level moves the edges.
        links = bucketed(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "node", once=True)
        seen = frontier = seeds.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        rows = None
        for depth in range(1, max_hops + 1):
            step = beside(frontier, rows).join(links, "node").select("root", F.col("next").alias("node")).distinct()
            frontier = kept(step.join(beside(seen), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            rows = frontier.count()
            if not rows:
                break
            seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source, target, max_nodes: int = 10) -> DataFrame:
    """path, length of a shortest path of at most max_nodes nodes; no row if there is none.

    Ties go to the least path in the order of node ids. Only the first path to a node is kept at each level.
    """
    max_nodes = max_nodes if max_nodes > 0 else 10
    links = kept(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, [source])], "node long, path array<long>" if isinstance(source, int) else "node string, path array<string>")
    seen = frontier.select("node")
    if source == target:
        return frontier.select("path", F.lit(0).alias("length"))
    for hops in range(1, max_nodes):
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = kept(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = frontier.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select("path", F.lit(hops).alias("length"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
    return frontier.filter(F.lit(False)).select("path", F.lit(0).alias("length"))


def all_paths(edges: DataFrame, source, target=None, max_nodes: int = 5) -> DataFrame:
    """path, length of every simple path from source (to target, if given) of at most max_nodes nodes; parallel edges count apart."""
    spark = edges.sparkSession
    kind = "long" if isinstance(source, int) else "string"
    paths = spark.createDataFrame([([source],)], f"path array<{kind}>")
    links = kept(edges.select("src", "dst"))
    done = None
    for _ in range(max_nodes):
        ends = paths if target is None else paths.filter(F.element_at("path", -1) == target)
        done = ends if done is None else done.unionByName(ends)
        open_ = paths if target is None else paths.filter(F.element_at("path", -1) != target)
        step = open_.join(links, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        paths = kept(step.select(F.concat("path", F.array("dst")).alias("path")))
    return done.select("path", (F.size("path") - 1).alias("length"))


def trace(edges: DataFrame, froms: DataFrame, tos: DataFrame, max_nodes: int = 5) -> DataFrame:
    """root, node, depth of all pairs of different nodes in froms(root) and tos(node) with a path of at most max_nodes nodes, at its length.

    Both sides search half of the way, so neither grows to the reach of the whole.
    """
    hops = max(0, max_nodes - 1)
    there = levels(edges, froms.select("root").distinct(), (hops + 1) // 2).select("root", F.col("node").alias("middle"), "depth")
    back = levels(edges, tos.select(F.col("node").alias("root")).distinct(), hops // 2, reverse=True).select(F.col("root").alias("node"), F.col("node").alias("middle"), F.col("depth").alias("rest"))
    met = there.join(back, "middle").filter("root <> node")
    return met.groupBy("root", "node").agg(F.min(F.col("depth") + F.col("rest")).cast("int").alias("depth"))


def traced(edges: DataFrame, froms: DataFrame, tos: DataFrame, max_nodes: int = 5) -> DataFrame:
    """step, id, edge_kind: the nodes of a shortest path of the first pair, by ids, of froms(root) and tos(node) that has one.

    edge_kind is the least kind of an edge to the next node, null at the end. Of several shortest paths the least in the order of ids.
    """
    pair = trace(edges, froms, tos, max_nodes).orderBy("root", "node").first()
    kind = edges.schema["src"].dataType.simpleString()
    spark = edges.sparkSession
    if pair is None:
        return spark.createDataFrame([], f"step int, id {kind}, edge_kind int")
    goal = spark.createDataFrame([(pair["node"],)], f"root {kind}")
    left = levels(edges, goal, pair["depth"], reverse=True).select(F.col("node").alias("dst"), "depth")
    links = bucketed(edges.select("src", "dst", F.col("kind").cast("int").alias("edge_kind")), "src")
    at, steps = pair["root"], []
    for step in range(pair["depth"]):  # one row for each hop
        nearer = left.filter(F.col("depth") == pair["depth"] - step - 1)
        ahead = links.filter(F.col("src") == F.lit(at)).join(nearer, "dst").groupBy("dst").agg(F.min("edge_kind").alias("edge_kind")).orderBy("dst").first()
        steps.append((step, at, ahead["edge_kind"]))
        at = ahead["dst"]
    return spark.createDataFrame([*steps, (pair["depth"], at, None)], f"step int, id {kind}, edge_kind int")


def find_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_nodes: int = 5, kinds: tuple[int, ...] = ()) -> DataFrame:
    """step, id, name, path, edge_kind of traced() between the nodes that two patterns find."""
    froms, tos = find(nodes, source, kinds), find(nodes, target, kinds)
    steps = traced(edges, froms.select(F.col("id").alias("root")), tos.select(F.col("id").alias("node")), max_nodes)
    return F.broadcast(steps).join(nodes.select("id", "name", "path"), "id").select("step", "id", "name", "path", "edge_kind")


# -- incremental maintenance -------------------------------------------------------------------


def stale(nodes: DataFrame, disk: DataFrame, indexed_at) -> DataFrame:
    """path, state of indexed files that are gone or newer than the index. File nodes only: imports are no files."""
    files = nodes.filter(F.col("kind") == FILE).select("path").distinct()
    both = files.join(disk.select("path", "mtime"), "path", "left")
    state = F.when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") > indexed_at, "modified")
    return both.withColumn("state", state).filter("state is not null").select("path", "state")


def remove_paths(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes of these paths and all edges that touch them.

    The ids that go are written once; of the edges only those whose ends are among them are looked for, in two
    joins that need not move the edges while the ids are few.
    """
    gone = kept(nodes.join(paths.select("path").distinct(), "path", "left_semi").select("id").distinct())
    left = edges.join(gone, edges["src"] == gone["id"], "left_anti")
    other = gone.select(F.col("id").alias("_gone"))
    return nodes.join(other, nodes["id"] == other["_gone"], "left_anti"), left.join(other, left["dst"] == other["_gone"], "left_anti")


def meta(nodes: DataFrame, edges: DataFrame, version: int = 1, root: str = "") -> DataFrame:
    """One row on a saved graph: version, root, node_count, edge_count, indexed_at."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))
    return counts.select(F.lit(version).alias("version"), F.lit(root).alias("root"), "node_count", "edge_count", F.current_timestamp().alias("indexed_at"))


def save(nodes: DataFrame, edges: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Nodes in buckets of their ids, edges in buckets of their sources, and again of their targets; what is there is not replaced."""
    n = buckets or min(1024, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tables = {"nodes": (nodes, "id"), "edges": (edges, "src"), "edges_in": (edges, "dst")}
    for name, (df, key) in tables.items():
        bucketed(df, key, f"{folder}/{name}", n)
    schemas = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for name, (df, _) in tables.items()}
    write_text(nodes.sparkSession, f"{folder}/graph.json", json.dumps({"version": 1, "buckets": n, "schemas": schemas}))


def load(spark, folder: str, incoming: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a saved graph; with incoming, the edges are those in buckets of their targets."""
    told = json.loads(read_text(spark, f"{folder}/graph.json"))
    edges, key = ("edges_in", "dst") if incoming else ("edges", "src")
    tables = (("nodes", "id"), (edges, key))
    return tuple(bucketed_table(spark, f"{folder}/{name}", told["schemas"][name], by, told["buckets"]) for name, by in tables)
