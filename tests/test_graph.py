"""Golden facts of three small projects, and the traversals on small graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph

# path: name/params; * has a receiver
FACTS = {
    "go": {
        "functions": {"main.go": "main/0 hello/1 add/2 process/0 helper/0 nested/0", "types.go": "NewUser/2 Greet/0* AddUser/1* ProcessAll/-1*"},
        "types": {"types.go": "User Service"},
        "imports": {"main.go": "fmt"},
        "calls": {
            "main.go": "main>hello/1 main>Println/1 main>add/2 main>Printf/2 main>process/0 process>helper/0 helper>nested/0 nested>Println/1",
            "types.go": "Greet>hello/1 AddUser>append/2 ProcessAll>Greet/0",
        },
        "expected": (15, 19),
    },
    "python": {
        "functions": {
            "main.py": "main/0 hello/1 add/2 process/0 helper/0 nested/0 variadic_func/-1",
            "classes.py": "__init__/3 greet/1 add_user/2 process_all/1 _private_method/1 create_user/2",
        },
        "types": {"classes.py": "User Service"},
        "imports": {"main.py": "typing", "classes.py": "typing main"},
        "calls": {
            "main.py": "main>hello/1 main>print/1 main>add/2 main>print/1 main>process/0 process>helper/0 helper>nested/0 nested>print/1 >main/0",
            "classes.py": "greet>hello/1 add_user>append/1 process_all>greet/0 create_user>User/2",
        },
        "expected": (19, 23),
    },
    "typescript": {
        "functions": {
            "main.ts": "main/0 hello/1 add/2 process/0 helper/0 nested/0 variadicFunc/-1",
            "types.ts": "constructor/2 greet/0 addUser/1 processAll/0 createUser/2",
        },
        "types": {"types.ts": "IUser User Service"},
        "imports": {"types.ts": "./main"},
        "calls": {
            "main.ts": "main>hello/1 main>log/1 main>add/2 main>log/1 main>process/0 process>helper/0 helper>nested/0 nested>log/1 >main/0",
            "types.ts": "greet>hello/1 addUser>push/1 processAll>greet/0",
        },
        "expected": (18, 22),
    },
}


def tables(spark, f):
    functions = [(p, i, x.split("/")[0], "r" if x.endswith("*") else "", int(x.rstrip("*").split("/")[1])) for p, s in f["functions"].items() for i, x in enumerate(s.split())]
    types = [(p, i, x, "class") for p, s in f.get("types", {}).items() for i, x in enumerate(s.split())]
    imports = [(p, i, x) for p, s in f.get("imports", {}).items() for i, x in enumerate(s.split())]
    calls = [(p, i, x.split(">")[0], x.split(">")[1].split("/")[0], int(x.split("/")[1])) for p, s in f.get("calls", {}).items() for i, x in enumerate(s.split())]
    return (
        spark.createDataFrame(functions, "path string, ord int, name string, receiver string, param_count int"),
        spark.createDataFrame(types, "path string, ord int, name string, kind string"),
        spark.createDataFrame(imports, "path string, ord int, imp string"),
        spark.createDataFrame(calls, "path string, ord int, caller string, callee string, args int"),
        spark.createDataFrame([(p,) for p in f["functions"]], "path string"),
    )


def built(spark, f):
    nodes, edges = graph.build(*tables(spark, f))
    return nodes, graph.filter_calls(graph.resolve(edges, nodes), nodes)


@pytest.mark.parametrize("lang", FACTS)
def test_golden_projects(spark, lang):
    nodes, edges = built(spark, FACTS[lang])
    assert (nodes.count(), edges.count()) == FACTS[lang]["expected"]
    calls = edges.filter("kind = 1").join(nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    assert {("main", "hello"), ("main", "add"), ("main", "process"), ("process", "helper"), ("helper", "nested")} <= {(r.a, r.b) for r in calls.collect()}


@pytest.mark.parametrize(
    ("functions", "imports", "calls", "kept"),
    [
        ({"a/x.go": "main/0", "b/y.go": "F/1"}, {"a/x.go": "m/b"}, {"a/x.go": "main>F/1"}, 1),
        ({"a/x.go": "main/0", "b/y.go": "F/1"}, {"a/x.go": "m/b"}, {"a/x.go": "main>F/2"}, 0),
        ({"a/x.go": "main/0", "b/y.go": "F/-1"}, {"a/x.go": "m/b"}, {"a/x.go": "main>F/7"}, 1),
        ({"c/x.go": "main/0", "c/y.go": "F/0"}, {}, {"c/x.go": "main>F/0"}, 0),
        ({"c/x.go": "main/0", "c/y.go": "F/0", "b/z.go": "F/0"}, {"c/x.go": "m/c"}, {"c/x.go": "main>F/0"}, 1),
        ({"d/x.go": "main/0", "c/y.go": "F/0", "b/z.go": "F/0"}, {"d/x.go": "m/c"}, {"d/x.go": "main>F/0"}, 0),
    ],
)
def test_calls_between_files(spark, functions, imports, calls, kept):
    _, edges = built(spark, {"functions": functions, "imports": imports, "calls": calls})
    assert edges.filter("kind = 1").count() == kept


def test_a_function_and_a_type_of_one_name_share_a_node(spark):
    nodes, edges = built(spark, {"functions": {"a.go": "Foo/0"}, "types": {"a.go": "Foo"}})
    assert nodes.filter("name = 'Foo'").select("kind").collect() == [(2,)]
    assert edges.filter("kind = 3").count() == 2


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_levels_of_a_cycle_and_parallel_edges(spark):
    e = _edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")])
    roots = spark.createDataFrame([("a",)], "root string")
    assert sorted((r.node, r.depth) for r in graph.levels(e, roots, 5).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted((r.node, r.depth) for r in graph.levels(e, roots, 1, reverse=True).collect()) == [("a", 0), ("c", 1)]
    assert graph.all_paths(e, "a", "b").count() == 2


def test_bounds_count_nodes_for_paths_and_hops_for_levels(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert graph.shortest_path(e, "a", "d", 3).collect() == []
    assert [tuple(r) for r in graph.shortest_path(e, "a", "d", 4).collect()] == [(["a", "b", "c", "d"], 3)]
    assert graph.shortest_path(e, "a", "a").first()["length"] == 0
    assert graph.levels(e, spark.createDataFrame([("a",)], "root string"), 3).agg(F.max("depth")).first()[0] == 3


def test_the_last_range_holds_a_line(spark):
    ranges = spark.createDataFrame([("p", 0, "outer", 1, 9), ("p", 1, "inner", 3, 5)], "path string, ord int, name string, start_line int, end_line int")
    calls = spark.createDataFrame([("p", 4), ("p", 8), ("p", 20)], "path string, call_line int")
    assert sorted((r.call_line, r.caller) for r in graph.containing(calls, ranges).collect()) == [(4, "inner"), (8, "outer")]


def test_tables_survive_a_round_trip(spark, tmp_path):
    nodes, edges = built(spark, FACTS["go"])
    graph.save(nodes, edges, str(tmp_path))
    n, e = graph.load(spark, str(tmp_path))
    assert (n.count(), e.count()) == FACTS["go"]["expected"]


def test_traced_paths(spark):
    nodes = spark.createDataFrame([(x, 2, f"name_{x}", "p") for x in "abcdefgz"], "id string, kind int, name string, path string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "d", 0), ("c", "d", 1), ("b", "d", 3), ("d", "e", 1), ("e", "a", 1), ("f", "g", 4), ("g", "g", 1)], "src string, dst string, kind int")
    froms, tos = (spark.createDataFrame([(x,) for x in ids], f"{name} string") for ids, name in ((["a", "f", "z"], "root"), (["a", "e", "g", "z"], "node")))
    assert sorted(tuple(r) for r in graph.trace(edges, froms, tos, 5).collect()) == [("a", "e", 3), ("f", "g", 1)]
    assert sorted(tuple(r) for r in graph.trace(edges, froms, tos, 3).collect()) == [("f", "g", 1)]
    assert sorted(tuple(r) for r in graph.traced(edges, froms, tos, 5).collect()) == [(0, "a", 1), (1, "b", 0), (2, "d", 1), (3, "e", None)]
    assert sorted(tuple(r) for r in graph.traced(edges, froms, tos, 2).collect()) == [(0, "f", 4), (1, "g", None)]
    assert graph.traced(edges, froms, tos, 1).count() == 0
    got = graph.find_path(nodes, edges, "NAME_A", "name_e").orderBy("step").collect()
    assert [(r.step, r.name, r.edge_kind) for r in got] == [(0, "name_a", 1), (1, "name_b", 0), (2, "name_d", 1), (3, "name_e", None)]


def test_saved_edges_are_joined_where_they_lie(spark, tmp_path):
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}", 1) for i in range(200)], "src string, dst string, kind int")
    nodes = spark.createDataFrame([(f"n{i}", 2, f"x{i}", "p") for i in range(200)], "id string, kind int, name string, path string")
    graph.save(nodes, edges, f"file://{tmp_path}/g", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for incoming, key in ((False, "src"), (True, "dst")):
            n, e = graph.load(spark, f"file://{tmp_path}/g", incoming)
            joined = e.join(n, e[key] == n["id"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
