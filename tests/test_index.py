"""The index that is updated against one that is built at once."""

import collections
import random

import pytest

from graphloom.operators import graph
from graphloom.operators.index import Index, facts_of
from graphloom.sources import scanner
from graphloom.streaming import incremental

SCHEMA = "path string, language string, text string"


def tree(rng, n=40):
    """Files with functions that call one another by name, some names defined in several places."""
    out = {}
    for i in range(n):
        body = "import os\n" + "".join(f"def f{rng.randint(0, 30)}(a):\n    f{rng.randint(0, 40)}(1)\n    g{rng.randint(0, 3)}()\n\n" for _ in range(rng.randint(0, 4)))
        out[f"d{i % 5}/m{i}.py"] = body
    return out


def frame(spark, files):
    return spark.createDataFrame([(p, "python", x) for p, x in files.items()], SCHEMA)


def whole(spark, files):
    functions, types, imports, calls = facts_of(scanner.scanned(frame(spark, files)))
    nodes, edges = graph.build(functions, types, imports, calls, frame(spark, files).select("path"))
    return nodes, graph.resolve(edges, nodes)


def bag(df):
    return collections.Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_updates_give_what_a_build_gives(spark, tmp_path):
    rng = random.Random(2)
    index, files = Index(spark, f"file://{tmp_path}/index"), tree(rng)
    assert index.update(frame(spark, files))["changed"] == len(files)
    assert index.update(frame(spark, files)) == {"changed": 0, "removed": 0, "resolved": 0} and index.epochs() == 1
    other = tree(random.Random(9))
    for k, p in enumerate(sorted(files)):
        if k % 4 == 0:
            del files[p]
        elif k % 4 == 1:
            files[p] = other[p]
    files["new/x.py"] = "def f3(b):\n    f5(b)\n"
    got = index.update(frame(spark, files))
    nodes, edges = whole(spark, files)
    for a, b in zip(index.graph(), (nodes, edges), strict=True):
        assert bag(a) == bag(b)
    assert got["removed"] == 10 and got["resolved"] < index.call_edges().count() + 40
    small = index.compact(f"file://{tmp_path}/small")
    assert bag(small.graph()[1]) == bag(edges) and small.epochs() == 1
    # One file changes: only its own calls and those to its names are looked at.
    files["new/x.py"] = "def only_here(b):\n    f5(b)\n"
    assert small.update(frame(spark, files))["resolved"] <= 1 + sum(x.count("f3(1)") for x in files.values())
    assert bag(small.graph()[1]) == bag(whole(spark, files)[1])


def test_a_failed_update_is_written_again(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/index")
    index.update(frame(spark, {"a.py": "def a():\n    b()\n"}))
    files = {"a.py": "def a():\n    b()\n", "b.py": "def b():\n    a()\n"}
    monkeypatch.setattr(Index, "resolve", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.update(frame(spark, files))
    monkeypatch.undo()
    assert index.epochs() == 1 and {r.path for r in index.live().collect()} == {"a.py"}
    index.update(frame(spark, files))
    assert bag(index.graph()[1]) == bag(whole(spark, files)[1])


def test_odd_files(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    rows = [(None, "go", "x"), ("a.go", "go", None), ("a.go", "go", "package p\nfunc A() { A() }\n"), ("b.txt", None, "text")]
    assert index.update(spark.createDataFrame(rows, SCHEMA))["changed"] == 2
    assert index.call_edges().count() == 1
    assert index.update(spark.createDataFrame([], SCHEMA))["removed"] == 2
    assert index.graph()[0].count() == 0


def test_an_index_follows_a_stream_of_changes(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/index"), str(tmp_path / "events")
    batches = ([("a.py", "def a():\n    b()\n", 1), ("b.py", "def b():\n    pass\n", 1)], [("b.py", "def c():\n    a()\n", 2), ("a.py", "def old():\n    x()\n", 0), ("a.py", "def a():\n    c()\n", 3)], [("b.py", None, 4), ("zz.py", None, 4)])
    for rows in batches:
        spark.createDataFrame(rows, "path string, content string, mtime int").selectExpr("path", "content", "timestamp_seconds(mtime) as mtime").write.mode("append").parquet(events)
        incremental.follow_code(spark, events, index, str(tmp_path / "mark")).awaitTermination()
    assert index.epochs() == 3 and bag(index.graph()[1]) == bag(whole(spark, {"a.py": "def a():\n    c()\n"})[1])


def test_a_graph_read_again_joins_no_calls(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    Index(spark, folder).update(frame(spark, {"a.py": "def a():\n    b()\n", "b.py": "def b():\n    pass\n"}))
    edges = Index(spark, folder).graph()[1]
    # Calls are read resolved: nothing is joined for those that build() would make of none.
    assert "ExistingRDD" not in edges._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.kind for r in edges.collect()) == [1, 3, 3]
