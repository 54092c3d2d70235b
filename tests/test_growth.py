"""What grows with the tables: rows that move, rows that go to the driver and all tasks, files that stay."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom import folders
from graphloom.functions import text as t
from graphloom.operators import graph, sweep
from graphloom.operators.index import Index
from graphloom.plans import registry
from graphloom.sources import code

from .conftest import TINY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, moves", [("scan_functions", 1), ("scan_calls", 1), ("scan_types", 0), ("extract_functions", 1), ("extract_imports", 2), ("extract_calls", 1)])
def test_scanned_facts_do_not_move(spark, name, moves, monkeypatch):
    """Order lines meet once, and counts of imports; scan_types reads a table that it has written."""
    monkeypatch.setattr(sweep, "containing", lambda *_: 1 / 0)
    if moves:
        monkeypatch.setattr(code, "written", lambda *_: 1 / 0)
    assert plan(registry.queries()[name](spark, TINY)).count("Exchange hashpartitioning") == moves


def test_parameters_are_counted_whatever_stands_around_commas(spark):
    cases = {"()": 0, "( )": 0, "(a)": 1, "(a, b)": 2, "(a,)": 2, "(a: Dict[str, int], b=\")\")": 2, "(a (b, c), d)": 2, "(a <b, c>, d)": 2, "(f func(int, int) (x, y), g)": 2, "(a -> b, c)": 1, "(a, ...b)": -1, "(*args, a)": -1, "": 0, "a, b": 2, "(\n a,\n b\n)": 2}
    rows = spark.createDataFrame(list(cases.items()), "x string, n int")
    got = rows.select("x", t.count_params(F.col("x")).alias("n"))
    assert {r.x: r.n for r in got.collect()} == cases
    # Where there are no brackets inside, nothing is walked through.
    assert got._jdf.queryExecution().optimizedPlan().expressions().toString().count("^,*$") == 1


def test_an_index_sends_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "SENT", 0)
    seen = []
    monkeypatch.setattr(Index, "append", lambda self, name, rows, epoch, was=Index.append: seen.append(plan(rows)) or was(self, name, rows, epoch))
    index = Index(spark, f"file://{tmp_path}/index")
    for k in (1, 2):
        index.update(spark.createDataFrame([(f"d{i % 3}/m{i}.py", "python", f"def f{i * k}(a):\n    f{i + k}(1)\n") for i in range(40)], "path string, language string, text string"))
    nodes, edges = index.graph()
    assert len(seen) == 6 and not any("Broadcast" in x for x in [*seen, plan(nodes), plan(edges), plan(index.call_edges())])


def test_filtering_calls_sends_no_nodes_to_the_driver(spark):
    assert "Broadcast" not in plan(registry.queries()["filter_calls_imported"](spark, TINY))


def left(spark):
    return {f for d in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()) for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


@pytest.mark.parametrize("reverse", [False, True])
def test_levels_leave_no_shuffle_files(spark, reverse):
    edges = spark.range(500).select((F.col("id") % 50).alias("src"), ((F.col("id") * 7 + 1) % 50).alias("dst"))
    before = left(spark)
    got = graph.levels(edges, spark.createDataFrame([(0,), (1,)], "root long"), reverse=reverse)
    for _ in range(100):
        if not (more := {f for f in left(spark) - before if os.path.exists(f)}):
            break
        time.sleep(0.1)
    assert not more and got.count() == 8


def test_rows_in_buckets_are_one_and_move_once(spark, monkeypatch):
    rows = spark.range(100).select((F.col("id") % 7).alias("node"), (F.col("id") % 3).alias("next"))
    assert folders.bucketed(rows, "node", once=True).count() == 21 and folders.bucketed(rows, "node").count() == 100
    assert plan(rows.repartition(4, "node").distinct().sortWithinPartitions("node")).count("Exchange hashpartitioning") == 1


def test_calls_are_counted_in_files_and_over_files_of_one_path(spark):
    text = "def a():\n    b(1)\n    x.b(2)\n    b(3)\nb(4)\n"
    for rows, times in (([("a.py", "python", text), ("b.py", "python", "b()\n" * 3)], 1), ([("a.py", "python", text)] * 2 + [("b.py", "python", "b()\n" * 3)], 2)):
        files = spark.createDataFrame(rows, "path string, language string, text string")
        got = {tuple(r) for r in code.call_counts(files, "caller", "callee", "args").collect()}
        assert got == {("a.py", "a", "b", 1, 3 * times), ("a.py", None, "b", 1, times), ("b.py", None, "b", 0, 3)}
