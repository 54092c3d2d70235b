"""Tables that change by key, and what is kept in them."""

import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import providers
from graphloom.operators.tables import AnswerStore, Keyed, VectorTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_newest_row_counts(spark, tmp_path):
    table = Keyed(spark, "k string, n int", f"file://{tmp_path}/t")
    assert table.read().count() == 0 and table.versions() == 0
    table.put(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, n int"))
    table.drop(spark.createDataFrame([("a",), ("zzz",)], "k string"))
    table.put(spark.createDataFrame([("c", 3), ("b", 1)], "k string, n int"))
    assert rows(table.read()) == [("b", 1), ("c", 3)] and rows(table.read(1)) == [("a", 1), ("b", 2)]
    assert rows(table.has(spark.createDataFrame([("a",), ("c",), ("c",)], "k string"))) == [("a", False), ("c", True), ("c", True)]
    table.compact()
    assert rows(Keyed(spark, "k string, n int", table.folder).read()) == [("b", 1), ("c", 3)] and len(table.read().inputFiles()) > 0
    table.put(spark.createDataFrame([("a", 9)], "k string, n int"))
    assert rows(table.read()) == [("a", 9), ("b", 1), ("c", 3)]
    table.clear()
    assert table.count() == 0
    with pytest.raises(Exception, match="a key is null"):
        table.put(spark.createDataFrame([(None, 9)], "k string, n int"))
    table.put(spark.createDataFrame([("d", 9)], "k string, n int"))  # writes the failed version anew
    assert rows(table.read()) == [("d", 9)]


def test_vectors(spark, tmp_path):
    schema = "node_id string, vector array<double>, text string"
    table = VectorTable(spark, f"file://{tmp_path}/v")
    assert table.dimension() == 0 and table.nearest([1.0], 3).count() == 0
    table.add(spark.createDataFrame([], schema))
    table.add(spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")], schema))
    assert table.dimension() == 2 and table.count() == 2
    for bad, text in (([1.0], "2 dimensions"), ([], "empty"), (None, "empty")):
        with pytest.raises(ValueError, match=text):
            table.add(spark.createDataFrame([("c", bad, "")], schema))
    with pytest.raises(ValueError, match="2 dimensions"):
        table.nearest([1.0], 3)
    with pytest.raises(KeyError):
        table.remove(spark.createDataFrame([("a",), ("nope",)], "node_id string"))
    assert [r.node_id for r in table.nearest([1.0, 0.1], 1).collect()] == ["a"]
    table.remove(spark.createDataFrame([("a",)], "node_id string"))
    assert [r.node_id for r in table.nearest([1.0, 0.1], 5).collect()] == ["b"]
    other = table.save(f"file://{tmp_path}/saved")
    table.clear()
    assert table.count() == 0 and table.dimension() == 2
    loaded = VectorTable(spark, other.folder)
    assert rows(loaded.read()) == [("b", [0.0, 1.0], "y")] and loaded.dimension() == 2


def test_answers(spark, tmp_path):
    schema = "key string, operation string, model string, response string, created_at timestamp, tokens long"
    day = lambda n: datetime.datetime(2024, 1, n)
    store = AnswerStore(spark, f"file://{tmp_path}/a", ttl_days=7)
    store.set(spark.createDataFrame([("a", "explain", "m", "old", day(1), 1), ("b", "explain", "m", "néw", day(20), 2)], schema))
    now = F.lit(day(25))
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    assert [(r.key, r.response, r.hit) for r in sorted(store.get(asked, now).collect())] == [("a", None, False), ("b", "néw", True), ("b", "néw", True), ("c", None, False)]
    assert store.stats() == {"hits": 2, "misses": 2, "writes": 2, "evictions": 0, "bytes": 7, "hit_rate": 0.5} and store.size() == 1
    store.set(spark.createDataFrame([("c", "explain", "m", "x", day(2), 1)], schema))
    store.clean(now)
    assert store.size() == 1 and store.stats()["evictions"] == 1
    store.delete(spark.createDataFrame([("b",)], "key string"))
    assert store.size() == 0
    for_ever = AnswerStore(spark, f"file://{tmp_path}/b")
    for_ever.set(spark.createDataFrame([("a", "explain", "m", "old", day(1), 1)], schema))
    assert for_ever.get(asked, now).filter("hit").count() == 1
    for_ever.clear()
    assert for_ever.size() == 0 and for_ever.stats()["evictions"] == 1


class Moody(providers.Mock):
    """Fails for some texts, or for all after a while."""

    def __init__(self, bad=(), broken=False):
        self.bad, self.broken = bad, broken

    def embed(self, text):
        if self.broken or any(b in text for b in self.bad):
            raise RuntimeError("no")
        return [float(len(text)), 1.0]


def test_embedding_goes_on_where_it_ended(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", (0, 1, 2, 3, 4)[i % 5], f"name{i}", "sign", "", "p") for i in range(40)] + [("empty", 2, "", "", "", "")], "id string, kind int, name string, signature string, doc string, path string")
    table = VectorTable(spark, f"file://{tmp_path}/v")

    class Breaks(VectorTable):
        def add(self, found):
            if self.versions() == 2:
                raise OSError("lost")
            super().add(found)

    with pytest.raises(OSError, match="lost"):
        providers.embed_graph(nodes, Breaks(spark, table.folder), Moody(), parts=4, wait=0)
    done = table.count()
    assert 0 < done < 24
    got = providers.embed_graph(nodes, table, Moody(bad=("name2:", "name7\n")), parts=4, wait=0)
    failed = 24 - table.count()
    assert got == {"embedded": 24 - done - failed, "skipped": 1, "failed": failed, "total": 25 - done} and failed <= 1
    assert providers.embed_graph(nodes, table, Moody(), parts=4, wait=0)["embedded"] == failed
    assert providers.embed_graph(nodes, table, Moody(broken=True), wait=0) == {"embedded": 0, "skipped": 1, "failed": 0, "total": 1}
    assert table.count() == 24 and providers.embed_graph(nodes, table, Moody(), skip_existing=False, wait=0)["embedded"] == 24


def test_waits_double(monkeypatch):
    slept = []
    monkeypatch.setattr(providers.time, "sleep", slept.append)
    assert providers.retried(lambda _: 1 / 0, "x", retries=4, wait=0.5) is None and slept == [0.5, 1, 2, 4]
