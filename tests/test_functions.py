import pytest
from pyspark.sql import functions as F

from graphloom.functions import prompts
from graphloom.functions import text as t
from graphloom.operators import answers, folds, providers, search
from graphloom.plans import registry

from .conftest import TINY


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "ext"), [("a/b.tar.gz", ".gz"), ("gopkg.in/yaml.v3", ".v3"), ("github.com/a/b", "")])
def test_extension(spark, path, ext):
    assert value(spark, t.ext(F.lit(path))) == ext


@pytest.mark.parametrize(("params", "n"), [("", 0), ("()", 0), ("(a int, b func(int, int))", 2), ("(xs ...int)", -1), ("(self, *args)", -1), ("(a, b, c)", 3)])
def test_parameters(spark, params, n):
    assert value(spark, t.count_params(F.lit(params))) == n


@pytest.mark.parametrize(("args", "n"), [("()", 0), ("( )", 0), ("(a, f(b, c))", 3), ("(a)", 1)])
def test_arguments(spark, args, n):
    assert value(spark, t.count_args(F.lit(args))) == n


@pytest.mark.parametrize(("name", "norm"), [("./foo.js", "js"), (".utils", ".utils"), ("pkg/Doc_5", "doc_5"), ("os.path", "path"), ("'x'", "x")])
def test_normal_import(spark, name, norm):
    assert value(spark, t.normal_import(F.lit(name))) == norm


def test_scalars(spark):
    assert value(spark, t.text_tokens(F.lit("héllo, wörld x+y"))) == 7
    assert value(spark, t.node_id(F.lit("a.go"), F.lit("main"))) == "101b5ba66488d3ce5f7c826ad2234001"
    assert value(spark, t.dependency_name(F.lit("github.com/x/y/v2"))) == "y"
    assert value(spark, t.system_name(F.lit("src/my_mod/a"))) == "My Mod"
    assert value(spark, t.receiver_type(F.lit("(s *Server)"))) == "Server"
    assert value(spark, t.human_size(F.lit(1536))) == "1.5KB"
    assert value(spark, t.human_tokens(F.lit(12500))) == "12.5k"
    assert value(spark, t.field_names(F.lit("a int\n// no\nb: string,"))) == ["a", "b"]
    assert value(spark, t.package_of(F.lit("main.go"))) == ""
    assert value(spark, t.is_exported(F.lit("Éa"), F.lit("go"))) is True
    assert value(spark, t.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_mock_embedding_is_its_closed_form(spark):
    got = value(spark, t.mock_embedding(F.lit("añb")))
    offsets, sizes = [], 0
    for c in "añb":
        offsets.append((ord(c), sizes))
        sizes += len(c.encode())
    assert got == [sum(c * (i + at + 1) for c, at in offsets) % 1000 / 1000 for i in range(768)]


def test_truncation(spark):
    cut = value(spark, t.truncated(F.lit("word " * 50), 10))
    assert cut.cut and cut.text == ("word " * 8)[:39] + " ... (truncated)"
    assert value(spark, t.truncated(F.lit("short"), 10)).cut is False


def test_budget(spark):
    assert value(spark, answers.allocated(F.array(*map(F.lit, (5, 7, 2, 4))), 10)) == [5, 0, 2, 0]


def test_fusion_of_equal_ranks(spark):
    one = spark.createDataFrame([("n", 1.0)], "node_id string, score double")
    assert search.fused(one, one.withColumn("reason", F.lit("exact")), 5).first()["score"] == pytest.approx(1 / 60, abs=1e-9)


def test_vector_search_rejects_what_does_not_fit(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "node_id int, vector array<double>")
    assert [tuple(r) for r in search.nearest(v, [2.0, 0.0], 2).collect()] == [(2, 1.0), (1, 0.0)]
    with pytest.raises(ValueError):
        search.nearest(v, [], 1)
    with pytest.raises(Exception):
        search.nearest(v, [1.0], 1).collect()


def test_answers_come_from_the_cache_or_the_provider(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    requests = spark.createDataFrame([("h1", "p1"), ("h2", "p22"), ("h2", "p22")], "content_hash string, prompt string")
    keyed = requests.select(t.cache_key(F.col("content_hash"), F.lit("explain"), F.lit("mock")).alias("key"), "content_hash")
    cache = keyed.filter("content_hash = 'h1'").select("key", F.lit("old").alias("response"), F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"))
    got = sorted((r.from_cache, r.response) for r in providers.answered(requests, cache, now).collect())
    assert got == [(False, "A mock answer to 3 characters."), (True, "old")]


def test_folds_of_one_long_group(spark):
    """A group's hash and budget are those of the array functions, and no plan collects a group."""
    rows = spark.createDataFrame([(None if i == 5 else "m" if i % 3 else "n", i, None if i == 7 else f"part {i}\nx" * 150) for i in range(400)], "k string, at int, x string").repartition(5)
    hashed = folds.joined_hash(rows, F.col("k"), F.col("at"), prompts.section(F.col("k"), F.col("x")), prompts.summary_head(F.col("key")), prompts.BETWEEN, "")
    whole = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", F.col("k").alias("path"), F.col("x").alias("source")))).alias("all"))
    assert {tuple(r) for r in hashed.collect()} == {tuple(r) for r in whole.select("k", F.sha2(prompts.summarize(F.col("k"), F.col("all")), 256)).collect()}
    turns = spark.range(20_000).select((F.col("id") % 2).alias("c"), F.col("id").alias("turn"), (F.col("id") % 7).alias("n")).repartition(5)
    got, left = {}, {0: 40_000, 1: 100}
    for i in range(20_000):
        got[i] = i % 7 if i % 7 <= left[i % 2] else 0
        left[i % 2] -= got[i]
    assert {r.turn: r.allocated for r in folds.allocated(turns.filter("c = 1"), "c", "turn", F.col("n"), 100).collect()} == {i: n for i, n in got.items() if i % 2}


@pytest.mark.parametrize("name", ["summarize_prompts", "module_hashes", "manifest_deps", "token_budget"])
def test_no_row_holds_a_whole_group(spark, name):
    plan = registry.queries()[name](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
