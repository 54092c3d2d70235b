from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources import code
from graphloom.streaming import incremental

FILES = {
    "main.go": 'package main\n\nimport "fmt"\n\nfunc main() {\n\thello("x")\n\tfmt.Println(1)\n}\n\nfunc hello(name string) {\n}\n\ntype User struct {\n}\n\nfunc (u *User) Greet(a int, b ...string) {\n\thello("u")\n}\n',
    "lib/a.py": "import os\nfrom typing import Any\n\n\ndef run(x, y):\n    helper()\n    # helper(1)\n\n\ndef helper():\n    pass\n\n\nclass Thing:\n    pass\n",
    "node_modules/x.js": "function hidden() {}\n",
    "out/gen.py": "def gone():\n    pass\n",
    "go.mod": "module m\n\nrequire (\n\tgithub.com/a/b v1.0.0\n\t// note\n\tgopkg.in/yaml.v3 v3.0.1\n)\nrequire single v1\n",
    "requirements.txt": "# c\nflask>=2\nnumpy\npandas[x]==1\n",
    "package.json": '{\n  "dependencies": {\n    "react": "1",\n    "left-pad": "2"\n  },\n  "name": "x"\n}\n',
    "Podfile": "pod 'Alamofire', '~> 5'\n",
    "Package.swift": '.package(url: "https://github.com/x/swift-nio.git", from: "2"),\n',
}


def tree(tmp_path):
    for name, body in FILES.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    return str(tmp_path)


def test_walk_leaves_out_ignored_files(spark, tmp_path):
    rules = code.ignore_rules(["# generated", "out/", "*.txt", "!requirements.txt"])
    got = {r.path for r in code.walked(spark, tree(tmp_path), rules).select("path").collect()}
    assert got == {"main.go", "lib/a.py", "go.mod", "requirements.txt", "package.json", "Podfile", "Package.swift"}


def test_facts_of_code_lines_build_a_graph(spark, tmp_path):
    files = code.walked(spark, tree(tmp_path), code.ignore_rules(["out/"]), only_code=True)
    facts = code.facts(code.decoded(files).filter(F.col("path").isin("main.go", "lib/a.py")))
    functions = {(r.path, r.name, r.param_count, r.receiver != "") for r in facts["functions"].collect()}
    assert functions == {("main.go", "main", 0, False), ("main.go", "hello", 1, False), ("main.go", "Greet", -1, True), ("lib/a.py", "run", 2, False), ("lib/a.py", "helper", 0, False)}
    assert {(r.name, r.kind) for r in facts["types"].collect()} == {("User", "struct"), ("Thing", "class")}
    assert {r.imp for r in facts["imports"].collect()} == {"fmt", "os", "typing"}
    calls = {(r.caller, r.callee, r.args) for r in facts["calls"].collect()}
    assert calls == {("main", "hello", 1), ("main", "Println", 1), ("Greet", "hello", 1), ("run", "helper", 0)}
    nodes, edges = graph.build(facts["functions"], facts["types"], facts["imports"], facts["calls"], facts["functions"].select("path").distinct())
    kept = graph.filter_calls(graph.resolve(edges, nodes), nodes).filter("kind = 1")
    assert kept.count() == 3


def test_manifests(spark, tmp_path):
    lines = code.lines_of(code.decoded(code.walked(spark, tree(tmp_path))))
    got = {(r.language, r.dep) for r in code.manifests(lines).collect()}
    assert got == {("go", "github.com/a/b"), ("go", "gopkg.in/yaml.v3"), ("python", "flask"), ("python", "numpy"), ("python", "pandas"), ("javascript", "react"), ("javascript", "left-pad"), ("swift", "Alamofire"), ("swift", "swift-nio")}


def test_change_lists(spark):
    stats = code.numstat(spark.createDataFrame([("3\t1\ta b.go",), ("-\t-\tx.png",), ("bad",)], "text string"))
    new = spark.createDataFrame([("n.go",)], "path string")
    got = sorted(tuple(r) for r in code.changes(stats, new).collect())
    assert got == [("a b.go", 3, 1, False), ("n.go", 0, 0, True), ("x.png", 0, 0, False)]


def test_source_slices(spark, tmp_path):
    files = code.walked(spark, tree(tmp_path))
    nodes = spark.createDataFrame([("a", 2, "lib/a.py", 5, 6), ("b", 0, "requirements.txt", 0, 0), ("c", 2, "lib/a.py", 14, 0), ("d", 2, "lib/a.py", 0, 0)], "id string, kind int, path string, line int, end_line int")
    got = {r.id: r.source for r in code.source_slice(files, nodes).collect()}
    assert got["a"] == "def run(x, y):\n    helper()" and got["b"] == FILES["requirements.txt"]
    assert got["c"].startswith("class Thing") and got["d"] is None
    assert [r.path for r in code.module_source(files, "lib").collect()] == ["lib/a.py"]


def test_the_index_follows_changes(spark, tmp_path):
    src, index, mark = (str(tmp_path / x) for x in ("src", "index", "mark"))
    schema = incremental.SCHEMA
    time = F.to_timestamp(F.col("t")).alias("mtime")
    for rows in ([("a", "1", "2024-01-01"), ("b", "1", "2024-01-01")], [("a", "2", "2024-01-02")]):
        spark.createDataFrame(rows, "path string, content string, t string").select("path", "content", time).write.mode("append").parquet(src)
        incremental.follow(spark, src, index, mark).awaitTermination()
    assert schema and {(r.path, r.content) for r in incremental.indexed(spark, index).collect()} == {("a", "2"), ("b", "1")}


def test_file_headers(spark):
    texts = ["// a\n\n# b\npackage x\n// c", "/* a\n b */\ncode", "code\n// a", "", "import x"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(code.file_header(F.col("t")).alias("x")).collect()]
    assert got == ["// a\n\n# b", "/* a\n b */", "", "", ""]
