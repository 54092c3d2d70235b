"""An index of a source tree that is brought up to date by what changed.

Its tables are logs in a folder; every update writes rows under its own number, the epoch, and nothing is rewritten:

    files     path, language, hash, gone   a row for each file that was added, changed or removed
    facts     what the scanner found in the added and changed files
    resolved  call edges: of these files, and of calls elsewhere to a name whose definitions changed

The newest row of a path says which epoch its facts are of; facts of other epochs are dead. A call edge is known by its path
and place; its newest row counts. An update scans the changed files only, and resolves again only the calls
whose answer may differ. What is joined with the logs goes to all tasks only if it has few rows. An update that fails leaves no commit file, and the next one writes under the same
number; compact() writes what is alive into a new folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import beside, counted, exists, write_text, written
from ..functions import text as t
from ..functions.fixed import CALLS
from ..sources import code, scanner
from . import graph

FILES = "path string, language string, hash string, gone boolean"
RESOLVED = "path string, ord int, src string, dst string, callsite string, arg_count int"


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- logs --------------------------------------------------------------------------------------

    def epochs(self) -> int:
        """How many updates are complete."""
        n = 0
        while exists(self.spark, f"{self.folder}/commits/{n}.json"):
            n += 1
        return n

    def log(self, name: str, schema: str, more: int = 0) -> DataFrame:
        """All complete rows of a log with their epoch; `more` epochs beyond the complete ones."""
        n = self.epochs() + more
        paths = [p for k in range(n) if exists(self.spark, p := f"{self.folder}/{name}/epoch={k}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, epoch int")
        return self.spark.read.schema(f"{schema}, epoch int").option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def append(self, name: str, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def live(self, more: int = 0) -> DataFrame:
        """path, language, hash, epoch of the files that are there."""
        newest = self.log("files", FILES, more).groupBy("path").agg(F.max_by(F.struct("language", "hash", "gone", "epoch"), "epoch").alias("x"))
        return newest.filter("not x.gone").select("path", "x.language", "x.hash", "x.epoch")

    def facts(self, more: int = 0) -> DataFrame:
        """The scanner's facts of the files that are there."""
        return self.log("facts", scanner.FACTS, more).join(beside(self.live(more).select("path", "epoch")), ["path", "epoch"])

    # -- reading -----------------------------------------------------------------------------------

    def call_edges(self) -> DataFrame:
        """src, dst, callsite, arg_count, path, ord of all calls, a bag."""
        newest = self.log("resolved", RESOLVED).groupBy("path", "ord").agg(F.max_by(F.struct("src", "dst", "callsite", "arg_count", "epoch"), "epoch").alias("x"))
        # A file's own rows are rewritten with it, so what is older than the file belongs to its former content.
        alive = newest.join(beside(self.live().select("path", F.col("epoch").alias("since"))), "path").filter("x.epoch >= since")
        return alive.select("path", "ord", "x.src", "x.dst", "x.callsite", "x.arg_count").filter("src is not null")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, calls resolved, as graph.build() and graph.resolve() would give them of all files at once."""
        functions, types, imports, _ = facts_of(self.facts())
        none = functions.select("path", "ord", F.col("name").alias("caller"), F.col("name").alias("callee"), F.lit(0).alias("args")).filter(F.lit(False))
        nodes, edges = graph.build(functions, types, imports, none, self.live().select("path"))
        calls = self.call_edges().select("src", "dst", F.lit(CALLS).alias("kind"), "callsite", "arg_count")
        return nodes, edges.unionByName(calls)

    # -- writing -----------------------------------------------------------------------------------

    def update(self, files: DataFrame) -> dict[str, int]:
        """Brings the index up to date with files(path, language, text), all of a tree; returns how many were added or changed, removed, and calls resolved.

        A path that comes twice has its greater text; null paths are left out, a null text is empty.
        """
        files = files.filter("path is not null").groupBy("path").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "language")).alias("x")).select("path", "x.language", "x.text")
        now = files.select("path", "language", F.sha2("text", 256).alias("hash"))
        return self.apply(files, now.join(self.known().hint("merge"), "path", "full_outer"))

    def change(self, files: DataFrame) -> dict[str, int]:
        """The same, of only those files(path, language, text) that may have changed; a null text is a file that is gone."""
        files = files.filter("path is not null").groupBy("path").agg(F.max(F.struct("text", "language")).alias("x")).select("path", "x.language", "x.text")
        now = files.select("path", "language", F.sha2("text", 256).alias("hash"))
        return self.apply(files, now.join(beside(self.known()), "path", "left").filter("hash is not null or was is not null"))

    def known(self) -> DataFrame:
        return self.live().select("path", F.col("hash").alias("was"), F.col("language").alias("had"))

    def apply(self, files: DataFrame, both: DataFrame) -> dict[str, int]:
        """One epoch: of both(path, language, hash, was, had), what differs."""
        epoch = self.epochs()
        differs = F.col("was").isNull() | F.col("hash").isNull() | (F.col("hash") != F.col("was")) | ~F.col("language").eqNullSafe(F.col("had"))
        delta = written(both.filter(differs).select("path", "language", "hash", F.col("hash").isNull().alias("gone")))
        counts = {bool(r[0]): r[1] for r in delta.groupBy("gone").count().collect()}
        if not counts:
            return {"changed": 0, "removed": 0, "resolved": 0}
        rows = sum(counts.values())
        paths = beside(delta.select("path"), rows)
        before = self.facts()
        changed = files.join(beside(delta.filter("not gone").select("path"), rows), "path", "left_semi")
        self.append("files", delta, epoch)
        self.append("facts", scanner.scanned(changed), epoch)
        after = self.facts(more=1)
        names = [x.filter("kind = 'function'").join(paths, "path", "left_semi").select("name") for x in (before, after)]
        resolved = self.resolve(after, paths, counted(names[0].unionByName(names[1]).distinct()))
        self.append("resolved", resolved, epoch)
        out = {"changed": counts.get(False, 0), "removed": counts.get(True, 0), "resolved": self.spark.read.parquet(f"{self.folder}/resolved/epoch={epoch}").count()}
        write_text(self.spark, f"{self.folder}/commits/{epoch}.json", json.dumps(out))
        return out

    def resolve(self, facts: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
        """RESOLVED rows of the calls in these paths and of those to these names."""
        functions, _, _, calls = facts_of(facts)
        callee, package = F.col("name").alias("callee"), t.package_of(F.col("path")).alias("package")
        own = calls.join(paths.withColumn("_own", F.lit(True)), "path", "left").join(names.select(callee, F.lit(True).alias("_name")), "callee", "left")
        todo = written(own.filter("_own or _name").drop("_own", "_name"))
        # Of definitions only those of a called name have a part in the answer.
        wanted = counted(todo.select(F.col("callee").alias("name")).distinct())
        some = written(functions.join(wanted, "name", "left_semi").select("path", "name", t.node_id(F.col("path"), F.col("name")).alias("id")))
        # As graph.resolve() takes them; each name meets each call once.
        here = beside(some.select("path", callee, F.col("id").alias("_here")))
        one = counted(some.groupBy(callee).agg(F.count("*").alias("n"), F.min("id").alias("any"), F.max(F.col("path") == "").alias("blank")))
        near = counted(some.groupBy(callee, package).agg(F.min(F.struct("path", "id"))["id"].alias("same_package")))
        found = todo.withColumn("package", t.package_of(F.col("path"))).join(here, ["path", "callee"], "left").join(one, "callee", "left").join(near, ["callee", "package"], "left")
        chosen = F.when(F.col("blank"), None).when(F.col("n") == 1, F.col("any")).otherwise(F.col("same_package"))
        dst = F.coalesce("_here", chosen, t.node_id(F.lit(""), F.col("callee")))
        return found.select("path", "ord", t.node_id(F.col("path"), F.col("caller")).alias("src"), dst.alias("dst"), F.col("callee").alias("callsite"), F.col("args").alias("arg_count"))

    def compact(self, folder: str) -> Index:
        """The same state in a new folder, in one epoch."""
        out = Index(self.spark, folder)
        out.append("files", self.live().select("path", "language", "hash", F.lit(False).alias("gone")), 0)
        out.append("facts", self.facts().drop("epoch"), 0)
        out.append("resolved", self.call_edges().select("path", "ord", "src", "dst", "callsite", "arg_count"), 0)
        write_text(self.spark, f"{out.folder}/commits/0.json", "{}")
        return out


def facts_of(seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """functions, types, imports and calls, for graph.build(), of scanned facts of files whose paths differ."""
    once = seen.filter("first")
    functions = once.filter("kind = 'function'").select("path", "ord", "name", F.col("detail").alias("receiver"), t.count_params(F.col("params")).alias("param_count"))
    types = once.filter("kind = 'type'").select("path", "ord", "name", F.col("detail").alias("kind"))
    imports = once.filter("kind = 'import'").select("path", "ord", F.col("name").alias("imp"))
    calls = seen.filter("kind = 'call' and caller is not null").select("path", "ord", "caller", F.col("name").alias("callee"), "args")
    return functions, types, imports, calls
