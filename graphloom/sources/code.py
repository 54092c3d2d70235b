"""Source trees: walking, ignore rules, facts of code files, manifests and change lists.

Files are read by Spark's binaryFile and text readers. In the six languages whose calls are followed, declarations
and calls come from tokens and matched brackets (scanner.py), and so does the function around a call. In the other ten, lines are matched by one regular expression for each language, in generated code: declarations
spread over lines are found by their first line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import fixed
from ..functions import text as t
from ..operators import sweep
from . import scanner

#: For each language that the scanner doesn't read: name and parameters of a function.
FUNCTIONS = {
    "c_sharp": r"^\s*()(?:(?:public|private|protected|static|final|abstract|override|virtual|async)\s+)+(?:[\w<>\[\],.?]+\s+)?(\w+)\s*(\([^()]*\))",
    "c": r"^()[A-Za-z_][\w\s*&:<>]*?\b(\w+)\s*(\([^;]*\))\s*\{?$",
    "ruby": r"^\s*()def\s+(?:self\.)?(\w+[?!]?)\s*(\(.*\))?",
    "swift": r"^\s*()(?:\w+\s+)*func\s+(\w+)\s*(\(.*?\))",
    "bash": r"^\s*()(?:function\s+)?(\w+)\s*(\(\))",
    "kotlin": r"^\s*()(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)\s*(\(.*?\))",
    "php": r"^\s*()(?:\w+\s+)*function\s+(\w+)\s*(\(.*?\))",
    "dart": r"^\s*()(?:[\w<>?]+\s+)(\w+)\s*(\([^;]*\))\s*(?:async\s*)?\{",
    "r": r"^\s*()(\w[\w.]*)\s*<-\s*function\s*(\(.*\))",
}
FUNCTIONS |= {"cpp": FUNCTIONS["c"]}
TYPES = r"^\s*(?:(?:export|public|private|abstract|final|sealed|pub|open|data|default)\s+)*(class|interface|struct|enum|trait|protocol)\s+(\w+)"
IMPORTS = {
    "c": r"""^\s*#include\s+[<"]([^>"]+)[>"]""",
    "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",
    "swift": r"^\s*import\s+(\w+)",
    "bash": r"^\s*(?:source|\.)\s+(\S+)",
    "kotlin": r"^\s*import\s+([\w.]+)",
    "php": r"^\s*use\s+([\w\\]+)",
    "dart": r"""^\s*import\s+['"]([^'"]+)['"]""",
    "r": r"^\s*(?:library|require)\((\w+)\)",
    "c_sharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
}
IMPORTS |= {"cpp": IMPORTS["c"]}


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """Regular expressions on relative paths, and whether each takes files back in, of the lines of an ignore file."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.lstrip("!")
        inside, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        parts = re.split(r"(\*\*/|\*\*|\*|\?)", line.lstrip("/"))
        kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(kinds.get(p) or re.escape(p) for p in parts)
        rules.append(("^" + ("" if anchored else "(?:.*/)?") + body + ("/" if inside else "(?:/|$)"), back))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches leaves the path out."""
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def walked(spark: SparkSession, root: str, rules: list[tuple[str, bool]] = (), only_code: bool = False) -> DataFrame:
    """path (relative), size, ext, tokens, language, mtime, content of files that no rule leaves out; contents are read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Paths come with a scheme and the absolute folder in front.
    at = F.expr(f"position('{root.rstrip('/').split('://')[-1]}/', path)") + len(root.rstrip("/").split("://")[-1]) + 1
    rel = F.substring(F.col("path"), at, F.length("path"))
    files = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    own = F.exists(F.split("path", "/"), lambda p: p.isin(*fixed.IGNORED_NAMES))
    files = files.filter(~own & ~ignored(F.col("path"), list(rules)))
    path = F.col("path")
    out = files.select("path", "size", t.ext(path).alias("ext"), t.file_tokens(F.col("size")).alias("tokens"), t.language(path).alias("language"), "mtime", "content")
    return out.filter("language is not null") if only_code else out


def decoded(files: DataFrame) -> DataFrame:
    """path, language, text of files(path, language, content)."""
    return files.select("path", "language", F.decode("content", "UTF-8").alias("text"))


def lines_of(files: DataFrame) -> DataFrame:
    """path, language, line (from 1), text of files(path, language, text)."""
    lines = F.posexplode(F.split("text", "\n"))
    return files.select("path", "language", lines.alias("line", "text")).withColumn("line", F.col("line") + 1)


def _by_language(rules: dict[str, str], group: int) -> Column:
    out = F.lit("")
    for lang, pattern in rules.items():
        out = F.when(F.col("language") == lang, F.regexp_extract("text", pattern, group)).otherwise(out)
    return out


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows(..., ord) with equal keys the first."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), "ord").alias("_row"))
    return first.select("_row.*")


OTHER = "language not in ({})".format(", ".join(f"'{x}'" for x in scanner.LANGUAGES))


def told(files: DataFrame) -> tuple[bool, bool]:
    """Of files(path, language, ...): whether no path comes twice, and whether there are languages that the scanner doesn't read."""
    paths = files.groupBy(F.xxhash64("path").alias("h")).agg(F.count("*").alias("n"), F.max(F.expr(OTHER)).alias("other"))
    most, others = paths.agg(F.max("n"), F.max("other")).first()
    return (most or 0) <= 1, bool(others)


def call_counts(files: DataFrame, *by: str) -> DataFrame:
    """path, these columns of the calls of files(path, language, text), and n: how many of a file's calls have the same values.

    They are counted file by file where they are scanned; only where a path comes twice, over the rows of all its files.
    """
    if not told(files)[0]:
        return facts(files, ("call",))["calls"].groupBy("path", *by).agg(F.count("*").alias("n"))
    own = {"callee": "name", "receiver": "detail"}
    found = scanner.scanned(files, ("call",), ("path", *[own.get(c, c) for c in by]))
    return found.select("path", *[F.col(own.get(c, c)).alias(c) for c in by], "n")


def facts(files: DataFrame, kinds: tuple[str, ...] = scanner.KINDS) -> dict[str, DataFrame]:
    """functions, types, imports and calls of files(path, language, text), in the shapes that graph.build() takes; of these kinds only.

    The first of a name in a file stays. A call's caller is the last function of the file, in the text's order, whose lines hold
    the call's; calls outside of functions have none. Files are scanned once, for several kinds into a table. Both are settled file by
    file where they are scanned, so no row moves; only where a path comes twice they are found over the rows of all its files.
    """
    alone, others = told(files)
    asked = kinds
    if not alone and "call" in kinds:
        asked = tuple({*kinds, "function"})
    seen = scanner.scanned(files, asked)
    if len(asked) > 1:
        seen = written(seen)
    lines = lines_of(files.filter(OTHER))
    none = F.lit("")

    def once(rows: DataFrame, plain: DataFrame, *keys: str) -> DataFrame:
        """The first rows of their keys: scanned ones, and those found line by line."""
        if not alone:
            return first_of(rows.drop("first").unionByName(plain), *keys)
        rows = rows.filter("first").drop("first")
        return rows.unionByName(first_of(plain, *keys)) if others else rows

    out = {}
    found = seen.filter("kind = 'function'").select("path", "language", "ord", "line", "start_line", "end_line", "name", F.col("detail").alias("receiver"), "params", "result", "first")
    if "function" in kinds:
        name, params = (_by_language(FUNCTIONS, g) for g in (2, 3))
        plain = lines.select("path", "language", F.col("line").alias("ord"), "line", F.lit(None).cast("int").alias("end_line"), name.alias("name"), none.alias("receiver"), params.alias("params"), none.alias("result")).filter("name <> ''")
        language, own = F.col("language"), F.col("name")
        out["functions"] = once(found.drop("start_line"), plain, "path", "name").select(
            "path", "language", "ord", "line", "end_line", "name", "receiver", t.count_params(F.col("params")).alias("param_count"), t.is_exported(own, language).alias("exported"),
            t.signature(language, own, F.col("params"), F.col("receiver")).alias("signature"), "result", t.signature(language, own, F.col("params"), F.col("receiver"), F.col("result")).alias("full_signature"),
        )
    if "type" in kinds:
        kind, label = (F.regexp_extract("text", TYPES, g) for g in (1, 2))
        types = seen.filter("kind = 'type'").select("path", "language", "ord", "line", "name", F.col("detail").alias("kind"), "first")
        out["types"] = once(types, lines.select("path", "language", F.col("line").alias("ord"), "line", label.alias("name"), kind.alias("kind")).filter("name <> ''"), "path", "name")
    if "import" in kinds:
        imports = seen.filter("kind = 'import'").select("path", "language", "ord", F.col("name").alias("imp"), "first")
        out["imports"] = once(imports, lines.select("path", "language", F.col("line").alias("ord"), _by_language(IMPORTS, 1).alias("imp")).filter("imp <> ''"), "path", "imp")
    if "call" in kinds:
        calls = seen.filter("kind = 'call'").select("path", F.col("line").alias("call_line"), "ord", F.col("name").alias("callee"), F.col("detail").alias("receiver"), "args", "caller")
        if not alone:
            calls = sweep.containing(calls.drop("caller"), found.select("path", "ord", "name", "start_line", "end_line"))
        out["calls"] = calls.select("path", "ord", "call_line", "caller", "callee", "receiver", "args")
    return out


def _blocks(lines: DataFrame, opens: str, closes: str) -> DataFrame:
    """Lines inside blocks: after a line that matches opens, up to one that matches closes."""
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("text").rlike(opens), 1).when(F.col("text").rlike(closes), 0)
    return lines.withColumn("_open", F.last(mark, ignorenulls=True).over(before)).filter("_open = 1").drop("_open")


def manifests(lines: DataFrame) -> DataFrame:
    """path, language, dep, line of external dependencies, by the name of the manifest; the first of a name in a language stays."""
    name, line = t.base(F.col("path")), F.regexp_replace("text", r"^\s+|\s+$", "")
    own = {n: lines.filter(name == n) for n in ("go.mod", "requirements.txt", "package.json", "Podfile", "Package.swift")}
    go = _blocks(own["go.mod"], r"^\s*require\s*\(", r"^\s*\)").filter(~line.startswith("//") & (line != "") & ~line.startswith(")"))
    js = _blocks(own["package.json"], r'"(dependencies|devDependencies)"', r"\}").filter(~F.col("text").rlike(r"\}"))
    parts = [
        ("go", go, F.split(line, r"\s+")[0]),
        ("python", own["requirements.txt"].filter((line != "") & ~line.startswith("#")), F.regexp_extract(line, r"^(.*?)(?:==|>=|<=|~=|[<>;#\[]|$)", 1)),
        ("javascript", js, F.regexp_extract(line, r'^"([^"]+)"\s*:', 1)),
        ("swift", own["Podfile"], F.regexp_extract(line, r"""^pod\s+['"]([^'"]+)['"]""", 1)),
        ("swift", own["Package.swift"], F.regexp_extract(line, r"""\.package\(url:\s*"(?:[^"]*/)?([^"/]+?)(?:\.git)?\"""", 1)),
    ]
    out = None
    for lang, rows, dep in parts:
        one = rows.select("path", F.lit(lang).alias("language"), dep.alias("dep"), "line").filter("dep <> ''")
        out = one if out is None else out.unionByName(one)
    first = Window.partitionBy("language", "dep").orderBy("path", "line")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>"


def manifests_of(files: DataFrame) -> DataFrame:
    """path, language, dep, line of manifests(), of files(path, text): a package.json is read by its structure, however it is laid out.

    line counts its names, dependencies first. One that is no JSON object is read by lines.
    """
    files = files.select("path", F.lit("").alias("language"), "text").withColumn("_json", F.when(t.base(F.col("path")) == "package.json", F.from_json("text", PACKAGE_JSON, {"mode": "PERMISSIVE"})))
    whole = F.col("_json").isNotNull() & (F.col("_json.dependencies").isNotNull() | F.col("_json.devDependencies").isNotNull())
    none = F.expr("cast(array() as array<string>)")
    names = F.concat(*[F.coalesce(F.map_keys(f"_json.{c}"), none) for c in ("dependencies", "devDependencies")])
    parsed = files.filter(whole).select("path", F.lit("javascript").alias("language"), F.posexplode(names).alias("line", "dep")).filter("dep <> ''")
    rest = manifests(lines_of(files.filter(~F.coalesce(whole, F.lit(False))).drop("_json")))
    both = rest.unionByName(parsed.select("path", "language", "dep", (F.col("line") + 1).alias("line")))
    first = both.groupBy("language", "dep").agg(F.min_by(F.struct("path", "line"), F.struct("path", "line")).alias("x"))
    return first.select("x.path", "language", "dep", "x.line")


def numstat(lines: DataFrame) -> DataFrame:
    """path, added, removed of change lists in lines(text): added, removed and path; a dash, as of binary files, is 0."""
    parts = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    rows = lines.filter(F.size(parts) >= 3)
    number = [F.coalesce(F.try_to_number(F.element_at(parts, i), F.lit("999999999")).cast("long"), F.lit(0)) for i in (1, 2)]
    return rows.select(F.array_join(F.slice(parts, 3, F.size(parts)), " ").alias("path"), number[0].alias("added"), number[1].alias("removed"))


def changes(stats: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, added, removed, untracked of a change list and untracked paths."""
    new = untracked.select("path", F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("removed"), F.lit(True).alias("untracked"))
    both = stats.withColumn("untracked", F.lit(False)).unionByName(new)
    return both.groupBy("path").agg(F.max("added").alias("added"), F.max("removed").alias("removed"), F.max("untracked").alias("untracked"))


def source_slice(files: DataFrame, nodes: DataFrame, chunk: int = 50) -> DataFrame:
    """id, source, source_hash of nodes(id, kind, path, line, end_line): its lines, a chunk from its line without an end, or its whole file."""
    lines = F.split(F.decode("content", "UTF-8"), "\n")
    line, end = F.col("line"), F.col("end_line")
    picked = F.when((line > 0) & (end > 0), F.slice(F.col("lines"), F.greatest(line, F.lit(1)), F.greatest(end - line + 1, F.lit(0)))).when(line > 0, F.slice(F.col("lines"), F.greatest(line, F.lit(1)), F.lit(chunk))).when(F.col("kind") == fixed.FILE, F.col("lines"))
    rows = nodes.join(files.select("path", lines.alias("lines")), "path")
    source = F.array_join(picked, "\n")
    return rows.select("id", source.alias("source"), F.sha2(source, 256).alias("source_hash"), t.source_language(F.col("path")).alias("language"))


def line_range(content: Column, start: Column, end: Column) -> Column:
    """The lines from start to end, both included, counted from 1."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(end - first + 1, F.lit(0))), "\n")


def with_context(files: DataFrame, nodes: DataFrame, lines: int) -> DataFrame:
    """source_slice() with before, after (so many lines around a node that has lines) and file_header."""
    content, line, end = F.decode("content", "UTF-8"), F.col("line"), F.col("end_line")
    around = nodes.join(files.select("path", content.alias("_text")), "path").select(
        "id",
        F.when(line > 1, line_range(F.col("_text"), line - lines, line - 1)).otherwise("").alias("before"),
        F.when(end > 0, line_range(F.col("_text"), end + 1, end + lines)).otherwise("").alias("after"),
        file_header(F.col("_text")).alias("file_header"),
    )
    return source_slice(files, nodes).join(around, "id")


def module_source(files: DataFrame, module: str) -> DataFrame:
    """path, source, source_hash of one file, or of the source files right inside a directory."""
    path = F.col("path")
    own = (path == module) | ((t.dirname(path) == module) & F.lower(t.ext(path)).isin(*fixed.SOURCE_EXTS) & ~t.base(path).startswith("."))
    source = F.decode("content", "UTF-8")
    return files.filter(own).select("path", source.alias("source"), F.sha2(source, 256).alias("source_hash"))


def file_header(content: Column) -> Column:
    """The comment lines in front of a file's first declaration or code line, with the empty lines among them."""
    state = F.struct(F.expr("cast(array() as array<string>)").alias("head"), F.lit(False).alias("inside"), F.lit(False).alias("ended"))

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        declared = bare.rlike(r"^(package|import|from|use|require) ")
        opens = bare.startswith("/*")
        comment = bare.startswith("//") | bare.startswith("#") | opens | s["inside"]
        keep = ~s["ended"] & ~declared & (comment | ((bare == "") & (F.size(s["head"]) > 0)))
        ended = s["ended"] | declared | (~comment & (bare != ""))
        # A block that opens a line is taken to go on past it.
        inside = F.when(opens, True).when(s["inside"] & bare.contains("*/"), False).otherwise(s["inside"])
        return F.struct(F.when(keep, F.array_append(s["head"], line)).otherwise(s["head"]).alias("head"), inside.alias("inside"), ended.alias("ended"))

    joined = F.aggregate(F.split(content, "\n"), state, step, lambda s: F.array_join(s["head"], "\n"))
    return F.regexp_replace(joined, r"^\s+|\s+$", "")
