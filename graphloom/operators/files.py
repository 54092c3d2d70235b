"""File inventories, changes and dependencies between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t


def summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum(F.col("tokens").cast("long")).alias("tokens"))


def top_extensions(files: DataFrame, n: int = 5) -> DataFrame:
    """ext, files of the n most frequent extensions; ties by extension."""
    return files.filter("ext <> ''").groupBy("ext").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(n)


def directories(files: DataFrame) -> DataFrame:
    """dir, files, size of every directory's whole subtree."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    deep = files.filter(F.col("path").contains("/")).select(F.explode(ups).alias("dir"), "size")
    return deep.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def homogeneous(files: DataFrame) -> DataFrame:
    """dir, files, ext of directories with several files that all have one extension."""
    own = files.groupBy(t.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.min("ext").alias("ext"), F.max("ext").alias("_max"))
    return own.filter("files > 1 and ext = _max").drop("_max")


def by_extension(files: DataFrame) -> DataFrame:
    """label, files, size by lower-case extension or, without one, name; only code files if there are any."""
    low = F.lower("ext")
    code = low.isin(*fixed.CODE_EXTS) | t.base(F.col("path")).isin(*fixed.CODE_NAMES)
    marked = files.withColumn("_code", code)
    label = F.when(low == "", t.base(F.col("path"))).otherwise(low)
    sums = marked.groupBy(label.alias("label"), "_code").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    any_code = F.max("_code").over(Window.partitionBy())  # a row for each label: few
    return sums.withColumn("_any", any_code).filter("_code or not _any").groupBy("label").agg(F.sum("files").alias("files"), F.sum("size").alias("size"))


def skyline(files: DataFrame) -> DataFrame:
    """by_extension with the height of each label's building, 2 to 12."""
    rows = by_extension(files)
    all_ = Window.partitionBy()
    low, high = F.min("size").over(all_), F.max("size").over(all_)
    return rows.withColumn("height", 2 + F.floor(F.sqrt((F.col("size") - low) / F.when(high == low, 1).otherwise(high - low)) * 10).cast("int"))


def arranged(buildings: DataFrame) -> DataFrame:
    """skyline() with seats from left to right: by falling height, in turn at the right and the left end of the row."""
    rank = F.row_number().over(Window.orderBy(F.desc("height"), "label")) - 1
    seat = F.when(rank % 2 == 0, F.floor(rank / 2)).otherwise(-F.floor((rank + 1) / 2))
    return buildings.withColumn("seat", seat.cast("int"))


def largest(files: DataFrame, n: int = 5) -> DataFrame:
    """The n largest files that have an extension and aren't assets; ties by path."""
    return files.filter((F.col("ext") != "") & ~F.lower("ext").isin(*fixed.ASSET_EXTS)).orderBy(F.desc("size"), "path").limit(n)


def changed(files: DataFrame, diff: DataFrame) -> DataFrame:
    """Changed files with their line counts (0 for untracked ones)."""
    d = diff.select("path", F.when(F.col("untracked"), 0).otherwise(F.col("added")).alias("added"), F.when(F.col("untracked"), 0).otherwise(F.col("removed")).alias("removed"), F.col("untracked").alias("is_new"))
    return files.join(d, "path")


def impact(imports: DataFrame, diff: DataFrame) -> DataFrame:
    """file, used_by: imports that name a changed file, or the directory of one from outside it.

    Of changed files with one base name the last by path counts, of directories with one name the first.
    """
    path = F.col("path")
    bases = diff.groupBy(t.stem(path).alias("base")).agg(F.max("path").alias("target"))
    dirs = diff.filter(path.contains("/")).groupBy(t.base(t.dirname(path)).alias("base")).agg(F.min("path").alias("target"))
    named = imports.select("path", t.import_base(F.col("imp")).alias("base"))
    by_file = named.join(bases, "base").filter("path <> target").select("target")
    folder = t.dirname(F.col("target"))
    by_dir = named.join(dirs, "base").filter(t.dirname(path) != folder).select(F.concat(folder, F.lit("/")).alias("target"))
    counts = by_file.unionAll(by_dir).groupBy("target").agg(F.count("*").alias("used_by"))
    return counts.select(t.base(F.regexp_replace("target", "/$", "")).alias("file"), "used_by")


def importers(imports: DataFrame, target: str) -> DataFrame:
    """Files with an import that names the target: by base name, with or without extension, or by a path that ends in it."""
    folder, _, name = target.rpartition("/")
    imp = F.col("imp")
    hit = (t.base(imp) == name) | (t.stem(imp) == (name.rpartition(".")[0] if "." in name else name)) | imp.endswith(target)
    hit = hit | ((imp == folder) if folder else F.lit(False))
    return imports.filter(hit & (F.col("path") != target)).select("path").distinct()


def internal_dependencies(files: DataFrame, imports: DataFrame) -> DataFrame:
    """path, target: files of one language group whose lower-case base name a file imports. One row for each base name."""
    imp = F.col("imp")
    plain = ~imp.contains("/") & ~imp.contains(".") & t.is_stdlib(F.lower(imp))
    norm = imports.filter(~plain).select("path", t.language_group(F.col("language")).alias("group"), t.normal_import(imp).alias("name")).filter(~t.is_stdlib(F.col("name")))
    known = files.select(F.col("path").alias("to"), t.language_group(F.col("language")).alias("group"), F.lower(t.stem(F.col("path"))).alias("name"))
    return norm.join(known, ["group", "name"]).filter((F.col("path") != F.col("to")) & (t.base(F.col("path")) != t.base(F.col("to")))).select("path", t.base(F.col("to")).alias("target")).distinct()


def hubs(deps: DataFrame, least: int = 2, n: int = 6) -> DataFrame:
    return deps.groupBy("target").agg(F.count("*").alias("used_by")).filter(F.col("used_by") >= least).orderBy(F.desc("used_by"), "target").limit(n)


def chains(files: DataFrame, deps: DataFrame) -> DataFrame:
    """path, target, next (first 3 by name), more: what the only dependency of a file depends on. Names resolve to their first file."""
    only = deps.groupBy("path").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")
    first = files.groupBy(t.base(F.col("path")).alias("target")).agg(F.min("path").alias("to"))
    after = deps.groupBy(F.col("path").alias("to")).agg(F.array_sort(F.collect_set("target")).alias("all"))
    return only.join(first, "target").join(after, "to").select("path", "target", F.array_join(F.slice("all", 1, 3), ",").alias("next"), F.greatest(F.size("all") - 3, F.lit(0)).alias("more"))


def systems(files: DataFrame) -> DataFrame:
    """system, files, size by the first directory that means something."""
    return files.groupBy(t.system_name(t.dirname(F.col("path"))).alias("system")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def project_stats(files: DataFrame, group) -> DataFrame:
    """project, files, language: all files of each project, and its most frequent language; ties by name."""
    counts = files.groupBy(group.alias("project"), "language").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("language").isNotNull(), F.struct((-F.col("n")).alias("n"), "language")))["language"]
    return counts.groupBy("project").agg(F.sum("n").alias("files"), best.alias("language"))


def api_surface(symbols: DataFrame) -> DataFrame:
    """package, functions, types: how many exported symbols(path, name, kind, exported); empty packages fall away. api_symbols() has their names."""
    own = symbols.filter("exported").groupBy(t.dirname(F.col("path")).alias("package"))
    return own.agg(F.count_if(F.col("kind").isin(fixed.FUNCTION, fixed.METHOD)).alias("functions"), F.count_if(F.col("kind") == fixed.TYPE).alias("types"))


def api_symbols(symbols: DataFrame) -> DataFrame:
    """package, what (function or type), name, n: the exported names of each package, and how often each is declared. A row for a name, as packages may be large."""
    what = F.when(F.col("kind").isin(fixed.FUNCTION, fixed.METHOD), "function").when(F.col("kind") == fixed.TYPE, "type")
    own = symbols.filter("exported").select(t.dirname(F.col("path")).alias("package"), what.alias("what"), "name").filter("what is not null")
    return own.groupBy("package", "what", "name").agg(F.count("*").alias("n"))


def dependency_totals(deps: DataFrame, functions: DataFrame, types: DataFrame) -> DataFrame:
    """One row on internal dependencies and declarations: internal_deps, files_with_deps, targets, functions, types."""
    a = deps.agg(F.count("*").alias("internal_deps"), F.count_distinct("path").alias("files_with_deps"), F.count_distinct("target").alias("targets"))
    both = functions.select(F.lit(1).alias("f"), F.lit(0).alias("t")).unionAll(types.select(F.lit(0), F.lit(1)))
    b = both.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("functions"), F.coalesce(F.sum("t"), F.lit(0)).alias("types"))
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


def symbols(facts: DataFrame, name: str = "", kind: str = "all", file: str = "") -> DataFrame:
    """Symbols(path, name, kind) by part of the name in any case, by kind and by part of the path."""
    if kind not in ("", "all", "function", "type"):
        return facts.filter(F.lit(False))
    out = facts.filter(F.lower("name").contains(name.lower()) & F.col("path").contains(file))
    if kind == "function":
        return out.filter(F.col("kind").isin(fixed.FUNCTION, fixed.METHOD))
    return out.filter(F.col("kind") == fixed.TYPE) if kind == "type" else out


def methods(symbols: DataFrame) -> DataFrame:
    """package, type, methods of exported types: methods(path, kind, receiver) join types(path, kind, name) in each directory."""
    own = symbols.filter("exported").withColumn("package", t.dirname(F.col("path")))
    types = own.filter(F.col("kind") == fixed.TYPE).select("package", F.col("name").alias("type")).distinct()
    found = own.filter(F.col("kind") == fixed.METHOD).groupBy("package", t.receiver_type(F.col("receiver")).alias("type")).agg(F.count("*").alias("methods"))
    return types.join(found, ["package", "type"], "left").withColumn("methods", F.coalesce("methods", F.lit(0)))


def projects(files: DataFrame, pattern: str = "") -> DataFrame:
    """project, files, language of the directories at the top that aren't hidden and hold the pattern, whatever the case."""
    top = F.split("path", "/")[0]
    own = files.filter(F.col("path").contains("/") & ~top.startswith(".") & F.lower(top).contains(pattern.lower()))
    return project_stats(own, F.split("path", "/")[0])
