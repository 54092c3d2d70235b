"""Queries on file inventories, text, changes and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import files, folds
from ..sources import views as v
from ..sources.views import sql

TARGET = "src1/en/doc_101.py"


def file_tokens(spark, d):
    return v.files(spark, d).select("path", "tokens", (F.col("tokens") >= 8000).alias("is_large"))


def large_files(spark, d):
    return file_tokens(spark, d).filter("is_large").drop("is_large")


def tree_summary(spark, d):
    return files.summary(v.files(spark, d))


def top_extensions(spark, d):
    return files.top_extensions(v.files(spark, d))


def dir_rollup(spark, d):
    return files.directories(v.files(spark, d))


def homogeneous_dirs(spark, d):
    return files.homogeneous(v.files(spark, d))


def ext_skyline(spark, d):
    return files.skyline(v.files(spark, d))


def top_large_files(spark, d):
    return files.largest(v.files(spark, d)).select("path", "size")


def file_sizes(spark, d):
    return v.files(spark, d).select("path", t.human_size(F.col("size")).alias("size"), t.human_tokens(F.col("tokens")).alias("tokens"))


def systems(spark, d):
    return files.systems(v.files(spark, d))


def project_stats(spark, d):
    return files.project_stats(v.files(spark, d), F.split("path", "/")[0])


def find_file(spark, d):
    return v.files(spark, d).filter(F.lower("path").contains("SRC1/FR".lower())).select("path")


def detect_language(spark, d):
    rows = v.table(spark, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return rows.select("path", t.ext(F.col("path")).alias("ext"), t.language(F.col("path")).alias("language"), t.source_language(F.col("path")).alias("source_language")).distinct()


def path_parts(spark, d):
    url = F.col("url")
    return v.table(spark, d, "pages").select("page_id", t.base(url).alias("base"), t.ext(url).alias("ext"), t.package_of(url).alias("package"), t.normal_import(url).alias("normal"), t.dependency_name(url).alias("dependency"))


def content_hash(spark, d):
    docs = v.table(spark, d, "documents")
    hashed = F.sha2("text", 256)
    return docs.select("doc_id", hashed.alias("content_hash"), t.cache_key(hashed, F.lit("explain"), F.col("lang")).alias("cache_key"))


def module_hashes(spark, d):
    hashed = folds.joined_hash(v.table(spark, d, "documents"), F.col("source"), F.col("doc_id"), F.sha2("text", 256), F.lit("["), " ", "]")
    return hashed.select(F.col("key").alias("source"), F.col("hash").alias("module_hash"))


def text_tokens(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.text_tokens(F.col("text")).alias("tokens"))


def message_tokens(spark, d):
    return v.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum((t.text_tokens(F.col("text")) + 4).cast("long")).alias("tokens"))


def truncate_text(spark, d):
    cut = t.truncated(F.col("text"), 100)
    return v.table(spark, d, "documents").select("doc_id", cut.alias("x")).select("doc_id", F.sha2("x.text", 256).alias("text_hash"), F.col("x.cut").alias("cut"))


def token_budget(spark, d):
    """Messages of each conversation, in order, against a budget of 200 tokens."""
    return folds.allocated(v.table(spark, d, "conversations"), "conv_id", "turn", t.text_tokens(F.col("text")), 200)


def changed_files(spark, d):
    return files.changed(v.files(spark, d), v.changes(spark, d)).select("path", "size", "added", "removed", "is_new")


def diff_summary(spark, d):
    return changed_files(spark, d).agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if("is_new").alias("new_files"))


def impact(spark, d):
    return files.impact(v.imports(spark, d), v.changes(spark, d))


def importers(spark, d):
    return files.importers(v.imports(spark, d), TARGET)


def internal_deps(spark, d):
    return files.internal_dependencies(v.files(spark, d), v.imports(spark, d))


def hubs(spark, d):
    return files.hubs(internal_deps(spark, d))


def deps_summary(spark, d):
    deps = internal_deps(spark, d)
    return deps.agg(F.count("*").alias("internal_deps"), F.count_distinct("path").alias("files_with_deps"), F.count_distinct("target").alias("targets"))


def dep_chains(spark, d):
    return files.chains(v.files(spark, d), internal_deps(spark, d))


def ext_deps(spark, d):
    """Distinct names of what pages' hosts depend on, two letters at least, by host."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    name = t.dependency_name(F.regexp_replace("url", r"[?#].*$", ""))
    return v.table(spark, d, "pages").select(host.alias("host"), name.alias("dep")).filter(F.length("dep") > 1).distinct()


FILES = {
    "file_tokens": (file_tokens, "select path, tokens, tokens >= 8000 as is_large from files_v"),
    "large_files": (large_files, "select path, tokens from files_v where tokens >= 8000"),
    "tree_summary": (tree_summary, "select count(*) as files, cast(sum(size) as bigint) as size, cast(sum(tokens) as bigint) as tokens from files_v"),
    "top_extensions": (top_extensions, "select ext, count(*) as files from files_v where ext <> '' group by ext order by files desc, ext limit 5"),
    "dir_rollup": (dir_rollup, "select dir, count(*) as files, cast(sum(size) as bigint) as size from (select unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as dir, size from files_v) group by dir"),
    "homogeneous_dirs": (homogeneous_dirs, "select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as files, min(ext) as ext from files_v group by 1 having count(*) > 1 and min(ext) = max(ext)"),
    "ext_skyline": (ext_skyline, "select label, files, size, cast(2 + floor(sqrt((size - min(size) over ()) / case when max(size) over () = min(size) over () then 1.0 else max(size) over () - min(size) over () end) * 10) as int) as height from (select lower(ext) as label, count(*) as files, cast(sum(size) as bigint) as size from files_v group by 1)"),
    "top_large_files": (top_large_files, "select path, size from files_v order by size desc, path limit 5"),
    "file_sizes": (file_sizes, "select path, case when size < 1024 then printf('%.1fB', size::double) when size < 1048576 then printf('%.1fKB', size / 1024.0::double) else printf('%.1fMB', size / 1048576.0::double) end as size, case when tokens < 1000 then tokens::varchar else printf('%.1fk', tokens / 1000.0::double) end as tokens from files_v"),
    "systems": (systems, "select upper(substr(s, 1, 1)) || substr(s, 2) as system, count(*) as files, cast(sum(size) as bigint) as size from (select split_part(path, '/', 1) as s, size from files_v) group by 1"),
    "project_stats": (project_stats, "select project, cast(sum(n) as bigint) as files, arg_min(language, (-n, language)) as language from (select split_part(path, '/', 1) as project, language, count(*) as n from files_v group by all) group by 1"),
    "find_file": (find_file, "select path from files_v where contains(lower(path), 'src1/fr')"),
    "detect_language": (detect_language, "select distinct path, ext, case ext when '.go' then 'go' when '.py' then 'python' when '.js' then 'javascript' else null end as language, case ext when '.go' then 'go' when '.html' then 'html' when '.py' then 'python' when '.js' then 'javascript' else 'text' end as source_language from (select path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) as ext from (select regexp_replace(url, '[?#].*$', '') as path from pages))"),
    "path_parts": (path_parts, r"select page_id, last as base, regexp_extract(url, '(\.[^./]*)$', 1) as ext, split_part(url, '/', -2) as package, lower(regexp_replace(case when contains(last, '.') and not starts_with(last, '.') then split_part(last, '.', -1) else last end, '\.(py|go|js|ts|jsx|tsx|rb|rs|c|h|cpp|hpp|java|swift)$', '')) as normal, case when regexp_matches(last, '^v\d+$') then split_part(url, '/', -2) else last end as dependency from (select page_id, url, split_part(url, '/', -1) as last from pages)"),
    "content_hash": (content_hash, "select doc_id, sha256(text) as content_hash, substr(sha256(sha256(text) || ':explain:' || lang), 1, 32) as cache_key from documents"),
    "module_hashes": (module_hashes, "select source, sha256('[' || string_agg(sha256(text), ' ' order by doc_id) || ']') as module_hash from documents group by source"),
    "text_tokens": (text_tokens, r"select doc_id, cast(floor(len(regexp_extract_all(text, '[^\s\p{P}\p{S}]+')) * 1.3::double) as int) + cast(len(regexp_extract_all(text, '[\p{P}\p{S}]')) as int) as tokens from documents"),
    "message_tokens": (message_tokens, r"select conv_id, cast(sum(cast(floor(len(regexp_extract_all(text, '[^\s\p{P}\p{S}]+')) * 1.3::double) as int) + len(regexp_extract_all(text, '[\p{P}\p{S}]')) + 4) as bigint) as tokens from conversations group by conv_id"),
    "truncate_text": (truncate_text, r"""select doc_id, sha256(case when fits then text
        when line > 200 then left(head, line) || chr(10) || '... (truncated)'
        when sentence > 200 then left(head, sentence + 1) || ' ... (truncated)'
        when word > 200 then left(head, word) || ' ... (truncated)' else head || '... (truncated)' end) as text_hash, not fits as cut
      from (select doc_id, text, head, length(text) <= 400 or cast(floor(len(regexp_extract_all(text, '[^\s\p{P}\p{S}]+')) * 1.3::double) as int) + len(regexp_extract_all(text, '[\p{P}\p{S}]')) <= 100 as fits,
        case when contains(head, chr(10)) then 400 - instr(reverse(head), chr(10)) else -1 end as line,
        case when contains(head, '. ') then 400 - instr(reverse(head), ' .') - 1 else -1 end as sentence,
        case when contains(head, ' ') then 400 - instr(reverse(head), ' ') else -1 end as word
        from (select doc_id, text, left(text, 400) as head from documents))"""),
    "changed_files": (changed_files, "select path, size, case when untracked then 0 else added end as added, case when untracked then 0 else removed end as removed, untracked as is_new from files_v join changes_v using (path)"),
    "diff_summary": (diff_summary, "select count(*) as files, cast(sum(case when untracked then 0 else added end) as bigint) as added, cast(sum(case when untracked then 0 else removed end) as bigint) as removed, count_if(untracked) as new_files from changes_v"),
    "impact": (impact, r"""select regexp_replace(regexp_replace(target, '/$', ''), '^.*/', '') as file, used_by from (select target, count(*) as used_by from (
        select target from (select path, regexp_replace(regexp_replace(imp, '^.*/', ''), '\.[^.]*$', '') as base from imports_v) join (select regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') as base, max(path) as target from changes_v group by 1) using (base) where path <> target
        union all
        select regexp_replace(target, '/[^/]*$', '') || '/' from (select path, regexp_replace(regexp_replace(imp, '^.*/', ''), '\.[^.]*$', '') as base from imports_v) join (select split_part(path, '/', -2) as base, min(path) as target from changes_v group by 1) using (base) where regexp_replace(path, '/[^/]*$', '') <> regexp_replace(target, '/[^/]*$', '')) group by target)"""),
    "importers": (importers, f"select distinct path from imports_v where path <> '{TARGET}' and (regexp_replace(imp, '^.*/', '') = 'doc_101.py' or regexp_replace(regexp_replace(imp, '^.*/', ''), '\\.[^.]*$', '') = 'doc_101' or ends_with(imp, '{TARGET}') or imp = 'src1/en')"),
    "ext_deps": (ext_deps, r"select distinct host, dep from (select regexp_extract(url, '^https?://([^/]+)', 1) as host, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) as dep from pages) where length(dep) > 1 and not regexp_matches(dep, '^v\d+$')"),
}
DEPS = r"""select distinct i.path, f.target from (select path, language, lower(case when contains(last, '.') then split_part(last, '.', -1) else last end) as name from (select path, language, split_part(imp, '/', -1) as last from imports_v where imp not in ('fmt', 'os', 'json'))) i
  join (select path as dep_path, language, regexp_replace(path, '^.*/', '') as target, lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '')) as name from files_v) f on i.name = f.name and i.language = f.language and i.path <> f.dep_path and regexp_replace(i.path, '^.*/', '') <> f.target"""
DEPENDENCIES = {
    "internal_deps": (internal_deps, DEPS),
    "hubs": (hubs, f"select target, count(*) as used_by from ({DEPS}) group by target having count(*) >= 2 order by used_by desc, target limit 6"),
    "deps_summary": (deps_summary, f"select count(*) as internal_deps, count(distinct path) as files_with_deps, count(distinct target) as targets from ({DEPS})"),
    "dep_chains": (dep_chains, f"""select o.path, o.target, array_to_string(a.all_[1:3], ',') as next, cast(greatest(len(a.all_) - 3, 0) as int) as more from (select path, min(target) as target from ({DEPS}) group by path having count(*) = 1) o
        join (select regexp_replace(path, '^.*/', '') as target, min(path) as first from files_v group by 1) f on o.target = f.target join (select path, list_sort(list(distinct target)) as all_ from ({DEPS}) group by path) a on a.path = f.first"""),
}
ALL = FILES | DEPENDENCIES
QUERIES = {name: q for name, (q, _) in ALL.items()} | {"token_budget": token_budget}
ORACLES = {name: sql(s) for name, (_, s) in ALL.items()}
ORACLES["token_budget"] = r"""with recursive m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n, cast(floor(len(regexp_extract_all(text, '[^\s\p{P}\p{S}]+')) * 1.3::double) as bigint) + len(regexp_extract_all(text, '[\p{P}\p{S}]')) as need from conversations),
  r as (select conv_id, turn, n, case when need <= 200 then need else 0 end as allocated, 200 - case when need <= 200 then need else 0 end as room from m where n = 1
    union all select m.conv_id, m.turn, m.n, case when need <= room then need else 0 end, room - case when need <= room then need else 0 end from r join m on m.conv_id = r.conv_id and m.n = r.n + 1)
  select conv_id, turn, cast(allocated as bigint) as allocated from r"""
