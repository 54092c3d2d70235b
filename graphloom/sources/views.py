"""Relations that play the parts of files, nodes, edges, imports, changes and cached answers.

Each is made from the given tables by DataFrame functions; SQL holds the same relations for tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, ext, tokens, language, doc_id: a source file for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("size"))
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".go").when(F.col("lang") == "de", ".ts").otherwise(".rs")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), end))
    rows = docs.select("doc_id", path.alias("path"), "size")
    return rows.select("doc_id", "path", "size", t.ext(F.col("path")).alias("ext"), t.file_tokens(F.col("size")).alias("tokens"), t.language(F.col("path")).alias("language"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, imp: what each file imports."""
    names = F.array(
        F.concat(F.lit("pkg/doc_"), (F.col("doc_id") + 1).cast("string")),
        F.concat(F.lit("mod.doc_"), F.floor(F.col("doc_id") / 2).cast("string")),
        F.concat(F.lit("lib/"), F.split("path", "/")[1]),
        F.element_at(F.array(*map(F.lit, ("fmt", "os", "json"))), (F.col("doc_id") % 3 + 1).cast("int")),
    )
    return files(spark, sf_dir).select("path", "language", F.explode(names).alias("imp"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, added, removed, untracked: labelled documents are the changed files."""
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10 + 1).cast("long").alias("added"), F.col("toxic").cast("long").alias("removed"), (F.col("quality") == 0).alias("untracked"))
    return files(spark, sf_dir).select("doc_id", "path").join(marks, "doc_id").drop("doc_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, path, symbol, line, param_count, exported, package, signature, doc."""

    def of(name: str, kind: int, path, label, symbol, params=0):
        return table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), label.alias("name"), path.alias("path"), symbol.alias("symbol"), F.lit(params).alias("param_count") if isinstance(params, int) else params.alias("param_count"))

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    none = F.lit("")
    rows = [
        of("region", 1, key("region/", "r_regionkey"), F.col("r_name"), none),
        of("nation", 1, key("nation/", "n_nationkey"), F.col("n_name"), none),
        of("customer", 0, F.concat(key("nation_", "c_nationkey"), key("/customer_", "c_custkey")), F.col("c_name"), none),
        of("supplier", 0, F.concat(key("nation_", "s_nationkey"), key("/supplier_", "s_suppkey")), F.col("s_name"), none),
        of("part", 2, F.concat(F.col("p_brand"), key("/part_", "p_partkey")), F.col("p_name"), F.col("p_name"), F.col("p_size")),
        of("orders", 3, key("orders/order_", "o_orderkey"), key("order_", "o_orderkey"), key("order_", "o_orderkey")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    sign = F.when(F.col("kind") == 2, F.concat(F.lit("func "), F.col("name"), F.lit("()"))).otherwise("")
    return out.select(t.node_id(F.col("path"), F.col("symbol")).alias("id"), "kind", "name", "path", "symbol", F.lit(1).alias("line"), "param_count", t.package_of(F.col("path")).alias("package"), sign.alias("signature"), F.lit("").alias("doc"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, line, callsite, arg_count: calls, imports, references and contains edges, a bag."""
    item, parts, orders, supp = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders", "supplier"))

    def ident(path, symbol=None):
        return t.node_id(path, F.lit("") if symbol is None else symbol)

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    order = ident(key("orders/order_", "l_orderkey"), key("order_", "l_orderkey"))
    part_ids = parts.select(F.col("p_partkey").alias("l_partkey"), ident(F.concat(F.col("p_brand"), key("/part_", "p_partkey")), F.col("p_name")).alias("dst"), F.col("p_name").alias("callsite"))
    supplier_path = F.concat(key("nation_", "s_nationkey"), key("/supplier_", "s_suppkey"))
    supplier_ids = supp.select(F.col("s_suppkey").alias("l_suppkey"), ident(supplier_path).alias("dst"))
    customers = table(spark, sf_dir, "customer")
    customer_path = F.concat(key("nation_", "c_nationkey"), key("/customer_", "c_custkey"))
    customer_ids = customers.select(F.col("c_custkey").alias("o_custkey"), ident(customer_path).alias("dst"))
    nation = table(spark, sf_dir, "nation")

    def shape(df, src, kind, line=None, callsite=None, args=None):
        return df.select(src.alias("src"), "dst", F.lit(kind).alias("kind"), (F.lit(0) if line is None else line).alias("line"), (F.lit("") if callsite is None else callsite).alias("callsite"), (F.lit(0) if args is None else args).alias("arg_count"))

    region_id, nation_id = ident(key("region/", "n_regionkey")), ident(key("nation/", "n_nationkey"))
    rows = [
        shape(item.join(part_ids, "l_partkey"), order, 1, F.col("l_linenumber"), F.col("callsite"), F.col("l_quantity").cast("int")),
        shape(item.join(supplier_ids, "l_suppkey"), order, 0),
        shape(orders.join(customer_ids, "o_custkey"), ident(key("orders/order_", "o_orderkey"), key("order_", "o_orderkey")), 4),
        shape(nation.withColumn("dst", nation_id), region_id, 3),
        shape(customers.withColumn("dst", ident(customer_path)), ident(key("nation/", "c_nationkey")), 3),
        shape(supp.withColumn("dst", ident(supplier_path)), ident(key("nation/", "s_nationkey")), 3),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def copurchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, line: from each part of an order to the next one. A directed graph with cycles."""
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return item.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("dst"), F.col("l_linenumber").alias("line")).filter("dst is not null")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, vector (doubles), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, operation, created_at, tokens: answers kept for users."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("tokens"), "event_id")


# The same relations for DuckDB.
SQL = {
    "files_v": """select doc_id, path, size, regexp_extract(path, '(\\.[^./]*)$', 1) as ext, cast(floor(size / 3.5) as int) as tokens,
      case regexp_extract(path, '(\\.[^./]*)$', 1) when '.py' then 'python' when '.go' then 'go' when '.ts' then 'typescript' else 'rust' end as language
      from (select doc_id, n_chars as size, source || '/' || lang || '/doc_' || doc_id || case lang when 'en' then '.py' when 'fr' then '.go' when 'de' then '.ts' else '.rs' end as path from documents)""",
    "imports_v": """select path, language, unnest(['pkg/doc_' || (doc_id + 1), 'mod.doc_' || (doc_id // 2), 'lib/' || split_part(path, '/', 2), ['fmt', 'os', 'json'][doc_id % 3 + 1]]) as imp from files_v""",
    "changes_v": """select path, cast(quality * 10 + 1 as bigint) as added, cast(toxic as bigint) as removed, quality = 0 as untracked from files_v join labels using (doc_id)""",
    "nodes_v": """select substr(sha256(path || ':' || symbol), 1, 32) as id, *, 1 as line, split_part(path, '/', -2) as package, case when kind = 2 then 'func ' || name || '()' else '' end as signature from (
      select 1 as kind, r_name as name, 'region/' || r_regionkey as path, '' as symbol, 0 as param_count from region union all
      select 1, n_name, 'nation/' || n_nationkey, '', 0 from nation union all
      select 0, c_name, 'nation_' || c_nationkey || '/customer_' || c_custkey, '', 0 from customer union all
      select 0, s_name, 'nation_' || s_nationkey || '/supplier_' || s_suppkey, '', 0 from supplier union all
      select 2, p_name, p_brand || '/part_' || p_partkey, p_name, p_size from part union all
      select 3, 'order_' || o_orderkey, 'orders/order_' || o_orderkey, 'order_' || o_orderkey, 0 from orders)""",
    "edges_v": """select substr(sha256(src), 1, 32) as src, substr(sha256(dst), 1, 32) as dst, kind, line, callsite, arg_count from (
      select 'orders/order_' || l_orderkey || ':order_' || l_orderkey as src, p_brand || '/part_' || p_partkey || ':' || p_name as dst, 1 as kind, l_linenumber as line, p_name as callsite, cast(floor(l_quantity) as int) as arg_count from lineitem join part on l_partkey = p_partkey union all
      select 'orders/order_' || l_orderkey || ':order_' || l_orderkey, 'nation_' || s_nationkey || '/supplier_' || s_suppkey || ':', 0, 0, '', 0 from lineitem join supplier on l_suppkey = s_suppkey union all
      select 'orders/order_' || o_orderkey || ':order_' || o_orderkey, 'nation_' || c_nationkey || '/customer_' || c_custkey || ':', 4, 0, '', 0 from orders join customer on o_custkey = c_custkey union all
      select 'region/' || n_regionkey || ':', 'nation/' || n_nationkey || ':', 3, 0, '', 0 from nation union all
      select 'nation/' || c_nationkey || ':', 'nation_' || c_nationkey || '/customer_' || c_custkey || ':', 3, 0, '', 0 from customer union all
      select 'nation/' || s_nationkey || ':', 'nation_' || s_nationkey || '/supplier_' || s_suppkey || ':', 3, 0, '', 0 from supplier)""",
    "copurchase_v": """select src, dst, line from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst, l_linenumber as line from lineitem) where dst is not null""",
    "vectors_v": """select vec_id as node_id, embedding::double[] as vector, label from embeddings""",
    "cache_v": """select user_id as key, event_type as operation, ts as created_at, value as tokens, event_id from events""",
}


def sql(query: str, recursive: bool = False) -> str:
    """query with the views that it names, in order, in front."""
    used, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name in text and name not in used:
                used.add(name)
                todo.append(SQL[name])
    ctes = ",\n".join(f"{name} as ({SQL[name]})" for name in SQL if name in used)
    with_ = "with recursive " if recursive else "with "
    return f"{with_}{ctes}{', ' if ctes and recursive else ' '}{query}" if ctes or recursive else query
