"""How quality filters interact: what each removes in every order that they can be applied in.

A document's failures are a mask of five bits. Texts are read once, for narrow rows of text digest,
four bits and part; copies are told from the first of their text (E) in counts for each digest, not by joining
documents with each other. All further work is on cells: the documents of a part with one mask, counted, of which
a part has 32 at most. Each cell folds across an array of all 120 orders: `transform` takes an order,
`aggregate` carries through its steps whether an earlier filter has removed the cell, and every step adds a struct
weighted with the cell's counts. The cells' arrays of 600 structs are then summed element by element for each part.

Defined cases: a null text is the empty text; a null language is the part ''; a document without a label is
neither good nor toxic, and of repeated labels one is enough; of rows with a text, those of the least id that is
not null pass E, and so do rows without an id, as they are neither smaller nor larger; repeated rows count
apart; no rows give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, column, documents, written

LETTERS = "ABCDE"
#: All orders, in that of the alphabet.
ORDERS = tuple("".join(p) for p in permutations(LETTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """The bits A to D of a text (not null)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    few = F.size(words) < 200
    same = F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(50).cast("long")
    loud = upper * F.lit(100).cast("long") > F.length(text) * F.lit(3).cast("long")
    signs = text.rlike(r"[#$%&*|]")
    return sum((c.cast("int") * (1 << i) for i, c in enumerate((few, same, loud, signs))), F.lit(0))


def flags(labels: DataFrame, id_col: str) -> DataFrame:
    """One row for each labelled id: whether any of its labels says good, and toxic."""
    one = labels.filter(column(labels, id_col).isNotNull()).groupBy(column(labels, id_col).alias("_id"))
    return one.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part that fail the same filters."""
    text, own = F.coalesce(column(docs, text_col), F.lit("")), column(docs, id_col)
    part = F.coalesce(column(docs, part_col).cast("string"), F.lit(""))
    rows = docs.select(own.alias("_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    each = written(rows.groupBy("_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    known = each.filter(F.col("_id").isNotNull()).join(flags(labels, id_col), "_id", "left")
    none = each.filter(F.col("_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    each = known.unionByName(none).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # Of each text, its rows with equal flags: how many, and those of the least id among them.
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    unnamed = F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0))
    alike = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), unnamed.alias("unnamed"))
    # One id may have a text in several parts: all its rows are the first.
    least = alike.groupBy("digest").agg(F.min("first._id").alias("least"))
    alike = alike.join(least, "digest")
    passing = F.col("unnamed") + F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n"))))
    each = alike.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


STEP = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def folded(orders: Column) -> Column:
    """Of a cell, an array of one struct for each step of each order."""
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = F.col("mask").bitwiseAND(bit) != 0, state["gone"]
        here = fails & ~gone

        def counted(when: Column, count: str) -> Column:
            return F.when(when, F.col(count)).otherwise(zero)

        made = (counted(~fails & ~gone, "n"), counted(here, "n"), counted(fails & gone, "n"), counted(F.col("mask") == bit, "n"), counted(here, "good"), counted(here, "toxic"))
        one = F.struct(*[x.alias(c) for x, c in zip(made, COUNTS, strict=True)])
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(one)).alias("steps"))

    def order(bits: Column) -> Column:
        start = F.struct(F.lit(False).alias("gone"), F.expr(f"cast(array() as array<{STEP}>)").alias("steps"))
        return F.aggregate(bits, start, step, lambda s: s["steps"])

    return F.flatten(F.transform(orders, order))


def summed(arrays: Column) -> Column:
    """Arrays of equal length, added element by element and field by field."""

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    rest = F.slice(arrays, F.lit(2), F.size(arrays))
    return F.aggregate(rest, F.element_at(arrays, 1), lambda s, x: F.zip_with(s, x, add))


def audited(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """part, filter_order, step, filter, the counts, shapley: 600 rows for each part."""
    bits = F.array(*[F.array(*[F.lit(1 << LETTERS.index(x)) for x in o]) for o in ORDERS])
    names = F.array(*map(F.lit, ORDERS))
    each = cells(docs, labels, **how).withColumn("steps", folded(bits))
    # A part has 32 cells at most.
    parts = each.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", summed(F.col("cells")).alias("steps"))
    at = F.floor(F.col("at") / 5).cast("int")
    rows = parts.select("part", F.posexplode("steps").alias("at", "x")).select("part", F.element_at(names, at + 1).alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"), "x.*")
    rows = rows.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    total = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "filter"]).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def op13_filter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op13_filter_folds": op13_filter_folds}
ORACLES = {
    "op13_filter_folds": r"""with recursive o as (select '' as o union all select o || l from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as l) where not contains(o, l)),
  s as (select o, unnest([1, 2, 3, 4, 5])::int as step from o where length(o) = 5),
  l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
  d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when d.doc_id > min(d.doc_id) over (partition by text) then 'E' else '' end as f from d left join l using (doc_id)),
  c as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, f),
  r as (select part, o as filter_order, step, o[step] as filter, contains(f, o[step]) as fails, regexp_matches(f, '[' || o[:step - 1] || '~]') as gone, f, n, good, toxic from c, s),
  g as (select part, filter_order, step, filter, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (f = filter), 0)::bigint as unique_fails, coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost from r group by all)
select *, sum(removed) over (partition by part, filter)::bigint as shapley from g""",
}
