"""A curriculum that mixes sources to target weights that change over the training run.

Targets: sources share `share` times all words by weight; none may take more than `most` times its
own words, and what is above that is shared again by weight among the others (the fixed point is
min(cap, level * weight) for one common level). Within a source, documents stand in a reproducible
random order on a line of words that is walked through again and again until the target is met;
`taken` is the part of a document that lies on the walked line, so taken words equal the target
to within a word. Each source's weight changes linearly over the run; its integral is the words
due by time t, and the inverse of it at a document's place on the line gives the time in 0..1 at
which that pass over the document is trained on. Rows come range-sorted by their first time.

Only DataFrame functions are used. Sorting by range and sums for each range stand in for a window
over a source, so that one source may hold most rows.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents
of size 0 take nothing and have no position; repeated rows are taken on their own; no rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW_BITS, WORD, column, documents, free, row_mark, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: By the rank of a source, repeating: weight at the end minus weight at the start, over their mean.
TILTS = (0.0, 1.0, -1.0)


def _cycle(rank, values):
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets_of(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, tilts=TILTS) -> DataFrame:
    """_source, source_size, target, tilt for each source of sizes(_source, size). Windows here see one row for each source."""
    by_name = Window.orderBy(F.col("_source.missing"), F.col("_source.name"))
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumns({"weight": _cycle(F.col("rank"), weights), "tilt": _cycle(F.col("rank"), tilts), "cap": F.col("source_size") * F.lit(most)})
    everything, full_first = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    due = F.sum("source_size").over(everything) * F.lit(share)
    # The level if this source and those that fill up later share what the earlier ones leave.
    level = (due - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # Those whose cap is under their level are full; the first that isn't has the common level.
    common = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.when(common.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), common * F.col("weight"))))
    return per.select("_source", "source_size", "target", "tilt")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, key: Column | None = None, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions of every row, sorted by first position.

    positions has a time for each pass that takes some of the document, whole_positions for each
    that takes half of it or more: a mix of whole documents. key, if given, is carried along as _key.
    """
    source = column(docs, source_col)
    name = F.struct(source.isNull().alias("missing"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))
    size = F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long")
    mix = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, id_col).cast("string"), F.lit(""))), 256), 1, 16)
    rows = docs.select(column(docs, id_col).alias("doc_id"), name.alias("_source"), size.alias("size"), mix.alias("_mix"), (F.lit(None) if key is None else key).alias("_key"))
    order = (F.col("_source"), F.col("_mix"), F.col("doc_id"), F.col("size"))
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", ROW_BITS))
    sums = rows.groupBy("_source", "_part").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_base"))
    per = targets_of(rows.select("_source", "size"), **how)
    inside = Window.partitionBy("_source", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, ["_source", "_part"]).join(per, "_source").withColumn("_start", F.col("_start") + F.col("_base"))
    passes = F.sequence(F.lit(0), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int"))
    walked = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    part = F.transform(passes, lambda e: F.greatest(F.lit(0), F.least(F.col("size"), walked - e * F.col("source_size") - F.col("_start"))))
    taken = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    # Words due by t: target * (t + tilt / 2 * (t * t - t)); its inverse at a share x of the target.
    half = F.col("tilt") / 2

    def when(e):
        x = F.least(F.lit(1.0), (e * F.col("source_size") + F.col("_start")) / F.col("target"))
        root = F.sqrt((1 - half) * (1 - half) + 4 * half * x)
        return F.when(half == 0, x).otherwise((root - (1 - half)) / F.nullif(2 * half, F.lit(0.0)) + F.lit(0.0))

    due = F.filter(passes, lambda e: (F.col("size") > 0) & (e * F.col("source_size") + F.col("_start") < walked))
    whole = F.filter(due, lambda e: 2 * (walked - e * F.col("source_size") - F.col("_start")) >= F.col("size"))
    out = rows.withColumns({"taken": taken, "positions": F.transform(due, when), "whole_positions": F.transform(whole, when)}).withColumn("position", F.try_element_at("positions", F.lit(1)))
    first = F.asc_nulls_last("position")
    return out.select("doc_id", "size", "source_size", "target", "taken", "positions", "whole_positions", "position", *(["_key"] if key is not None else [])).repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, F.col("doc_id"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs in training order: a whole row for each pass that takes half of it or more.

    The plan is made on narrow rows; texts move once to meet it and once to be sorted by range. Rows are known by
    all their columns: what is equal in all of them is one row with the passes of its copies.
    """
    # A string: a struct read back has nullable fields, is cast to meet another, and moves the texts once more.
    mark = row_mark(docs, id_col)
    plan = mixed(docs, id_col=id_col, text_col=text_col, key=mark, **how)
    key, place = free(docs, "_key"), free(docs, "_position")
    due = plan.select(F.col("_key").alias(f"{key}p"), F.explode("whole_positions").alias(place))
    rows = docs.withColumn(key, mark).dropDuplicates([key])
    out = rows.join(due, rows[key] == due[f"{key}p"]).select(*[rows[f"`{c}`"] for c in docs.columns], F.col(place))
    order = F.col(place), F.col(f"`{id_col}`")
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop(place)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


QUERIES = {"op9_curriculum_mix": op9_curriculum_mix}
ORACLES = {
    "op9_curriculum_mix": r"""with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, source is null as missing, coalesce(source, '') as name, substr(sha256('11:' || doc_id), 1, 16) as mix from documents),
  s as (select missing, name, sum(size)::bigint as source_size, row_number() over (order by missing, name) - 1 as rank from d group by missing, name),
  w as (select *, ([3, 1, 2]::double[])[rank % 3 + 1] as weight, ([0, 1, -1]::double[])[rank % 3 + 1] as tilt, source_size * 2::double as cap from s),
  l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over earlier, 0)) / (sum(weight) over () - coalesce(sum(weight) over earlier, 0)) as level from w window earlier as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
  c as (select arg_min(level, (cap / weight, rank)) as common from l where cap > level * weight),
  t as (select l.*, case when common is null then cap else least(cap, common * weight) end as target from l, c),
  r as (select d.*, source_size, target, tilt / 2 as half, floor(target + 0.5::double)::bigint as walked, coalesce(sum(size) over (partition by d.missing, d.name order by mix, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d join t on d.missing = t.missing and d.name = t.name),
  x as (select *, least(1::double, start / target) as x from r)
select doc_id, size, source_size, target, (greatest(0, least(size, walked - start)) + greatest(0, least(size, walked - source_size - start)) + greatest(0, least(size, walked - 2 * source_size - start)))::bigint as taken,
  case when size > 0 and start < walked then case when half = 0 then x else (sqrt((1 - half) * (1 - half) + 4 * half * x) - (1 - half)) / (2 * half) + 0::double end end as position from x""",
}
