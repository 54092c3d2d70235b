"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts. For each of `samples` coordinates every
word draws, from a hash of itself and the coordinate alone, r and c from a Gamma(2, 1) law and b
uniform on 0..1. With weight w it quantises t = floor(ln w / r + b) and bids
ln a = ln c - r (t - b + 1); the coordinate's sample is the (word, t) with the least bid. Two
documents agree in a coordinate with a probability equal to their generalised Jaccard similarity,
sum min(w) / sum max(w): with 32 samples the standard error of a likeness is 0.09 at 0.5 and less towards 0
and 1. A sample is kept as 32 bits; bids are compared at a resolution of 2^-22.

Words come from exploding the texts after one shuffle of the rows; all later groupings are by keys
that hold that shuffle's key, so nothing is shuffled again.

Defined cases: a null text is the empty text; a text without words has the empty fingerprint,
which is like another empty one (1) and unlike all others (0); equal texts have equal
fingerprints; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column, documents, written

SAMPLES = 32
#: Coordinates that one row of the exploded table works on.
GROUP = 8
#: Ranges grow in number with the rows, up to what a plan can hold as literals; beyond that they grow in size.
RANGE_ROWS, MOST_RANGES = 640, 8000
SPACE = WORD.replace("[^", "[")


def _uniforms(bits: Column) -> tuple[Column, Column]:
    """Two uniforms inside 0..1 from the halves of 64 hashed bits."""
    low, high = bits.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(bits, 32)
    return (low + F.lit(0.5)) * F.lit(2.0**-32), (high + F.lit(0.5)) * F.lit(2.0**-32)


def bid(word: Column, coordinate: Column, log_weight: Column) -> Column:
    """A long that orders as the bid in its high bits and names the sample in its low 32 bits."""
    u1, u2 = _uniforms(F.xxhash64(word, coordinate, F.lit(1)))
    u3, u4 = _uniforms(F.xxhash64(word, coordinate, F.lit(2)))
    b, _ = _uniforms(F.xxhash64(word, coordinate, F.lit(3)))
    r, log_c = -F.log(u1 * u2), F.log(-F.log(u3 * u4))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    level = ((log_a + F.lit(256.0)) * F.lit(2.0**22)).cast("long")  # ln a lies in -256..256
    name = word.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(level, 32).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], sides: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each text column in sides, its samples as an array<long> of that name.

    keys must name a row; rows whose texts have no words are left out. If texts is partitioned
    by some of the keys, nothing is shuffled.
    """
    each = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(sides)])
    words = texts.select(*keys, F.explode(each).alias("x")).select(*keys, "x.side", F.explode(F.split("x.text", SPACE)).alias("word")).filter(F.col("word") != "")
    words = words.select(*keys, "side", F.xxhash64("word").alias("word"))
    counts = words.groupBy(*keys, "word").agg(*[F.sum(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(sides))])
    logs = counts.select(*keys, "word", *[F.when(F.col(f"n{i}") > 0, F.log(f"n{i}")).alias(f"w{i}") for i in range(len(sides))])
    groups = logs.withColumn("group", F.explode(F.array(*map(F.lit, range(0, samples, GROUP)))))
    bids = [F.min(bid(F.col("word"), F.col("group") + j, F.col(f"w{i}"))).alias(f"b{i}_{j}") for i in range(len(sides)) for j in range(GROUP)]
    least = groups.groupBy(*keys, "group").agg(*bids)
    parts = [F.array(*[F.col(f"b{i}_{j}").bitwiseAND(0xFFFFFFFF) for j in range(GROUP)]).alias(f"p{i}") for i in range(len(sides))]
    whole = least.select(*keys, F.struct("group", *parts).alias("part")).groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = {c: F.flatten(F.col("parts").getField(f"p{i}")) for i, c in enumerate(sides)}
    # A side without words has no bids: its samples are all null.
    return whole.select(*keys, *[F.filter(a, lambda x: x.isNotNull()).alias(c) for c, a in joined.items()])


def likeness(a: Column, b: Column) -> Column:
    """The share of coordinates in which two sample arrays agree."""
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"]))
    either = F.greatest(F.size(a), F.size(b))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / F.nullif(either, F.lit(0)).cast("double"))


def as_hex(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def bounds_of(docs: DataFrame, id_col: Column, buckets: int) -> list:
    """At most `buckets` ids that cut the rows into ranges of near equal size (approximate quantiles)."""
    if docs.select(id_col).schema[0].dataType.typeName() == "string":  # no quantiles of strings: those of a hash-chosen sample of ids
        n = docs.count()
        some = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 20.0 * buckets / max(1, n))))).filter(id_col.isNotNull())
        found = sorted(r[0] for r in some.select(id_col).distinct().collect())  # about 20 for each bucket
        return sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []
    at = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx(id_col, at, max(10_000, 20 * buckets))).first()[0] if at else None
    return sorted({x for x in found or []})


def range_of(value: Column, bounds: list) -> Column:
    """How many bounds are under the value; null values come after all others in falling order, so below all."""
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, round(len(bounds) ** 0.5))
    coarse, fine = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]]), F.array(*[F.lit(x) for x in bounds])

    def under(some: Column) -> Column:  # no lambda: Spark shares one shuffle only between plans without any
        return F.array_position(F.sort_array(F.array_append(some, value)), value) - 1

    whole = under(coarse) * step
    return F.when(value.isNull(), F.lit(-1)).otherwise((whole + under(F.slice(fine, (whole + 1).cast("int"), F.lit(step)))).cast("int"))


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """_range, _row, doc_id, text and next_text: the text of the next row by falling id, after the last the first.

    Rows are dealt into ranges of ids; the first row of each range is also given to the range
    before it as a last row (_extra), so the next row is always at hand. Only ids are looked at
    to find these rows, one for each range.
    """
    key = column(docs, id_col)
    bounds = bounds_of(docs, key, buckets)
    rows = docs.select(key.alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_range", range_of(F.col("doc_id"), bounds))
    ids = rows.groupBy("_range").agg(F.max("doc_id").alias("doc_id"))
    falling = Window.orderBy(F.desc("_range"))
    # Each range's first row goes to the range before it in falling order; the very first to the last range.
    ids = ids.withColumn("_to", F.coalesce(F.lag("_range").over(falling), F.min("_range").over(Window.partitionBy())))
    heads = rows.alias("r").join(F.broadcast(ids.alias("h")), (F.col("r._range") == F.col("h._range")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")))
    heads = heads.groupBy(F.col("h._to").alias("_range"), F.col("h._range").alias("_of"), F.col("h.doc_id").alias("doc_id")).agg(F.max("r.text").alias("text"))
    # At most `buckets` rows. Read back from a table, so that plans which share these rows share one shuffle of them.
    heads = written(heads.withColumn("_extra", F.lit(True)).drop("_of"))
    both = rows.withColumn("_extra", F.lit(False)).unionByName(heads)
    # Never null, so no plan gets a filter of its own on it, which would keep it from that shuffle.
    both = both.withColumn("_range", F.coalesce("_range", F.lit(-1)))
    inside = Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last("doc_id"), F.desc("text"))
    return both.withColumns({"_row": F.row_number().over(inside), "next_text": F.lead("text").over(inside)})


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how near these and the next row's are.

    Rows are dealt into ranges of about RANGE_ROWS, at most MOST_RANGES of them.
    """
    buckets = buckets or min(MOST_RANGES, max(16, docs.count() // RANGE_ROWS))
    rows = with_next(docs, id_col, text_col, buckets)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("_extra"), F.lit("")).otherwise(edited))
    keys = ["_range", "_row"]
    facts = rows.select(*keys, "_extra", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    marks = fingerprints(rows.select(*keys, "text", "edited"), keys, ["text", "edited"], samples).withColumnsRenamed({"text": "own", "edited": "other"})
    none = F.expr("cast(array() as array<bigint>)")
    out = facts.join(marks, keys, "left").withColumns({"own": F.coalesce("own", none), "other": F.coalesce("other", none)})
    out = out.withColumn("following", F.lead("own").over(Window.partitionBy("_range").orderBy("_row"))).filter(~F.col("_extra"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def op1_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


QUERIES = {"op1_weighted_samples": op1_weighted_samples}
ORACLES: dict[str, str] = {}
