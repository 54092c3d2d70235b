"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's set of word shingles has `coordinates` minimum hashes. Texts with the same set are
one class, of which one stands for all. Every class is posted under each of its pairs (coordinate,
value). A pair of classes at the threshold agrees in at least `agreements` coordinates but for a
chance of one in a million, so of each class only the rarest coordinates - all but
`agreements` - 1 of them - need lists (prefix); the others are skipped and counted by comparing
signatures. What agrees often enough is confirmed on full sets.

A list of n classes is not expanded into pairs. Every member is first compared with the list's
most central member, those still apart with its next few; components of the links found so far are
formed each time, and only lists whose members are in several components are looked at again: short
ones pair by pair across components, long ones by an exact prefix filter on the full shingle sets
of their members. A shingle prefix leaves
out whatever differs from everything else in too many shingles to be linked, so large groups of
edited copies end there, and no pair over the threshold is lost in this step.

Defined cases: null and wordless texts have no set, are linked with nothing and are their own
component; a text with fewer words than a shingle is one shingle; repeated rows and equal texts
are in one component; rows with a null id get a component of the least id of theirs that is not
null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alone, batches, column, documents, free, met, written
from .components import components

COORDINATES = 64
#: Lists of up to so many classes are paired as they are; longer ones go through shingle prefixes.
SHORT = 24
#: Central members that a second round compares with.
CENTRES = 6
MEMO = 150_000
#: The ratio of the size classes in which shingle prefixes are taken.
CLASS = 1.02


class Words(dict):
    """Hashes of words; what it remembers is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text. bytes.lower and bytes.split know ASCII alone."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    size = min(size, len(h)) if len(h) < size else size
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def _keys(coordinates: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.full(len(keys), (1 << 32) - 1, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, ((found[at : at + 4096, None] * keys) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32).view(np.int32)


def agreements(coordinates: int, percent: int, miss: float = 1e-6) -> int:
    """The most agreements that a pair at the threshold misses with a chance of at most `miss`."""
    p, tail = percent / 100, 0.0
    for k in range(coordinates + 1):
        tail += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if tail > miss:
            return max(1, k)
    return coordinates


def signed(docs: DataFrame, size: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a digest of the text), n_shingles, same (128 bits that name the set; null without one), signature of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    keys = _keys(coordinates)

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words", WORDS.clear)
        for batch in batches(frames):
            sets = [shingles(x.as_py(), size) for x in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, keys) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                ["doc_id", "mark", "n_shingles", "same", "signature"],
            )
        WORDS.clear()  # workers live on, and other operators need the room

    text = column(docs, text_col)
    rows = docs.select(column(docs, id_col).alias("doc_id"), marks(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, mark binary, n_shingles long, same binary, signature array<int>")


def marks(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def alike(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """Of pairs(a, b, ...), those whose set sizes allow the threshold and whose signatures agree often enough."""
    side = classes.select("id", "n_shingles", "signature")
    a, b = (side.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.filter(same >= least).select(*pairs.columns)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose full shingle sets, from texts(id, text), reach the threshold."""
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words", WORDS.clear)
        last, found = None, None
        for batch in batches(frames):
            keep = []
            for one, other, text in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                if other.as_py() != last:
                    last, found = other.as_py(), shingles(text.as_py(), size)
                mine = shingles(one.as_py(), size)
                both = len(np.intersect1d(mine, found, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(found) - both))
            yield pa.record_batch([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        WORDS.clear()

    rows = pairs.join(a, "a").join(b, "b").select("a", "ta", "b", "tb")
    return rows.mapInArrow(check, "a long, b long")


def postings(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """token, id, size, central of the rarest coordinates of each class, without those that it alone has."""
    each = classes.select("id", F.col("n_shingles").cast("int").alias("size"), F.posexplode("signature").alias("at", "value"))
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    each = each.select("id", "size", token.alias("token"))
    counts = written(each.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1"))
    lists = met(each, counts, "token", "id").withColumnRenamed("members", "n")
    mine = Window.partitionBy("id")
    lists = lists.withColumns({"shared": F.count("*").over(mine), "central": F.sum("n").over(mine), "rank": F.row_number().over(mine.orderBy("n", "token"))})
    # Coordinates of its own count as its rarest.
    return lists.filter(F.col("rank") + (coordinates - F.col("shared")) <= coordinates - least + 1).select("token", "id", "size", "central")


def across(lists: DataFrame, keys: list[str], where: str = "true", more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (a, b) of members of a list that are in different components; where may compare the columns `more` of both, x_a and x_b."""
    a, b = (lists.select(*keys, F.col("id").alias(x), F.col("component").alias(f"c_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in more]) for x in "ab")
    return a.join(b, keys).filter(f"a < b and c_a <> c_b and {where}").select("a", "b").distinct()


def centred(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a list's members with its most central ones, where these are in other components.

    The window sees at most CENTRES rows of a list from each task.
    """
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("central"), "id"))
    top = lists.withColumn("_rank", rank).filter(F.col("_rank") <= CENTRES)
    # Few rows for each list, so they are gathered in one.
    top = written(top.groupBy("token").agg(F.first("members").alias("members"), F.collect_list(F.struct(F.col("id").alias("top"), F.col("component").alias("of"), F.col("size").alias("top_size"))).alias("tops")))
    apart = F.filter("tops", lambda t: (t["of"] != F.col("component")) & sizes_allow(F.col("size"), t["top_size"], percent))
    pairs = met(lists.drop("members"), top, "token", "id").select("id", F.explode(apart).alias("t")).select("id", "t.top")
    return pairs.select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")).distinct()


def sizes_allow(a: str | Column, b: str | Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * percent


def shingle_prefixes(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """id, component, n, rank and list keys (shingle, low, high) under which every pair at the threshold meets.

    low and high are the size classes of the two: for each class its partner may be in, a set posts
    its rarest shingles up to where the overlap that sizes ask for could no longer be reached.
    """

    def explode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 4 << 20):
            for i, c, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = shingles(text.as_py(), size).view(np.int64)
                n = len(found)
                yield pa.record_batch([pa.array(np.full(n, i.as_py())), pa.array(np.full(n, c.as_py())), pa.array(np.full(n, n)), pa.array(found)], ["id", "component", "n", "shingle"])

    each = members.join(texts, "id").select("id", "component", "text").mapInArrow(explode, "id long, component long, n long, shingle long")
    common = each.groupBy("shingle").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("freq", "shingle"))
    each = each.join(common, "shingle").withColumn("rank", rank)
    cls = F.floor(F.log("n") / F.log(F.lit(CLASS)) + F.lit(1e-9)).cast("int")
    low, high = (F.floor(F.log(x) / F.log(F.lit(CLASS)) + F.lit(1e-9)).cast("int") for x in (F.ceil(F.col("n") * percent / 100).cast("double"), F.floor(F.col("n") * 100 / F.lit(percent)).cast("double")))
    each = each.filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("freq") > 1)).withColumn("own", cls).withColumn("other", F.explode(F.sequence(F.greatest(low - 1, F.lit(0)), high + 1)))
    # The least partner in a class; one less guards the rounding of the class bounds.
    partner = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("other"))) - 1, F.ceil(F.col("n") * percent / 100), F.lit(1))
    overlap = F.ceil(F.lit(percent) * (F.col("n") + partner) / (100 + percent) - 1e-9)
    kept = each.filter(F.col("rank") <= F.col("n") - overlap + 1)
    return kept.select("id", "component", "n", "rank", "shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with component and members, without the lists whose members are all in one component."""
    known = lists.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = known.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("_min"), F.max("component").alias("_max"))
    return met(known, written(spread.filter("_min <> _max").drop("_min", "_max")), "token", "id")


def linked(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, mark, n_shingles, same) and the classes of equal sets (same, members, least_id, component), by links at the threshold."""
    least = agreements(coordinates, percent)
    rows = written(signed(docs, size, coordinates, id_col, text_col))
    sets = rows.filter(F.col("same").isNotNull())
    first = F.min(F.struct("doc_id", "mark"))  # of the class, the row whose text stands for it
    classes = written(sets.groupBy("same").agg(F.first("n_shingles").alias("n_shingles"), first.alias("row"), F.first("signature").alias("signature"), F.min("doc_id").alias("least_id"), F.count("*").alias("members")).withColumn("id", F.monotonically_increasing_id()))
    lists = written(postings(classes, coordinates, least))
    centre = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "size")).alias("top"), F.count("*").alias("members")).filter("members > 1")
    sized = written(met(lists, written(centre.select("token", "members", (-F.col("top.minus")).alias("centre"), F.col("top.size").alias("centre_size"))), "token", "id"))
    stars = sized.filter("id <> centre").filter(sizes_allow("size", "centre_size", percent)).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), F.lit(True).alias("star"))
    short = sized.filter(F.col("members") <= SHORT)
    one, other = (short.select("token", F.col("id").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
    pairs = stars.unionByName(one.join(other, "token").filter("a < b").filter(sizes_allow("na", "nb", percent)).select("a", "b", F.lit(False).alias("star")))
    near = written(alike(pairs.groupBy("a", "b").agg(F.max("star").alias("star")), classes, percent, least))
    # One text for each class that is in such a pair or in a long list: by id and the text's digest, as ids may be null or repeat.
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(sized.filter(F.col("members") > SHORT).select("id")).distinct()
    wanted = ids.join(classes.select("id", "row"), "id")
    text = column(docs, text_col)
    named = docs.select(text.alias("text"), column(docs, id_col).alias("_id"), marks(text).alias("_mark")).filter(text.isNotNull())
    texts = written(named.join(wanted, F.col("_id").eqNullSafe(F.col("row.doc_id")) & (F.col("_mark") == F.col("row.mark"))).dropDuplicates(["id"]).select("id", "text"))
    links = written(confirmed(near.filter("star").select("a", "b"), texts, size, percent))
    labels = components(links).withColumnRenamed("node", "id")
    left = written(mixed_lists(sized.filter(F.col("members") > SHORT).select("token", "id", "size", "central"), labels))
    more = written(confirmed(alike(centred(left, percent), classes, percent, least).select("a", "b"), texts, size, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links).withColumnRenamed("node", "id")
        left = written(mixed_lists(left.select("token", "id", "size", "central"), labels))
    own = labels.select("id", "component")
    side = [own.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
    pairs = near.filter("not star").select("a", "b").join(side[0], "a", "left").join(side[1], "b", "left").filter("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")
    long = written(left.select("id", "component").distinct())
    if not long.isEmpty():
        prefixes = shingle_prefixes(texts, long, size, percent)
        keys = ["shingle", "low", "high"]
        spread = prefixes.groupBy(*keys).agg(F.min("component").alias("_min"), F.max("component").alias("_max")).filter("_min <> _max").select(*keys)
        # The first shingle that two sets share bounds what they can share after it.
        room = f"(least(n_a - rank_a, n_b - rank_b) + 1) * {100 + percent} >= {percent} * (n_a + n_b)"
        deep = across(written(prefixes.join(spread, keys)), keys, room, ("n", "rank"))
        pairs = pairs.unionByName(alike(deep, classes, percent, least).select("a", "b")).distinct()
    more = written(confirmed(pairs, texts, size, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more)).withColumnRenamed("node", "id")
    named = classes.select("id", "same", "members", "least_id").join(labels, "id", "left")
    return rows, named.select("same", "members", "least_id", F.coalesce("component", "id").alias("component"))


def grouped(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; a row is linked with all rows of its component_id."""
    rows, named = linked(docs, **how)
    named = written(named.withColumnRenamed("members", "rows"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    of_class = written(met(named, smallest, "component", "same").select("same", F.col("rows").alias("members"), "component_id"))
    rows = rows.select("doc_id", "n_shingles", "same")
    out = met(rows.filter(F.col("same").isNotNull()), of_class, "same", "doc_id").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter(F.col("same").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs of each group: of its least id, and one of these if that id repeats. Rows without words all stay.

    Rows are chosen by id and text digest among the narrow rows of the signatures; texts move once to meet them.
    """
    rows, named = linked(docs, size=size, id_col=id_col, text_col=text_col, **how)
    first = F.min(F.struct(F.col("least_id").isNull().alias("missing"), "least_id", "same"))
    keep = named.groupBy("component").agg(first.alias("first")).select("first.same", "first.least_id")
    of_keep = rows.alias("r").join(keep.alias("k"), (F.col("r.same") == F.col("k.same")) & F.col("r.doc_id").eqNullSafe(F.col("k.least_id"))).select("r.*")
    # How often each row of id and text comes, and of several texts with one id and set the least digest.
    marked = of_keep.groupBy("same", "doc_id", "mark").agg(F.count("*").alias("times"))
    chosen = written(marked.groupBy("same").agg(F.min(F.struct("doc_id", "mark", "times")).alias("row")).select("row.*"))
    own, text = column(docs, id_col), column(docs, text_col)
    some = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def picked(keys: DataFrame) -> DataFrame:
        return docs.filter(some).join(keys, own.eqNullSafe(keys["doc_id"]) & (marks(text) == keys["mark"]), "left_semi")

    out = docs.filter(~some).unionByName(picked(chosen.filter("times = 1")))
    if not (repeated := chosen.filter("times > 1")).isEmpty():
        row = free(docs, "_row")
        out = out.unionByName(picked(repeated).withColumn(row, F.struct(own, marks(text))).dropDuplicates([row]).drop(row))
    return out


def op5_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir), size=2)


QUERIES = {"op5_signature_join": op5_signature_join}
#: Exact links by the rarest shingles of each set, and the least id that can be reached.
ORACLES = {
    "op5_signature_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) < 2 then w else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w)),
  n as (select doc_id, count(*) as n from sh group by doc_id),
  f as (select s, count(*) as f from sh group by s),
  pre as (select doc_id, s, n from (select doc_id, s, n, row_number() over (partition by doc_id order by f, s) as r from sh join n using (doc_id) join f using (s)) where r <= n - ceil(n * 4 / 5.0) + 1),
  cand as (select distinct a.doc_id as a, b.doc_id as b, a.n + b.n as nn from pre a join pre b on a.s = b.s and a.doc_id < b.doc_id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
  link as (select a, b from cand join sh x on x.doc_id = a join sh y on y.doc_id = b and x.s = y.s group by a, b, nn having 100 * count(*) >= 80 * (nn - count(*))),
  e as (select a, b from link union all select b, a from link),
  r as (select doc_id as x, doc_id as y from documents union select r.x, e.b from r join e on r.y = e.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) using (doc_id)""",
}
