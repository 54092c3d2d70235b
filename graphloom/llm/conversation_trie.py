"""The prefix trie of conversations by a skeleton of splitters.

Every conversation is a path: one digest of 16 bytes for each turn (role and text). Paths are dealt by range of
(path, conv_id) at splitters, so the members of a node - all paths that begin with its own - are a run of neighbouring
rows. A run that a splitter cuts has that splitter's path below its node; so the trie of the splitter paths, the
skeleton, has every node whose members are in several shards. It is broadcast. Each shard is sorted and walked
once with a stack of open nodes: nodes outside the skeleton are finished there, and for nodes of the skeleton
a shard gives partial counts, which are summed by node and combined from the deepest node up.

Splitters are rows at equal ranks of a sample that a hash of the id chooses; they decide how even the
shards are, not what a node holds. There are as many as NODES allows for the longest path among them: the skeleton has
NODES nodes at most, and the root. Members that end at a skeleton node are hashed as one stream: a shard
puts its ids, ascending, into strings of CHUNK bytes, and a task carries one hash over these in order.

Defined cases: a null role or text is empty; turns with one number (null is the first) are ordered by role,
then by the digest; rows without conv_id are part of no conversation; repeated rows are turns of their own; a
conversation's turns stand in one row of 20 bytes a turn; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, column, written

#: The most nodes of the skeleton besides its root, sampled rows for each splitter, bytes of ids in one string.
NODES, SAMPLED, CHUNK = 200_000, 24, 1 << 20
#: How many turns a conversation may take over from another.
HEADS = 6


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, path (a digest for each turn, in order), sizes (code points of its text)."""
    role, text = (F.coalesce(column(rows, c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn, digest = column(rows, "turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    one = F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("size"))
    each = rows.filter(column(rows, "conv_id").isNotNull()).select(column(rows, "conv_id").cast("long").alias("conv_id"), one.alias("x"))
    own = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return own.select("conv_id", F.col("x.digest").alias("path"), F.col("x.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The conversations with their first turns, fewer than HEADS, from the first conversation of their hundred."""
    head = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, HEADS).alias("_path"), F.slice("sizes", 1, HEADS).alias("_sizes"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    both = own.withColumns({"_taken": taken, "_base": base}).join(head, "_base", "left")

    def joined(first: str, rest: str) -> Column:
        mine = F.slice(rest, F.col("_taken") + 1, F.greatest(F.size(rest), F.lit(0)))
        return F.when(F.col(first).isNull(), mine).otherwise(F.concat(F.slice(first, F.lit(1), F.col("_taken")), mine))

    return both.select("conv_id", joined("_path", "path").alias("path"), joined("_sizes", "sizes").alias("sizes"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[list[bytes], int]]:
    """Rows (path, conv_id) of paths that cut it into about equal parts, at most shards - 1 of them."""
    n, longest = paths.agg(F.count("*"), F.max(F.size("path"))).first()
    shards = min(shards, 1 + NODES // max(1, longest or 0))
    if n == 0 or shards < 2:
        return []
    every = max(1, n // (SAMPLED * shards))
    some = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id")
    rank = F.ntile(shards).over(Window.orderBy("path", "conv_id"))  # over the sample
    first = F.min(F.struct("path", "conv_id")).alias("x")
    cut = some.withColumn("_of", rank).groupBy("_of").agg(first).orderBy("_of").select("x.path", "x.conv_id").collect()
    return [([bytes(d) for d in r.path], r.conv_id) for r in cut[1:]]


class Skeleton:
    """The trie of the splitter paths: the number of a node under its parent's number and its digest. 0 is the root."""

    def __init__(self, cuts: list[tuple[list[bytes], int]]):
        self.cuts, self.below, self.parents = cuts, {}, [None]
        for path, _ in cuts:
            at = 0
            for digest in path:
                if (at, digest) not in self.below:
                    self.below[at, digest] = len(self.parents)
                    self.parents.append(at)
                at = self.below[at, digest]


MADE = "kind string, node int, shard int, part int, conv_id long, depth int, parent_node int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size int, ids binary, ends_sha256 string"
NAMES = [x.split()[0] for x in MADE.split(", ")]
#: Kinds of rows that a shard gives: a finished node, counts of a skeleton node, ids that end at one.
NODE, PARTIAL, ENDS = "node", "partial", "ends"


class Open:
    """A node whose members are being read."""

    __slots__ = ("children", "conv", "depth", "digest", "ends", "first", "kids", "leaves", "n", "node", "saved", "size")

    def __init__(self, depth: int, digest: bytes, size: int, node: int | None):
        self.depth, self.digest, self.size, self.node = depth, digest, size, node
        self.n = self.kids = self.leaves = self.saved = 0
        self.conv, self.first, self.children = None, True, []
        self.ends = hashlib.sha256() if node is None else bytearray()


class Walk:
    """Rows of one shard after the other, in order; `out` gathers what is made."""

    def __init__(self, skeleton: Skeleton, chunk: int):
        self.skeleton, self.chunk, self.out = skeleton, chunk, []
        self.shard, self.stack, self.parts = None, [], 0

    def add(self, kind: str, **values) -> None:
        self.out.append({"kind": kind, "shard": self.shard, **values})

    def flush(self, top: Open) -> None:
        self.add(ENDS, node=top.node, part=self.parts, ids=bytes(top.ends))
        self.parts += 1
        top.ends = bytearray()

    def close(self) -> None:
        top, parent = self.stack.pop(), self.stack[-1] if self.stack else None
        if top.node is None:
            row = {"depth": top.depth, "conv_id": top.conv, "n_convs": top.n, "n_children": top.kids, "n_leaves": top.leaves + (top.kids == 0), "saved_tokens": top.saved + (top.n - 1) * top.size, "ends_sha256": top.ends.hexdigest()}
            for child in top.children:
                self.add(NODE, parent_conv_id=top.conv, **child)
            if parent is None:
                self.add(NODE, **row)
            elif parent.node is None:
                parent.children.append(row)  # the least member of the parent isn't known yet
            else:
                self.add(NODE, parent_node=parent.node, **row)
            made = row["n_leaves"], row["saved_tokens"]
        else:
            if top.ends:
                self.flush(top)
            self.add(PARTIAL, node=top.node, depth=top.depth, conv_id=top.conv, n_convs=top.n, n_children=top.kids, n_leaves=top.leaves, saved_tokens=top.saved, size=top.size)
            made = 0, 0  # what is under a skeleton node is added to those above it once, after all shards
        if parent is not None:
            parent.n += top.n
            parent.conv = top.conv if parent.conv is None else min(parent.conv, top.conv)
            parent.kids += top.node is None
            parent.leaves += made[0]
            parent.saved += made[1]

    def end(self) -> None:
        while self.stack:
            self.close()

    def row(self, shard: int, path: list[bytes], sizes: list[int], conv: int) -> None:
        if shard != self.shard:
            self.end()
            # Without splitters the root has no other shard to be summed with.
            self.shard, self.parts = shard, 0
            self.stack = [Open(0, b"", 0, 0 if self.skeleton.cuts else None)]
        stack, same = self.stack, 0
        most = min(len(path), len(stack) - 1)
        while same < most and stack[same + 1].digest == path[same]:
            same += 1
        while len(stack) > same + 1:
            self.close()
        for depth in range(same + 1, len(path) + 1):
            above = stack[-1].node
            node = None if above is None else self.skeleton.below.get((above, path[depth - 1]))
            stack.append(Open(depth, path[depth - 1], sizes[depth - 1], node))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        mark = (b"" if top.first else b",") + str(conv).encode()
        if top.node is None:
            top.first = False
            top.ends.update(mark)
        else:  # the comma between two strings is put there when they are joined
            top.ends += (b"," if top.ends else b"") + str(conv).encode()
            if len(top.ends) >= self.chunk:
                self.flush(top)

    def made(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.record_batch([pa.array([r.get(n) for r in rows], kinds[x.split()[1]]) for n, x in zip(NAMES, MADE.split(", "), strict=True)], NAMES)


def walked(paths: DataFrame, skeleton: Skeleton, chunk: int = CHUNK) -> DataFrame:
    """What all shards make of paths(conv_id, path, sizes)."""
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value.cuts
        for batch in batches(frames):
            shards = [bisect_right(cuts, (p, c)) for p, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(shards, pa.int32())], ["conv_id", "path", "sizes", "shard"])

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walk(shared.value, chunk)
        for batch in batches(frames, 1 << 20):
            for row in zip(*(batch.column(k).to_pylist() for k in (3, 1, 2, 0)), strict=True):
                w.row(*row)
            if len(w.out) >= 4096:
                yield w.made()
        w.end()
        yield w.made()

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(deal, "conv_id long, path array<binary>, sizes array<int>, shard int")
    return dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, MADE)


def hashes(made: DataFrame) -> DataFrame:
    """node, ends_sha256 of the skeleton nodes where paths end: one hash is carried over a node's strings."""

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches(frames):
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node != at:
                    if state:
                        out.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.as_py())
                else:
                    state.update(b"," + ids.as_py())
        if state:
            out.append((at, state.hexdigest()))
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])

    ends = made.filter(F.col("kind") == ENDS).select("node", "shard", "part", "ids")
    return ends.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ids").mapInArrow(fold, "node int, ends_sha256 string")


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def reduced(made: DataFrame, skeleton: Skeleton) -> dict[int, tuple]:
    """The finished skeleton nodes by number, as rows of OUT: its sums, NODES at most, combined from the deepest up."""
    sums = made.filter(F.col("kind") == PARTIAL).groupBy("node").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv"), F.first("size").alias("size"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = {r.node: r.ends_sha256 for r in hashes(made).collect()}
    rows = {r.node: r.asDict() for r in sums.collect()}
    for node in rows:
        if node:
            rows[skeleton.parents[node]]["n_children"] += 1
    for node in sorted(rows, key=lambda k: -rows[k]["depth"]):
        r = rows[node]
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        if node:
            above = rows[skeleton.parents[node]]
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    none = hashlib.sha256().hexdigest()
    return {k: (r["conv"], r["depth"], rows[skeleton.parents[k]]["conv"] if k else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], ends.get(k, none)) for k, r in rows.items()}


def trie(rows: DataFrame, shards: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations of rows(conv_id, turn, role, text)."""
    spark = rows.sparkSession
    paths = written(rebuilt(turns(rows)))
    skeleton = Skeleton(splitters(paths, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    made = written(walked(paths, skeleton, chunk))
    known = reduced(made, skeleton)
    own = spark.createDataFrame(list(known.values()), OUT)
    parents = spark.createDataFrame([(k, r[0]) for k, r in known.items()], "parent_node int, _conv long")
    nodes = made.filter(F.col("kind") == NODE).join(F.broadcast(parents), "parent_node", "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).withColumn("depth", F.col("depth").cast("long"))
    return nodes.select(*own.columns).unionByName(own)


def op12_splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op12_splitter_skeleton": op12_splitter_skeleton}
ORACLES = {
    # The checksum goes bit by bit: a byte is mixed in, then eight shifts (-1).
    "op12_splitter_skeleton": """with k as (select conv_id, turn, coalesce(role, '') as r, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key, length(coalesce(text, '')) as size from conversations where conv_id is not null),
  own as (select conv_id, list(key order by turn nulls first, r, key) as p, list(size order by turn nulls first, r, key) as z from k group by conv_id),
  s as (select conv_id, conv_id - conv_id % 100 as base, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps from own),
  h as (select conv_id, base, xor(list_reduce(steps, lambda c, o: case when o >= 0 then xor(c, o) else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end, 4294967295::bigint), 4294967295::bigint) % 6 as h from s),
  b as (select o.conv_id, list_concat(coalesce(f.p[1:h], []), o.p[h + 1:]) as p, list_concat(coalesce(f.z[1:h], []), o.z[h + 1:]) as z from own o join h using (conv_id) left join own f on f.conv_id = base),
  m as (select *, unnest(generate_series(0, len(p))) as d from b),
  n as (select d, p[1:d] as q, min(conv_id) as conv_id, count(*) as n, case when d = 0 then 0 else any_value(z[d]) end as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(p) = d), '')) as ends from m group by d, q),
  c as (select d - 1 as d, q[1:d - 1] as q, count(*) as kids from n where d > 0 group by all),
  t as (select i as d, q[1:i] as q, count(*) filter (kids is null) as leaves, sum((n - 1) * size) as saved from (select *, unnest(generate_series(0, d)) as i from n left join c using (d, q)) group by all)
select n.conv_id, d as depth, a.conv_id as parent_conv_id, n.n as n_convs, coalesce(kids, 0)::bigint as n_children, leaves as n_leaves, saved::bigint as saved_tokens, n.ends as ends_sha256
from n join t using (d, q) left join c using (d, q) left join (select d + 1 as below, q as up, conv_id from n) a on below = d and up = q[1:d - 1]""",
}
