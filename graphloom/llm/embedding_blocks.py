"""Near-duplicate embeddings by a subspace pigeonhole join.

Two unit vectors of cosine c are at squared distance 2 - 2c. Vectors are turned to the main axes of a sample of
them, which are dealt to BLOCKS blocks in turn, so that a block's first coordinates are those that spread most; each
block gets a part of the allowed squared distance in proportion to its coordinates. Any rotation gives the
same rows; this one makes cells small. If all blocks were further apart than their parts, the whole would be further than
allowed: so a pair at the threshold is within budget in one block at least. Each block is joined by range on its own:
its first coordinates are cut into cells twice as wide as the block's radius, a vector is at home in
one cell and a visitor in those of the later neighbours that it is within the radius of. All members of a cell
are compared, in batches, by their distance in the block, and what is within budget by the whole
cosine in double precision. A pair may be met in several blocks; it counts where it is within budget for the
first time, so no list of pairs is made: a cell gives each vector's number of links, and a link from each vector to
the least of those it is joined to in the cell. Components come from these.

Equal vectors are one class, of which one is compared. Cells are FINEST wide at least, so a block has at most
(2 / FINEST + 2) ** DIMS of them, whatever the data, and their counts can be sent to the tasks; members of a cell
beyond TILE are cut into parts, and each pair of parts is a group of its own. Links inside a group of n
unlike vectors are n * n facts, each of which is looked at once in a block, but none is written.

Where vectors spread over all axes alike, coordinates tell little: of 64-dimensional random vectors most are in
each other's cells, and the join compares about as many pairs as there are. It pays where few axes carry
most of the spread, as in trained embeddings.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are linked with
nothing; vectors of different lengths aren't linked; equal vectors, also of one id, are rows that are linked with each
other; rows with a null id count as others do, and a component's id is its least that is not null; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, met, written
from .components import components

BLOCKS, DIMS, FINEST = 4, 2, 0.05
#: Vectors of a length that its rotation is fitted to, by a hash of the vector, and lengths that are fitted; others get a random one.
FITTED, LENGTHS = 4096, 8
#: Bytes of vectors of a part of a cell, and vectors that are compared at once.
TILE, CHUNK = 8 << 20, 1024
#: What rounding may add to a squared distance or take from it, and for each coordinate in single precision (twice the bound of a sum of products that are 4 at most together).
SLACK, ROUGH = 1e-9, 2.0**-21


@cache
def random_rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).standard_normal((size, size)))[0]


def main_axes(unit: np.ndarray) -> np.ndarray:
    """A rotation to the axes along which rows differ most, dealt to the blocks in turn."""
    size = unit.shape[1]
    axes = np.linalg.eigh(np.cov(unit.T).reshape(size, size))[1][:, ::-1]
    cut, turn, at = cuts(size), np.empty((size, size)), 0
    for place in range(max(c.stop - c.start for c in cut)):
        for c in cut:
            if c.start + place < c.stop:
                turn[:, c.start + place] = axes[:, at]
                at += 1
    return turn


def rotated(unit: np.ndarray, turns: dict[int, np.ndarray], some: slice = slice(None)) -> np.ndarray:
    """All or some coordinates, which don't depend on the others and the other rows, to the last bit: added up one after the other."""
    size = unit.shape[1]
    turn = (turns[size] if size in turns else random_rotation(size))[:, some]
    out = np.zeros((len(unit), turn.shape[1]))
    for k in range(size):
        out += unit[:, k : k + 1] * turn[k]
    return out


def unit_of(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a row's largest component is brought near 1 first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cuts(size: int) -> list[slice]:
    edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(size: int, least: float) -> list[float]:
    """The squared distance that each block may have, in proportion to its coordinates."""
    return [(2 - 2 * least + SLACK) * (c.stop - c.start) / size for c in cuts(size)]


def neighbours(dims: int) -> np.ndarray:
    """Steps to the later half of a cell's neighbours, itself left out."""
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * dims, indexing="ij"), -1).reshape(-1, dims)
    return steps[len(steps) // 2 + 1 :]


def places(turned: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """block, rows, cells, home: where each row of rotated vectors is posted."""
    for block, (cut, budget) in enumerate(zip(cuts(turned.shape[1]), budgets(turned.shape[1], least), strict=True)):
        radius = np.sqrt(budget) * (1 + SLACK)
        at = turned[:, cut][:, :DIMS]
        dims, width = at.shape[1], max(2 * radius, FINEST)
        own = np.floor(at / width).astype(np.int64)
        into = at - own * width
        weights = (1 << 20) ** np.arange(dims)[::-1]
        yield block, np.arange(len(at)), (own + (1 << 19)) @ weights, True
        for step in neighbours(dims):
            gap = np.where(step > 0, width - into, np.where(step < 0, into, 0.0))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius)
            yield block, near, (own[near] + step + (1 << 19)) @ weights, False


def raw(vectors: pa.Array) -> list[np.ndarray]:
    """The list column's rows as arrays; None for those that link with nothing."""
    out = []
    for v in vectors:
        x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def by_length(vectors: list[np.ndarray | None]) -> dict[int, list[int]]:
    """Row numbers by length of vector."""
    out: dict[int, list[int]] = {}
    for i, x in enumerate(vectors):
        if x is not None:
            out.setdefault(len(x), []).append(i)
    return out


def digested(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, same (128 bits that name the vector; null if it links with nothing), vector."""
    cell = column(rows, vector_col)
    kind = rows.select(cell).schema[0].dataType.elementType.simpleString()
    vector = cell if kind in ("float", "double") else cell.cast("array<double>")
    kind = kind if kind in ("float", "double") else "double"
    own = rows.schema[id_col].dataType.simpleString()

    def digest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            # Adding 0 makes one zero of both.
            names = [None if x is None else xxhash.xxh3_128_digest((x.astype(np.float64) + 0.0).tobytes()) for x in raw(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(names, pa.binary()), batch.column(1)], ["vec_id", "same", "vector"])

    return rows.select(column(rows, id_col).alias("vec_id"), vector.alias("vector")).mapInArrow(digest, f"vec_id {own}, same binary, vector array<{kind}>")


def fitted(classes: DataFrame) -> dict[int, np.ndarray]:
    """Rotations by length of vector, from at most FITTED + 1 vectors of each of the LENGTHS most frequent lengths."""
    length = F.size("vector")
    out = {}
    for r in classes.groupBy(length.alias("length")).count().orderBy(F.desc("count"), "length").limit(LENGTHS).collect():
        own = classes.filter(length == r["length"])
        some = own.filter(F.pmod(F.xxhash64("same"), F.lit(max(1, r["count"] // FITTED))) == 0).limit(FITTED + 1).select("vector").collect()
        if len(some) > 1:
            out[r["length"]] = main_axes(unit_of(np.array([x[0] for x in some], np.float64)))
    return out


def counted(classes: DataFrame, turns: dict[int, np.ndarray], least: float) -> list:
    """length, block, cell, home, n of all cells."""
    shared = classes.sparkSession.sparkContext.broadcast(turns)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches(frames):
            vectors = raw(batch.column(0))
            for length, rows in by_length(vectors).items():
                for block, _, cells, home in places(rotated(unit_of(np.stack([vectors[i] for i in rows]).astype(np.float64)), shared.value), least):
                    for cell, n in zip(*np.unique(cells, return_counts=True), strict=True):
                        key = length, block, int(cell), home
                        found[key] = found.get(key, 0) + int(n)
        cols = list(zip(*[(*k, n) for k, n in found.items()], strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["length", "block", "cell", "home", "n"])

    each = classes.select("vector").mapInArrow(count, "length int, block int, cell long, home boolean, n long")
    return each.groupBy("length", "block", "cell", "home").agg(F.sum("n").alias("n")).collect()


def parts_of(cells: list, tile: int) -> dict[tuple, tuple[int, int]]:
    """Into how many parts a cell's homes and visitors are cut, for cells that have homes; none for visitors that stay with the homes."""
    n: dict[tuple, list[int]] = {}
    for length, block, cell, home, many in cells:
        n.setdefault((length, block, cell), [0, 0])[not home] += many
    out = {}
    for (length, block, cell), (homes, visitors) in n.items():
        most = max(64, tile // (8 * length))
        small = homes + visitors <= most
        if homes:
            out[length, block, cell] = (-(-homes // most), 0 if small else -(-visitors // most))
    return out


POSTED = ["length", "block", "cell", "p", "q", "part", "home", "id", "members", "vector"]


def posted(classes: DataFrame, turns: dict[int, np.ndarray], parts: dict, least: float) -> DataFrame:
    """Each class's vector under every tile (length, block, cell, p, q) in which it is compared; part is p or q."""
    shared = classes.sparkSession.sparkContext.broadcast((turns, parts))
    kind = classes.schema["vector"].dataType.simpleString()

    def post(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, known = shared.value
        for batch in batches(frames, 1 << 19):
            vectors = raw(batch.column(2))
            ids = batch.column(0).to_numpy()
            tiles, rows = [], []
            for length, own in by_length(vectors).items():
                for block, at, cells, home in places(rotated(unit_of(np.stack([vectors[i] for i in own]).astype(np.float64)), axes), least):
                    for k, cell in zip(at.tolist(), cells.tolist(), strict=True):
                        if (length, block, cell) not in known:
                            continue  # visitors only
                        homes, visitors = known[length, block, cell]
                        row = own[k]
                        part = xxhash.xxh64_intdigest(int(ids[row]).to_bytes(8, "little")) >> 3
                        mine = part % homes if home or not visitors else homes + part % visitors
                        others = range(homes + visitors) if mine < homes else range(homes)
                        for other in others:
                            tiles.append((length, block, cell, min(mine, other), max(mine, other), mine, home))
                            rows.append(row)
            if tiles:
                cols = list(zip(*tiles, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([*[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], *taken.columns], POSTED)

    return classes.select("id", "members", "vector").mapInArrow(post, f"length int, block int, cell long, p int, q int, part int, home boolean, id long, members long, vector {kind}")


def rows_and_columns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision a, b whose products a[i] @ b[j] are the squared distances of rows i and j of x."""
    squares, ones = (x * x).sum(axis=1), np.ones(len(x))
    return np.column_stack([x, squares, ones]).astype(np.float32), np.column_stack([-2 * x, ones, squares]).astype(np.float32)


def joined(batch: pa.Table, turns: dict[int, np.ndarray], least: float) -> pa.Table:
    """id, links, least of a tile's vectors: the rows of other classes that each is linked with here, and a class it is joined to."""
    p, q, block = (batch.column(c)[0].as_py() for c in ("p", "q", "block"))
    part, home = batch.column("part").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
    ids, members = batch.column("id").to_numpy(), batch.column("members").to_numpy()
    x = np.concatenate([c.flatten().to_numpy() for c in batch.column("vector").chunks]).reshape(len(ids), -1).astype(np.float64)
    order = np.lexsort((ids, part, ~home))
    part, home, ids, members, unit = part[order], home[order], ids[order], members[order], unit_of(x[order])
    size = unit.shape[1]
    spans, most = cuts(size), budgets(size, least)
    rough, other_rough = rows_and_columns(rotated(unit, turns, spans[block]))
    enough = np.float32(most[block] + SLACK + ROUGH * (rough.shape[1] + 2))

    def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this block is the first that has a pair within budget: the same in every task that compares it."""
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        turned, good = rotated(unit[rows], turns, slice(spans[block].stop)), np.ones(len(a), bool)
        for k in range(block + 1):
            apart = np.ascontiguousarray(turned[at[: len(a)], spans[k]] - turned[at[len(a) :], spans[k]])
            good &= ((apart * apart).sum(axis=1) <= most[k]) == (k == block)
        return good

    left, right = (np.flatnonzero(part == p), np.flatnonzero(part == q))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    some = max(256, (8 << 20) // (8 * size))  # pairs whose vectors are looked at together
    room = np.empty(min(CHUNK, len(left)) * min(CHUNK, len(right)), np.float32)
    for i in range(0, len(left), CHUNK):
        a = left[i : i + CHUNK]
        for j in range(i if p == q else 0, len(right), CHUNK):
            b = right[j : j + CHUNK]
            if not (home[a[0]] or home[b[0]]):
                continue  # visitors only: they meet in a cell where one is at home
            apart = np.matmul(rough[a], other_rough[b].T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            one, other = np.divmod(np.flatnonzero(apart <= enough), len(b))
            one, other = a[one], b[other]
            keep = home[one] | home[other]
            if p == q:
                keep &= one < other
            one, other = one[keep], other[keep]
            for at in range(0, len(one), some):
                o, t = one[at : at + some], other[at : at + some]
                good = np.einsum("ij,ij->i", unit[o], unit[t]) >= least - SLACK
                o, t = o[good], t[good]
                good = (cosine(x[order[o]], x[order[t]]) >= least) & first(o, t)
                o, t = o[good], t[good]
                np.add.at(links, o, members[t])
                np.add.at(links, t, members[o])
                while ((a_root := root[o]) != (b_root := root[t])).any():  # the least row that is joined to each
                    low = np.minimum(a_root, b_root)
                    np.minimum.at(root, a_root, low)
                    np.minimum.at(root, b_root, low)
                    while (root[root] != root).any():
                        root = root[root]
    found = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[found]), "links": pa.array(links[found]), "least": pa.array(ids[root[found]])})


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a with rows of b, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def grouped(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    named = written(digested(rows, id_col, vector_col))
    of = named.filter(F.col("same").isNotNull())
    classes = of.groupBy("same").agg(F.count("*").alias("members"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    turns = fitted(classes)
    parts, shared = parts_of(counted(classes, turns, least), tile), rows.sparkSession.sparkContext.broadcast(turns)
    tiles = posted(classes, turns, parts, least).groupBy("length", "block", "cell", "p", "q")
    found = written(tiles.applyInArrow(lambda batch: joined(batch, shared.value, least), "id long, links long, least long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "id")
    each = classes.drop("vector").join(links, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = written(each.withColumnRenamed("members", "rows"))
    smallest = each.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    own = F.col("rows") - 1 + F.coalesce("links", F.lit(0))
    of_class = written(met(each, smallest, "component", "same").select("same", F.col("rows").alias("members"), own.alias("n_links"), "component_id"))
    out = met(of.select("vec_id", "same"), of_class, "same", "vec_id").select("vec_id", "n_links", "component_id")
    alone = named.filter(F.col("same").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_subspace_join": op11_subspace_join}
#: All pairs, which is for small tables.
ORACLES = {
    "op11_subspace_join": """with recursive v as (select vec_id, embedding::double[] as e, len(embedding) as n from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.n = b.n and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
  r as (select vec_id as x, vec_id as y from embeddings union select r.x, l.b from r join l on r.y = l.a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings left join (select a as vec_id, count(*) as n_links from l group by a) using (vec_id) join (select x as vec_id, min(y) as component_id from r group by x) using (vec_id)""",
}
