"""Packed token ids as rows of a binary matrix.

Each task takes its documents in windows of a bounded number of tokens, cuts those over the
capacity losslessly, and packs a window best-fit decreasing: pieces go by falling length into the
open row with the least room that holds them, found in a segment tree over amounts of room. Nothing
is shuffled, a task holds one window, and a task that runs again writes the same rows.

A row has `capacity` little-endian unsigned 32-bit ids padded with the end id; cumulative segment
lengths (0 first), of which the last is where padding begins; and the position of each id within
its segment as little-endian unsigned 32-bit numbers, which start again at 0 with every segment.

Defined cases: a null text is empty and has just the end id; repeated rows are packed each; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, documents, written
from .tokens import END, VOCABULARY, cuts, document_ids

CAPACITY = 2048
#: Sequences' worth of tokens that a task packs at a time.
WINDOW = 1024


class Rooms:
    """A segment tree over amounts of room 0..capacity: how many open rows have each, and who they are."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least `need`, and that room; None if there is none."""
        at, count = self.size + need, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers, each within the capacity, best-fit decreasing."""
    rooms, rows = Rooms(capacity), []
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        found = rooms.take(need)
        if found is None:
            rows.append([int(k)])
            rooms.put(capacity - need, len(rows) - 1)
        else:
            rows[found[0]].append(int(k))
            rooms.put(found[1] - need, found[0])
    return rows


NAMES = ["sequence_id", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"]


def matrix(docs: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """sequence_id, input_ids, cu_seqlens, position_ids and, for each segment, doc_ids, pieces and starts."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        ids: list = []
        facts: list = []
        waiting = 0
        positions = np.arange(capacity, dtype="<u4")

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = best_fit(np.array([f[3] for f in facts], np.int64), capacity)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                cells: list[list] = [[] for _ in range(3)]
                for row in some:
                    body = b"".join(ids[k] for k in row)
                    cells[0].append(body + END.to_bytes(4, "little") * (capacity - len(body) // 4))
                    ends = np.cumsum([0] + [facts[k][3] for k in row])
                    cells[1].append(ends.astype(np.int32))
                    pos = positions.copy()
                    for a, b in zip(ends, [*ends[1:], capacity], strict=True):
                        pos[a:b] = positions[: b - a]
                    cells[2].append(pos.tobytes())
                numbers = pa.array(np.arange(base + made, base + made + len(some)))
                made += len(some)
                each = [pa.array([[facts[k][i] for k in row] for row in some], pa.list_(t)) for i, t in ((0, kind), (1, pa.int32()), (2, pa.int64()))]
                yield pa.record_batch([numbers, pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.list_(pa.int32())), pa.array(cells[2], pa.binary()), *each], NAMES)

        kind = pa.int64()
        for batch in batches(frames):
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = document_ids(text.as_py(), vocabulary)
                for k, (start, length) in enumerate(cuts(len(body) // 4, capacity)):
                    ids.append(body[4 * start : 4 * (start + length)])
                    facts.append((doc, k, start, length))
                    waiting += length
                    if waiting >= window * capacity:
                        yield from flush(kind)
                        ids, facts, waiting = [], [], 0
        if facts:
            yield from flush(kind)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, pieces array<int>, starts array<long>"
    return docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text")).mapInArrow(pack, schema)


def segments(rows: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each segment, read from the binary rows."""
    each = rows.select("sequence_id", "input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("k", "s"))
    at, end = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    crc = F.crc32(F.substring(F.col("input_ids"), at * 4 + 1, (end - at) * 4))
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"), (end - at).cast("long").alias("length"), crc.alias("ids_crc32"), "sequence_id", at.cast("long").alias("offset"))


def op10_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrix to the shared folder and returns what its rows hold, segment by segment."""
    return segments(written(matrix(documents(spark, sf_dir))))


QUERIES = {"op10_packed_matrix": op10_packed_matrix}
ORACLES: dict[str, str] = {}
