"""Best-fit packing by a configuration linear program over the length histogram.

All that the program needs of the documents is how many pieces have each length, so it has at most
`capacity` rows however many documents there are, and is solved on the driver. Its variables are
configurations: multisets of lengths that fit one sequence. Multiplicative weights price the
lengths; each round a knapsack dynamic program finds the dearest configurations at these prices,
which are taken in small amounts while the prices of what they cover fall, until every length is
covered. Each round's prices also give a lower bound on any packing (they are a dual solution once divided by
the dearest configuration's value), so the gap of the result is known. The fractional solution
is rounded down to whole sequences within the counts, and the rest is packed best-fit decreasing,
again by counts. Pieces then get their places by rank within their length.

Defined cases: a null text is empty and has just the end id; texts over the capacity are cut, the
first piece being the short one; repeated rows are packed each; no rows give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, batches, column, documents, numbered, written
from .tokens import VOCABULARY, cuts, document_ids, encoder

CAPACITY = 2048
#: Rounds end when all is covered; what is left after so many goes to the best fit that follows.
ROUNDS = 400
EPSILON = 0.1


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, position: Column | None = None, mark: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row, and the row's position (a long) and mark (a string) if they are given."""
    kind = docs.schema[id_col].dataType.simpleString()
    place, name = F.lit(0).cast("long") if position is None else position, F.lit("") if mark is None else mark

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("tokens", encoder.cache_clear)
        for batch in batches(frames):
            at, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(document_ids(text.as_py(), vocabulary))
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    at.append(row)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            rows = pa.array(at, pa.int64())
            piece, start, length, crc = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.record_batch([batch.column(0).take(rows), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), batch.column(2).take(rows), batch.column(3).take(rows)], ["doc_id", "piece", "start", "length", "ids_crc32", "position", "mark"])
        pa.default_memory_pool().release_unused()  # workers live on

    out = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), place.alias("position"), name.alias("mark")).mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, position long, mark string")
    return out.drop(*(["position"] if position is None else []), *(["mark"] if mark is None else []))


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: the best value in each room 0..capacity, and the last length put in (0: a unit of waste)."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := fits[room]:
            with_it = prices[:n] + value[room - lengths[:n]]
            k = int(with_it.argmax())
            if with_it[k] > value[room]:
                value[room], last[room] = with_it[k], lengths[k]
    return value, last


def fractional(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, eps: float = EPSILON) -> tuple[dict[tuple[int, ...], float], float]:
    """Amounts of configurations that cover the counts, by multiplicative weights with knapsack pricing, and a lower bound on their sum."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(x)] for x in lengths], float)
    where = {int(x): i for i, x in enumerate(lengths)}
    covered, out, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(rounds):
        # A length's price falls with its covered share; a unit of length starts at the same price everywhere.
        open_ = covered < need
        if not open_.any():
            break
        prices = lengths / capacity * np.exp(-covered / need / eps * np.log1p(eps)) * open_
        value, last = dearest(prices, lengths, capacity)
        bound = max(bound, float(prices @ need) / value[capacity])
        worth = prices + value[capacity - lengths]
        for first in np.argsort(-worth, kind="stable"):
            if worth[first] < (1 - eps) * value[capacity]:
                break
            if covered[first] >= need[first]:
                continue
            config, room = [int(lengths[first])], capacity - int(lengths[first])
            while room > 0:
                if last[room]:
                    config.append(int(last[room]))
                    room -= int(last[room])
                else:
                    room -= 1
            config = tuple(sorted(config, reverse=True))
            used = {x: config.count(x) for x in set(config)}
            amount = min((need[where[x]] - min(covered[where[x]], need[where[x]])) / n for x, n in used.items())
            amount = min(amount, eps * 4 * max(need[where[x]] / n for x, n in used.items()))
            if amount > 0:
                out[config] = out.get(config, 0.0) + amount
                for x, n in used.items():
                    covered[where[x]] += n * amount
    return out, bound


def gap(counts: dict[int, int], plan: list[tuple[tuple[int, ...], int]], bound: float, capacity: int) -> float:
    """By how much of the least possible number of sequences a plan may be above it."""
    least = max(1.0, np.ceil(bound - 1e-6), np.ceil(sum(k * n for k, n in counts.items()) / capacity))
    return sum(n for _, n in plan) / least - 1


def rounded(counts: dict[int, int], amounts: dict[tuple[int, ...], float], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences of each configuration that hold exactly the counts."""
    left, out = dict(counts), []
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        n = min(int(amount), *(left[x] // config.count(x) for x in set(config)))
        if n > 0:
            out.append((config, n))
            for x in config:
                left[x] -= n
    # Best-fit decreasing over counts: open groups of like sequences by the room they have left.
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(config: tuple[int, ...], n: int) -> None:
        room = capacity - sum(config)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((config, n))

    for config, n in out:
        put(config, n)
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[at]
            config, m = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = min(room // length, n)
            take = min(m, n // each)
            if take < m:
                put(config, m - take)
            put(config + (length,) * each, take)
            n -= take * each
    return sorted((x for group in groups.values() for x in group), key=lambda x: (tuple(-y for y in x[0]), x[1]))


def runs_of(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, per sequence, first sequence, offset), sorted: where each piece of a length goes."""
    rows, used, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length in sorted(set(config), reverse=True):
            each = config.count(length)
            rows.append((length, used.get(length, 0), each * n, each, sequence, offset))
            used[length] = used.get(length, 0) + each * n
            offset += each * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; pieces of one length fill their places in the given order.

    The runs that are sent to the tasks number at most a few for each configuration, and
    configurations at most ROUNDS + 2 for each length up to the capacity, whatever the data's size.
    """
    pieces = written(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    amounts, _ = fractional(counts, capacity)
    runs = runs_of(rounded(counts, amounts, capacity))
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    shared = pieces.sparkSession.sparkContext.broadcast((runs, np.array([before.get(x, 0) for x in range(capacity + 1)], np.int64)))
    ranked = numbered(pieces, F.col("length"), *map(F.col, order))
    kind = "sequence_id long, offset long"

    @F.pandas_udf(kind)
    def place(length: pd.Series, row: pd.Series) -> pd.DataFrame:
        table, starts = shared.value
        n = length.to_numpy()
        rank = row.to_numpy() - starts[n]
        at = np.searchsorted(table[:, 0] * (1 << 44) + table[:, 1], n * (1 << 44) + rank, side="right") - 1
        run = table[at]
        k = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + k // run[:, 3], "offset": run[:, 5] + k % run[:, 3] * n})

    return ranked.withColumn("_place", place("length", "row_number")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def op4_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces_of(documents(spark, sf_dir)))


QUERIES = {"op4_configuration_packing": op4_configuration_packing}
ORACLES: dict[str, str] = {}
