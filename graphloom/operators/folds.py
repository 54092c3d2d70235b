"""Folds over the ordered rows of each group, a row at a time: no array or string grows with a group.

Rows are dealt by group and sorted, which spills; a task carries one state from row to row and from batch
to batch. A hash of bytes in order can't be cut into parts, so a group's hash is one task's work, of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_hash(rows: DataFrame, key: Column, order: Column, part: Column, head: Column, separator: str, tail: str) -> DataFrame:
    """key, hash: the SHA-256 of head, the group's parts in order with a separator between, and tail.

    Null parts are left out; without a part or a head a group's hash is null. head depends on the key only.
    """

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, state, parts, between = False, None, None, 0, separator.encode()

        def ended() -> pa.RecordBatch:
            if state and parts:
                state.update(tail.encode())
            return pa.record_batch([pa.array([key], pa.string()), pa.array([state.hexdigest() if state and parts else None], pa.string())], ["key", "hash"])

        for batch in frames:
            for k, first, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                k, first, x = k.as_py(), first.as_py(), x.as_py()
                if not begun or k != key:
                    if begun:
                        yield ended()
                    begun, key, parts, state = True, k, 0, None if first is None else hashlib.sha256(first.encode())
                if x is not None:
                    if state:
                        state.update(between + x.encode() if parts else x.encode())
                    parts += 1
        if begun:
            yield ended()

    named = rows.select(key.cast("string").alias("key"), order.alias("order"), part.alias("part"))
    ordered = named.repartition("key").sortWithinPartitions("key", "order", "part")
    return ordered.select("key", head.alias("head"), "part").mapInArrow(fold, "key string, hash string")


def allocated(rows: DataFrame, key: str, order: str, size: Column, total: int) -> DataFrame:
    """key, order, allocated: what each row of a group gets from its budget, as answers.allocated() gives it."""

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, left = False, None, 0
        for batch in frames:
            got = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != at:
                    begun, at, left = True, k, total
                fits = n is not None and n <= left
                got.append(n if fits else 0)
                left -= got[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, pa.int64())], [key, order, "allocated"])

    named = rows.select(key, order, size.cast("long").alias("_size"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    return named.repartition(key).sortWithinPartitions(key, order, "_size").mapInArrow(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, allocated long")
