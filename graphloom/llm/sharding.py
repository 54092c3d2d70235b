"""Reproducible global shuffle into shards: a keyed Feistel permutation over global row numbers.

The permutation works on the smallest even-bit domain that holds all row numbers. A value that
falls outside the rows is permuted again until it lands inside (cycle walking), so the result is
a bijection of 0..n-1 without any sort by a random key. Position p goes to shard p mod shards, at
slot p div shards: any reader can compute both from a row number alone, and shard counts differ by
one at most (law "rows").

Defined cases: a null text has size 8 and the CRC of the empty string; null ids come first in the
numbering; repeated rows get different numbers, and so different places; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, numbered

ROUNDS = 6
SEED = 20240131


def _mixed(half: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit mix of one half and a round key (unsigned arithmetic wraps)."""
    x = (half ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(rows: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each row number (0..n-1) under the keyed permutation of 0..n-1."""
    bits = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, rounds, dtype=np.uint64)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def with_places(df: DataFrame, n: int, shards: int, row: str = "row_number", seed: int = SEED) -> DataFrame:
    """df with the columns position, shard and slot computed from its global row numbers."""

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permuted(rows.to_numpy(), n, seed))

    out = df.withColumn("position", position(row))
    return out.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / F.lit(shards)).cast("long")})


def shards_of(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, position, shard, slot of every row. Texts are read, but not shuffled."""
    body = F.coalesce(column(docs, text_col), F.lit("")).cast("binary")
    narrow = docs.select(column(docs, id_col).alias("doc_id"), (F.length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    rows = numbered(narrow, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    return with_places(rows, rows.count(), shards, seed=seed)


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards_of(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position")


QUERIES = {"op2_feistel_shards": op2_feistel_shards}
ORACLES: dict[str, str] = {}
