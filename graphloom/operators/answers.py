"""Cached answers and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(created_at: Column, now: Column, ttl_days: int) -> Column:
    """Whether an answer is still good; without a time to live it always is."""
    return F.lit(True) if ttl_days <= 0 else (now.cast("long") - created_at.cast("long")) <= ttl_days * 86400


def looked_up(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """requests(key) with hit: whether a live answer with the key is there."""
    good = cache.filter(live(F.col("created_at"), now, ttl_days)).select("key").distinct().withColumn("hit", F.lit(True))
    return requests.join(good, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cleaned(cache: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """The cache without expired answers; untouched without a time to live."""
    return cache.filter(live(F.col("created_at"), now, ttl_days))


def hit_rate(lookups: DataFrame) -> DataFrame:
    counts = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    all_ = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_rate", F.round(F.when(all_ == 0, 0.0).otherwise(F.col("hits") / F.nullif(all_, F.lit(0))), 6))


def allocated(sizes: Column, total: int) -> Column:
    """What each of an ordered array of sizes gets from a budget: all of it if it fits in what is left, else 0, and on to the next."""
    return F.aggregate(
        sizes,
        F.struct(F.lit(total).cast("long").alias("left"), F.expr("cast(array() as array<bigint>)").alias("got")),
        lambda s, n: F.struct(
            (s["left"] - F.when(n <= s["left"], n).otherwise(0)).alias("left"),
            F.concat(s["got"], F.array(F.when(n <= s["left"], n).otherwise(0).cast("long"))).alias("got"),
        ),
        lambda s: s["got"],
    )


def stored(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with answers put in place of those with their keys."""
    return cache.join(answers.select("key").distinct(), "key", "left_anti").unionByName(answers)


def deleted(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the answers to keys(key)."""
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def cleared(cache: DataFrame, operation: str = "") -> DataFrame:
    """The cache without the answers of one operation, or without any."""
    return cache.filter(F.col("operation") != operation) if operation else cache.filter(F.lit(False))
