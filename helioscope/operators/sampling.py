"""Splits, batches and resampling by hashes of a key: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) by key and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key), F.lit(1 << 52)) / float(1 << 52)


def train_test_split(df: DataFrame, key: str, test: float, seed: int) -> tuple[DataFrame, DataFrame]:
    u = unit(key, seed)
    return df.where(u >= test), df.where(u < test)


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.withColumn("fold", F.floor(unit(key, seed) * k).cast("int"))


def batches(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """Numbered batches of about `rows` rows, in a random but fixed order."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn("batch", F.floor(unit(key, seed) * n).cast("int"))


def bootstrap_means(df: DataFrame, value: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean, n): each row counts a Poisson number of times in each replicate (the large-table bootstrap), in one pass."""
    r = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    x = df.select(key, value, r)
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", key), F.lit(1 << 52)) / float(1 << 52)
    weight, total, mass = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):  # inverse of the Poisson distribution function
        total += mass
        weight = weight + F.when(u >= total, 1).otherwise(0)
        mass /= k + 1
    x = x.withColumn("w", weight)
    return x.groupBy("replicate").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("n"))


def stratified(df: DataFrame, key: str, by: str, fractions: dict, seed: int) -> DataFrame:
    keep = F.lit(False)
    for level, share in fractions.items():
        keep = keep | (F.col(by).eqNullSafe(F.lit(level)) & (unit(key, seed) < share))
    return df.where(keep)
