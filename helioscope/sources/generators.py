"""Made datasets: formulas of a row number, so any number of tasks make the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(i: Column, seed: int, k: int) -> Column:
    """Number k of row i, in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(i: Column, seed: int, k: int) -> Column:
    """By Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(i, seed, 2 * k))) * F.cos(2 * math.pi * uniform(i, seed, 2 * k + 1))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x, y, label): two half circles, even and odd rows."""
    i = F.col("id")
    odd, t = i % 2 == 1, math.pi * F.floor(i / 2) / max((n + 1) // 2 - 1, 1)
    x, y = F.when(odd, 1 - F.cos(t)).otherwise(F.cos(t)), F.when(odd, 0.5 - F.sin(t)).otherwise(F.sin(t))
    return _rows(spark, n).select("id", (x + noise * normal(i, seed, 0)).alias("x"), (y + noise * normal(i, seed, 1)).alias("y"), (i % 2).cast("int").alias("label"))


def make_circles(spark: SparkSession, n: int, factor: float = 0.5, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x, y, label): an outer circle and an inner one."""
    i = F.col("id")
    r, t = F.when(i % 2 == 1, factor).otherwise(1.0), 2 * math.pi * F.floor(i / 2) / max((n + 1) // 2, 1)
    return _rows(spark, n).select("id", (r * F.cos(t) + noise * normal(i, seed, 0)).alias("x"), (r * F.sin(t) + noise * normal(i, seed, 1)).alias("y"), (i % 2).cast("int").alias("label"))


def make_spirals(spark: SparkSession, n: int, turns: float = 2.0) -> DataFrame:
    """(id, x, y, label): two spirals, the second turned by half a circle."""
    i = F.col("id")
    s = F.floor(i / 2) / max(n // 2, 1)
    a = 2 * math.pi * turns * s + math.pi * (i % 2)
    return _rows(spark, n).select("id", (s * F.cos(a)).alias("x"), (s * F.sin(a)).alias("y"), (i % 2).cast("int").alias("label"))


def make_swiss_roll(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    i = F.col("id")
    t = 1.5 * math.pi * (1 + 2 * uniform(i, seed, 0))
    return _rows(spark, n).select("id", (t * F.cos(t)).alias("x"), (21 * uniform(i, seed, 1)).alias("y"), (t * F.sin(t)).alias("z"), t.alias("t"))


def make_s_curve(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    i = F.col("id")
    t = 3 * math.pi * (uniform(i, seed, 0) - 0.5)
    return _rows(spark, n).select("id", F.sin(t).alias("x"), (2 * uniform(i, seed, 1)).alias("y"), (F.signum(t) * (F.cos(t) - 1)).alias("z"), t.alias("t"))


def make_blobs(spark: SparkSession, n: int, centres: int, features: int, sd: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x array, label): normal clouds about centres in a cube of side 20."""
    i = F.col("id")
    label = i % centres
    x = F.array(*[20 * uniform(label, seed + 1, k) - 10 + sd * normal(i, seed, k) for k in range(features)])
    return _rows(spark, n).select("id", x.alias("x"), label.cast("int").alias("label"))


def make_regression(spark: SparkSession, n: int, features: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x array, y): y is a sum of the features by weights 1, 2, ... and noise."""
    i = F.col("id")
    x = [normal(i, seed, k) for k in range(features)]
    y = sum((w * v for w, v in enumerate(x[1:], 2)), x[0]) + noise * normal(i, seed, features)
    return _rows(spark, n).select("id", F.array(*x).alias("x"), y.alias("y"))


def make_classification(spark: SparkSession, n: int, features: int, flip: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x array, label): the sign of the features' sum, flipped in a share of rows."""
    r = make_regression(spark, n, features, 0.0, seed)
    s = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) > 0
    return r.select("id", "x", F.when(uniform(F.col("id"), seed, 99) < flip, ~s).otherwise(s).cast("int").alias("label"))
