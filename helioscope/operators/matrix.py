"""Sparse matrices as coordinate tables (i, j, v), and signals as tables (i, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a x b; zero sums stay out."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v")).where("v <> 0")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    both = a.select("i", "j", (F.col("v") * alpha).alias("v")).union(b.select("i", "j", (F.col("v") * beta).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def coalesce(a: DataFrame) -> DataFrame:
    """Repeated cells summed."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def norms(a: DataFrame) -> DataFrame:
    """Frobenius, greatest column sum, greatest row sum."""
    c = a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_1"))
    r = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_inf"))
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius")).crossJoin(c).crossJoin(r)


def summary(a: DataFrame) -> DataFrame:
    """nnz, rows, columns, density over the bounding shape."""
    rows, cols = F.max("i") + 1, F.max("j") + 1
    return a.agg(F.count(F.lit(1)).alias("nnz"), rows.alias("rows"), cols.alias("cols"), (F.count(F.lit(1)) / (rows * cols)).alias("density"))


def fir(df: DataFrame, value: str, taps: list[float], order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Causal filter; rows before the first count as zero."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    out = F.lit(0.0)
    for k, t in enumerate(taps):
        out = out + t * (F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) if k else F.col(value))
    return df.withColumn("filtered", out)


def trapezoid(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Integral of y over x."""
    w = Window.partitionBy(*by).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(*by, area.alias("_a")).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


def dft(df: DataFrame, at: str, value: str, n: int, frequencies: list[int], by: list[str] = ()) -> DataFrame:
    """(k, re, im, power) of chosen frequencies of n equally spaced samples: one aggregate for all of them."""
    k = F.explode(F.array(*[F.lit(f) for f in frequencies])).alias("k")
    angle = -2 * math.pi * F.col("k") * F.col(at) / n
    x = df.select(*by, at, value, k).groupBy(*by, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))
    return x.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def autocorrelation(df: DataFrame, value: str, lags: list[int], order_by: list[str], by: list[str] = ()) -> DataFrame:
    """(lag, acf) with the whole series' mean and variance."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    m = Window.partitionBy(*by)
    c = df.withColumn("_c", F.col(value) - F.avg(value).over(m))
    c = c.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in lags})
    den = F.sum(F.col("_c") * F.col("_c"))
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias("num")) for k in lags])
    return c.groupBy(*by).agg(cells.alias("x"), den.alias("den")).select(*by, F.explode("x").alias("x"), "den").select(*by, F.col("x.lag").alias("lag"), F.try_divide(F.col("x.num"), F.col("den")).alias("acf"))


def decompose(df: DataFrame, value: str, period: int, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Additive: trend by a centred moving average (ends null), seasonal means of what is left, centred, and the remainder."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    half = period // 2
    n = F.row_number().over(w)
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    if period % 2:
        trend = F.avg(value).over(w.rowsBetween(-half, half))
    else:
        trend = (F.sum(value).over(w.rowsBetween(-half, half - 1)) + F.sum(value).over(w.rowsBetween(1 - half, half))) / (2 * period)
    x = df.withColumns({"_n": n, "_t": total}).withColumn("trend", F.when((F.col("_n") > half) & (F.col("_n") <= F.col("_t") - half), trend))
    x = x.withColumn("_phase", (F.col("_n") - 1) % period)
    s = x.groupBy(*by, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    s = s.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy(*by))).drop("_s")
    x = x.join(s, [*by, "_phase"])
    return x.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_n", "_t", "_phase")
