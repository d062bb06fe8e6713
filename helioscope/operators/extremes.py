"""Exceedances, ramps, peaks and daily sums of ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exceedances(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Rows above the threshold, with their excess."""
    return df.where(F.col(value) > threshold).withColumn("excess", F.col(value) - threshold)


def mean_residual_life(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, mean_excess, standard_error) of each threshold, in one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    e = df.select(value, t).where(F.col(value) > F.col("threshold")).withColumn("e", F.col(value) - F.col("threshold"))
    return e.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_excess"), F.sqrt(F.var_pop("e") / F.count(F.lit(1))).alias("standard_error"))


def peaks(df: DataFrame, value: str, q: float, by: list[str] = ()) -> DataFrame:
    """Rows whose value is at least the nearest-rank quantile: the one of rank round(q * (n - 1)), from zero. Values are ranked as (value, count) first, so no row meets in one task."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"_upto": F.sum("_c").over(run), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    at = c.where(F.col("_upto") > F.round(q * (F.col("_n") - 1))).groupBy(*by).agg(F.min(value).alias("level"))
    joined = df.join(at, by) if by else df.crossJoin(F.broadcast(at))
    return joined.where(F.col(value) >= F.col("level"))


def ramps(df: DataFrame, value: str, threshold: float, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """(run, up, steps, change): stretches of steps of one direction (a flat step counts as up) whose change is at least the threshold."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    s = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).where(F.col("_d").isNotNull()).withColumn("up", F.col("_d") >= 0)
    s = s.withColumn("_new", F.when(F.col("up") == F.lag("up").over(w), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*by, "run", "up").agg(F.count(F.lit(1)).alias("steps"), F.sum("_d").alias("change")).where(F.abs("change") >= threshold)


def blocks(df: DataFrame, value: str, size: int, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """(block, total, mean, n) of each full block of `size` rows (hourly to daily: 24); what is left over at the end is dropped."""
    block = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)) - 1) / size)
    return df.withColumn("block", block).groupBy(*by, "block").agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)


def coverage(df: DataFrame, truth: str, low: str, high: str, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Running share of rows whose truth lies within [low, high]."""
    hit = F.when(F.col(truth).between(F.col(low), F.col(high)), 1.0).otherwise(0.0)
    return df.withColumn("coverage", F.avg(hit).over(Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)))


def anomalies(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), size: int = 1000, least: int = 10, limit: float = 3.0) -> DataFrame:
    """z-score in the last `size` rows, this one included; null for fewer than `least`, and a flag where it is over the limit."""
    w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(1 - size, 0)
    z = F.when(F.count(value).over(w) >= least, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))
    return df.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))
