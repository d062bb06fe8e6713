"""Joins beyond equality: interval, range and as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators import prefix


def hash_join(left: DataFrame, right: DataFrame, on: list[str], arrival: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of equal keys; with `arrival`, only pairs whose left row came first."""
    out = left.join(right, on)
    return out.where(F.col(arrival[0]) < F.col(arrival[1])) if arrival else out


def evict(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't among `keys`."""
    return state.join(keys.select(*on).distinct(), on, "left_anti")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, within: float) -> DataFrame:
    """Pairs of equal keys whose times (seconds as numbers) differ by `within` at most.

    Both sides go to bins of that width; the left rows to three of them. So the
    join is one of equality on (key, bin), and a key with very many rows is
    spread over its bins.
    """
    l = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(left_ts) / within) + d for d in (-1, 0, 1)])))
    r = right.withColumn("_bin", F.floor(F.col(right_ts) / within))
    return l.join(r, [*on, "_bin"]).where(F.abs(F.col(left_ts) - F.col(right_ts)) <= within).drop("_bin")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high) of ranges, by bins of `width`."""
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(r, "_bin").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time: one window over both sides, no pairs."""
    l = left.withColumns({"_t": F.col(left_ts), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_side = 1").drop("_t", "_side", "_v")


def nearest(points: DataFrame, centres: DataFrame, distance: Column, block: int = 10_000) -> DataFrame:
    """(id, centre, distance) of the nearest centre of each point, ties to the least number.

    Centres are broadcast a block of consecutive numbers at a time, each against
    all points, and the blocks' nearest are compared. Without a centre there is
    no row.
    """
    n = centres.count()
    if n > block:
        numbered = prefix.numbered(centres, [F.col("centre")], "_c")
        parts = [numbered.where(F.col("_c").between(a, a + block - 1)).drop("_c") for a in range(0, n, block)]
    else:
        parts = [centres]
    best = F.min(F.struct("distance", "centre")).alias("b")
    found = [points.crossJoin(F.broadcast(c)).withColumn("distance", distance).groupBy("id").agg(best).select("id", "b.*") for c in parts]
    pairs = reduce(DataFrame.union, found)
    if len(found) > 1:
        pairs = pairs.groupBy("id").agg(best).select("id", "b.*")
    return pairs.select("id", "centre", "distance")
