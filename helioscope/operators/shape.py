"""Trend, crossing and peak features of ordered signals, one for each key.

Rows are numbered over the whole table in the order of key and place, and meet
their neighbours in blocks of consecutive numbers, so that a long signal is cut
as all others are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators import prefix

#: Rows of a block of consecutive numbers.
BLOCK = 1 << 16


def neighbours(df: DataFrame, number: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """df with _prev and _next, structs of the columns of the rows numbered one less and one more; numbers are distinct and gapless.

    A block's first and last rows are copied to the blocks beside it; windows
    are over blocks, which hold block + 2 rows at most.
    """
    r = F.col(number)
    own = F.floor(r / block).cast("bigint")
    spots = F.array_compact(F.array(own, F.when(r % block == 0, own - 1), F.when(r % block == block - 1, own + 1)))
    w = Window.partitionBy("_b").orderBy(number)
    x = df.withColumn("_b", F.explode(spots)).withColumns({"_prev": F.lag(F.struct(*columns)).over(w), "_next": F.lead(F.struct(*columns)).over(w)})
    return x.where(F.col("_b") == own).drop("_b")


def signal_features(df: DataFrame, value: str, order_by: list[str], by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, n, trend, crossings, peaks) of each key's values in the order of order_by, ties in the order of the values.

    Null values are left out; a null key is a key. The trend is fitted over the
    places 0, 1, ...; non_linearity is the share of what the line leaves that a
    parabola explains. A crossing of zero or of the mean is a step from below
    to not below, or back. Peaks and troughs are strictly above or below both
    neighbours, or at an end the only one. What isn't defined is null: the
    trend of one value, r_squared of a constant, the ratio without a trough,
    distances of fewer than two peaks and their deviation of fewer than three,
    the crest factor of zeros. Of an empty table there is no row.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    ways = [f"_o{i}" for i in range(len(order_by))]
    x = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), *(F.col(c).alias(k) for c, k in zip(order_by, ways)), F.col(value).cast("double").alias("_v"))
    x = prefix.numbered(x, [F.col(c) for c in (*keys, *ways, "_v")], "_r").select(F.struct(*keys).alias("_k"), "_r", "_v")
    x = neighbours(x, "_r", ["_k", "_v"], block)
    same = lambda side: F.when(F.col(f"{side}._k").eqNullSafe(F.col("_k")), F.col(f"{side}._v"))
    x = x.withColumns({"_p": same("_prev"), "_q": same("_next")}).drop("_prev", "_next")
    whole = x.groupBy(F.col("_k").alias("_h")).agg(F.min("_r").alias("_start"), F.count(F.lit(1)).alias("n"), F.avg("_v").alias("_mean"))
    x = x.join(whole, F.col("_k").eqNullSafe(F.col("_h"))).drop("_h").withColumn("_i", F.col("_r") - F.col("_start"))
    v, p, q, mean = F.col("_v"), F.col("_p"), F.col("_q"), F.col("_mean")
    ends = p.isNotNull() | q.isNotNull()
    top = ends & F.coalesce(v > p, F.lit(True)) & F.coalesce(v > q, F.lit(True))
    low = ends & F.coalesce(v < p, F.lit(True)) & F.coalesce(v < q, F.lit(True))
    z = F.col("_i") - (F.col("n") - 1) / 2
    crossed = lambda level: F.sum(F.when(p.isNotNull() & ((v >= level) != (p >= level)), 1).otherwise(0)).alias
    g = x.groupBy("_k").agg(
        F.first("n").cast("double").alias("n"), F.first("_mean").alias("mean"), F.sum((v - mean) * (v - mean)).alias("yy"), F.sum(z * (v - mean)).alias("zy"), F.sum(z * z * (v - mean)).alias("zzy"),
        crossed(F.lit(0.0))("zero"), crossed(mean)("middle"), F.sum(top.cast("bigint")).alias("peaks"), F.sum(low.cast("bigint")).alias("troughs"),
        (F.max("_v") - F.min("_v")).alias("range"), F.max(F.abs("_v")).alias("most"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(F.when(top, F.col("_i"))).alias("first"), F.max(F.when(top, F.col("_i"))).alias("last"),
    )
    steps = prefix.lagged(x.where(top).select("_k", "_r"), ["_k", "_r"], "_r", "_l").where(F.col("_l_k").eqNullSafe(F.col("_k")))
    steps = steps.groupBy(F.col("_k").alias("_h")).agg(F.stddev_pop(F.col("_r") - F.col("_l_r")).alias("unrest"), F.count(F.lit(1)).alias("_steps"))
    g = g.join(steps, F.col("_k").eqNullSafe(F.col("_h")), "left")
    n = F.col("n")
    zz = n * (n * n - 1) / 12
    bend = n * (n * n - 1) * (3 * n * n - 7) / 240 - zz * zz / n  # of z * z less its mean, which is orthogonal to the line
    slope = F.when(n > 1, F.col("zy") / F.nullif(zz, F.lit(0.0)))
    left = F.greatest(F.col("yy") - F.col("zy") * F.col("zy") / F.nullif(zz, F.lit(0.0)), F.lit(0.0))
    straight = left <= F.lit(1e-12) * F.col("yy")
    share = F.col("zzy") * F.col("zzy") / F.nullif(bend, F.lit(0.0)) / F.nullif(left, F.lit(0.0))
    return g.select(
        *(F.col("_k")[k].alias(c) for k, c in zip(keys, by)), n.cast("bigint").alias("n"), slope.alias("trend_slope"), (F.col("mean") - slope * (n - 1) / 2).alias("trend_intercept"),
        F.when(F.col("yy") > 0, 1 - left / F.nullif(F.col("yy"), F.lit(0.0))).alias("trend_r_squared"), F.when(n > 1, F.sqrt(left / n)).alias("trend_residual_std"),
        F.when(F.col("yy") > 0, F.when(straight, F.lit(0.0)).otherwise(F.least(share, F.lit(1.0)))).alias("non_linearity"),
        F.col("zero").alias("zero_crossings"), (F.col("zero") / n).alias("zero_crossing_rate"), F.col("middle").alias("mean_crossings"), (F.col("middle") / n).alias("mean_crossing_rate"),
        F.col("peaks").alias("num_peaks"), F.col("troughs").alias("num_troughs"), (F.col("peaks") / F.nullif(F.col("troughs"), F.lit(0))).alias("peak_trough_ratio"), F.col("range").alias("peak_to_peak"), (F.col("peaks") / n).alias("peak_density"),
        F.when(F.col("peaks") > 1, (F.col("last") - F.col("first")) / F.nullif(F.col("peaks") - 1, F.lit(0))).alias("mean_peak_distance"), F.when(F.col("_steps") > 1, F.col("unrest")).alias("peak_distance_std"),
        (F.col("most") / F.nullif(F.col("rms"), F.lit(0.0))).alias("crest_factor"),
    )
