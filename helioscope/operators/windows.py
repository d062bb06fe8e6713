"""Ordered operators: every one takes what orders its rows and, optionally, what parts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators.prefix import running


def ordered(order_by: list[str], by: list[str] = ()):
    return Window.partitionBy(*by).orderBy(*order_by)


def lags(df: DataFrame, value: str, steps: list[int], order_by: list[str], by: list[str] = (), fill: float | None = 0.0) -> DataFrame:
    """Columns lag_k; where there is no row, `fill`."""
    w = ordered(order_by, by)
    return df.withColumns({f"lag_{k}": F.coalesce(F.lag(value, k).over(w), F.lit(fill)) if fill is not None else F.lag(value, k).over(w) for k in steps})


def rolling(df: DataFrame, value: str, size: int, order_by: list[str], by: list[str] = (), agg=F.avg, name: str = "rolling") -> DataFrame:
    """agg over the last `size` rows; null in the first size - 1."""
    w = ordered(order_by, by)
    own = w.rowsBetween(1 - size, 0)
    return df.withColumn(name, F.when(F.row_number().over(w) >= size, agg(value).over(own)))


def cumulative(df: DataFrame, value: str, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """cumsum, cummax, cummin, cumprod (of positive values) and diff."""
    w = ordered(order_by, by)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    return df.withColumns({"cumsum": F.sum(v).over(run), "cummax": F.max(v).over(run), "cummin": F.min(v).over(run), "diff": v - F.lag(v).over(w)})


def runs(df: DataFrame, value: str, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Run-length encoding: (by, run, value, first and last order, length) of each stretch of equal values."""
    w = ordered(order_by, by)
    v = F.col(value)
    new = F.when(F.row_number().over(w) == 1, 1).when(v.eqNullSafe(F.lag(v).over(w)), 0).otherwise(1)
    marked = df.withColumn("_new", new)
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order_by)
    return marked.groupBy(*by, "run").agg(F.first(value).alias("value"), F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("length"))


def islands(df: DataFrame, keep: Column, order_by: list[str], by: list[str] = (), least: int = 1) -> DataFrame:
    """Stretches of consecutive rows where `keep` holds, of `least` rows at least."""
    w = ordered(order_by, by)
    numbered = df.withColumn("_n", F.row_number().over(w)).where(keep)
    numbered = numbered.withColumn("island", F.col("_n") - F.row_number().over(w))
    return numbered.groupBy(*by, "island").agg(F.min("_n").alias("first_row"), F.max("_n").alias("last_row"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def sessions(df: DataFrame, ts: str, gap: float, by: list[str] = ()) -> DataFrame:
    """Session numbers: a new one where the time since the row before is more than `gap` seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    since = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    marked = df.withColumn("_new", F.when(since.isNull() | (since > gap * 1e6), 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def block_maxima(df: DataFrame, value: str, size: int, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """Maximum of each full block of `size` consecutive rows; what is left over at the end is dropped."""
    block = F.floor((F.row_number().over(ordered(order_by, by)) - 1) / size)
    return df.withColumn("block", block).groupBy(*by, "block").agg(F.max(value).alias("maximum"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)


def _at_risk(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(duration, events, at_risk) by distinct duration."""
    counts = df.groupBy(duration).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("n"))
    return running(counts, duration, ["n"], descending=True).select(duration, "events", F.col("run_n").alias("at_risk"))


def nelson_aalen(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(duration, at_risk, events, hazard): cumulative hazard of durations with event 1 and censored ones with 0."""
    steps = _at_risk(df, duration, event).withColumn("step", F.col("events") / F.col("at_risk"))
    return running(steps, duration, ["step"]).select(duration, "at_risk", "events", F.col("run_step").alias("hazard"))


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(duration, at_risk, events, survival): products as sums of logarithms, zero from where all at risk have the event."""
    factor = 1 - F.col("events") / F.col("at_risk")
    steps = _at_risk(df, duration, event).withColumns({"log": F.when(factor > 0, F.ln(factor)).otherwise(0.0), "dead": F.when(factor <= 0, 1).otherwise(0)})
    return running(steps, duration, ["log", "dead"]).select(duration, "at_risk", "events", F.when(F.col("run_dead") > 0, 0.0).otherwise(F.exp("run_log")).alias("survival"))


def folded(df: DataFrame, value: str, order_by: list[str], by: list[str]) -> DataFrame:
    """(by, series): each key's values in order, for folds. A key's series must fit in a task."""
    pairs = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda s: s["_v"]).alias("series"))


def ewma(series: Column, alpha: float) -> Column:
    """Exponentially weighted mean of an array: the first value starts it."""
    return F.aggregate(series, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))


def cusum(series: Column, target: float, slack: float, threshold: float) -> Column:
    """Number of two-sided CUSUM alarms; an alarm resets both sums. Slack goes into the target first, so that each step adds and subtracts as `sum + x - (target + slack)` does in SQL: another order of the terms rounds sums near the threshold to its other side."""
    zero = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"), F.lit(0).alias("alarms"))

    def step(s: Column, x: Column) -> Column:
        hi = F.greatest(F.lit(0.0), s["hi"] + x - (target + slack))
        lo = F.greatest(F.lit(0.0), s["lo"] - x + (target - slack))
        fire = (hi > threshold) | (lo > threshold)
        return F.struct(F.when(fire, 0.0).otherwise(hi).alias("hi"), F.when(fire, 0.0).otherwise(lo).alias("lo"), (s["alarms"] + F.when(fire, 1).otherwise(0)).alias("alarms"))

    return F.aggregate(series, zero, step, lambda s: s["alarms"])


def holt(series: Column, alpha: float, beta: float, steps: int) -> Column:
    """Forecast `steps` ahead by level and trend, starting from the first value and no trend."""
    zero = F.struct(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("trend"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["level"] + s["trend"])
        return F.when(s["level"].isNull(), F.struct(x.alias("level"), F.lit(0.0).alias("trend"))).otherwise(F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend")))

    return F.aggregate(series, zero, step, lambda s: s["level"] + steps * s["trend"])


def interpolate(df: DataFrame, value: str, at: str, by: list[str] = ()) -> DataFrame:
    """Nulls filled linearly in `at` between neighbours, and by the nearest value at the ends."""
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    pos = F.when(F.col(value).isNotNull(), F.col(at))
    cols = df.withColumns({"_v0": F.last(value, True).over(before), "_v1": F.first(value, True).over(after), "_t0": F.last(pos, True).over(before), "_t1": F.first(pos, True).over(after)})
    share = (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    filled = F.coalesce(F.col(value), F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share))
    return cols.withColumn("filled", filled).drop("_v0", "_v1", "_t0", "_t1")
