"""Stateful operators: recurrences over each key's values, carried from trigger to trigger."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helioscope.operators import graph

Step = Callable[[list[float], float], tuple[float, ...]]


def carried(stream: DataFrame, value: str, order_by: list[str], by: list[str], fresh: list[float], step: Step, columns: list[str]) -> DataFrame:
    """(by, order_by, value, columns) of each row with a value: what `step` returns of the key's state, a list of numbers that it changes in place.

    Rows of a trigger are taken in the order of order_by, ties in the order of
    the values; those of later triggers come after, so a trigger should not
    reach back before the last one's rows. A key's rows of one trigger are
    held in a task: the source's limit on files a trigger bounds them. The
    state has a fixed size a key and is kept for good. Null values and keys
    that are null are left out, so is NaN.
    """
    picked = stream.select(*by, *order_by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    for c in by:
        picked = picked.where(F.col(c).isNotNull())
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = list(state.get[0]) if state.exists else list(fresh)
        rows = pd.concat(list(batches)).sort_values([*order_by, value], kind="stable").reset_index(drop=True)
        got = pd.DataFrame([step(own, v) for v in rows[value].tolist()], columns=columns, dtype="float64")
        state.update((own,))
        yield pd.concat([rows, got], axis=1)[[*by, *order_by, value, *columns]]

    out = kind + "".join(f", `{c}` double" for c in columns)
    return picked.groupBy(*by).applyInPandasWithState(run, out, "numbers array<double>", "append", GroupStateTimeout.NoTimeout)


def analyzed(stream: DataFrame, value: str, order_by: list[str], by: list[str], alpha: float, drift: float, threshold: float) -> DataFrame:
    """Running n, mean, variance (n - 1; null of one value), ewma, ewma_variance, cusum_up, cusum_down and change (1 or 0) of each key.

    The cumulative sums are of deviations from the running mean, less the
    drift; when one passes the threshold both start again from zero.
    """

    def step(s: list[float], v: float) -> tuple[float, ...]:
        n, mean, m2, ewma, spread, up, down = s
        n += 1
        off = v - mean
        mean += off / n
        m2 += off * (v - mean)
        if n == 1:
            ewma = v
        else:
            ewma = alpha * v + (1 - alpha) * ewma
            spread = alpha * (v - ewma) ** 2 + (1 - alpha) * spread
        up, down = max(0.0, up + (v - mean) - drift), max(0.0, down - (v - mean) - drift)
        change = up > threshold or down > threshold
        s[:] = [n, mean, m2, ewma, spread, *((0.0, 0.0) if change else (up, down))]
        return n, mean, m2 / (n - 1) if n > 1 else math.nan, ewma, spread, up, down, float(change)

    return carried(stream, value, order_by, by, [0.0] * 7, step, ["n", "mean", "variance", "ewma", "ewma_variance", "cusum_up", "cusum_down", "change"])


def forecast(stream: DataFrame, value: str, order_by: list[str], by: list[str], alpha: float, beta: float | None = None, gamma: float | None = None, period: int = 0, steps: int = 1) -> DataFrame:
    """Level, trend and the forecast `steps` ahead after each value: exponential smoothing, with a trend where beta is given and seasons of `period` values where gamma is.

    The first value is the level; trend and seasons start at zero. The old level
    is smoothed without the trend, so on a line of slope b the level trails by
    b * (1 - alpha) / alpha. The value
    numbered k, from one, belongs to the season (k - 1) mod period.
    """
    if gamma is not None and period < 1:
        raise ValueError("seasons need a period")
    seasons = period if gamma is not None else 0

    def step(s: list[float], v: float) -> tuple[float, ...]:
        n, level, trend = int(s[0]) + 1, s[1], s[2]
        spot = 3 + (n - 1) % seasons if seasons else -1
        if n == 1:
            level = v
        else:
            before = level
            level = alpha * (v - (s[spot] if seasons else 0.0)) + (1 - alpha) * before
            if beta is not None:
                trend = beta * (level - before) + (1 - beta) * trend
            if seasons:
                s[spot] = gamma * (v - level) + (1 - gamma) * s[spot]
        s[:3] = [float(n), level, trend]
        ahead = s[3 + (n + steps - 1) % seasons] if seasons else 0.0
        return level, trend, level + trend * steps + ahead

    return carried(stream, value, order_by, by, [0.0] * (3 + seasons), step, ["level", "trend", "forecast"])


def settled(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """All that a stream appends for what its source has now, through a Parquet sink in the folder that executors share; nothing of it is held by the driver."""
    folder = f"{graph.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
