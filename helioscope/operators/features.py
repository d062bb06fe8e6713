"""Feature scaling and expansion. Statistics of a column are one aggregate, joined back as a single broadcast row."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioscope.operators.prefix import quantiles


def _with(df: DataFrame, **stats) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in stats.items()])))


def standardize(df: DataFrame, value: str, ddof: int = 0, name: str = "scaled") -> DataFrame:
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return _with(df, _m=F.avg(value), _s=sd).withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def whiten(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """Divided by the standard deviation, not centred; a constant column stays."""
    return _with(df, _s=F.stddev_pop(value)).withColumn(name, F.col(value) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_s")


def minmax(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, name: str = "scaled") -> DataFrame:
    return _with(df, _a=F.min(value), _b=F.max(value)).withColumn(name, F.coalesce(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)) * (high - low) + low).drop("_a", "_b")


def robust(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """Less the median, over the interquartile range."""
    q = quantiles(df, value, {"_a": 0.25, "_b": 0.5, "_c": 0.75})
    return df.crossJoin(F.broadcast(q)).withColumn(name, F.try_divide(F.col(value) - F.col("_b"), F.col("_c") - F.col("_a"))).drop("_a", "_b", "_c")


def maxabs(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    return _with(df, _a=F.max(F.abs(F.col(value)))).withColumn(name, F.coalesce(F.try_divide(F.col(value), F.col("_a")), F.lit(0.0))).drop("_a")


def boxcox(value, lam: float):
    """Box-Cox transform of positive values."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(x > 0, F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam)


def yeo_johnson(value, lam: float):
    x = F.col(value) if isinstance(value, str) else value
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def polynomial(df: DataFrame, values: list[str], degree: int) -> DataFrame:
    """All products of up to `degree` of the columns, named by them."""
    out = {}
    for d in range(2, degree + 1):
        for c in combinations_with_replacement(values, d):
            product = F.lit(1.0)
            for v in c:
                product = product * F.col(v)
            out["*".join(c)] = product
    return df.withColumns(out)


def bins(value: str, edges: list[float]):
    """Number of the half-open interval [edge i, edge i + 1); null outside, the last edge belongs to the last interval."""
    x = F.col(value)
    out = F.when(x == edges[-1], len(edges) - 2)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when((x >= a) & (x < b), i)
    return out


def one_hot(df: DataFrame, value: str, levels: list[str]) -> DataFrame:
    return df.withColumns({f"{value}_{v}": F.when(F.col(value).eqNullSafe(F.lit(v)), 1).otherwise(0) for v in levels})


def target_encode(df: DataFrame, key: str, target: str, smooth: float = 1.0, name: str = "encoded") -> DataFrame:
    """Mean target of each key, drawn to the overall mean by `smooth` rows."""
    g = df.groupBy(key).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    m = df.agg(F.avg(target).alias("_m"))
    enc = g.crossJoin(F.broadcast(m)).select(key, ((F.col("_s") + smooth * F.col("_m")) / (F.col("_n") + smooth)).alias(name))
    return df.join(enc, key)


def variance_threshold(df: DataFrame, values: list[str], threshold: float = 0.0) -> list[str]:
    """Names of the columns whose population variance is over the threshold."""
    row = df.agg(*[F.var_pop(v).alias(v) for v in values]).first()
    return [v for v in values if row[v] is not None and row[v] > threshold]


def fourier(at, period: float, order: int) -> dict:
    """Sine and cosine terms of a column of times."""
    x = 2 * 3.141592653589793 * at / period
    return {f"{f}_{k}": g(k * x) for k in range(1, order + 1) for f, g in (("sin", F.sin), ("cos", F.cos))}


def calendar(hour) -> dict:
    """Features of an hour index: hour of day, day of week, weekend, month of 730 hours."""
    day = F.floor(hour / 24) % 7
    return {"hour": hour % 24, "day": day, "weekend": (day >= 5).cast("int"), "month": F.floor(hour / 730) % 12 + 1}
