"""Mergeable sketches: Spark's own where it has them, tables of counters where it doesn't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hll(x: Column, lg: int = 12) -> Column:
    return F.hll_sketch_agg(x, lg)


def hll_merge(s: Column) -> Column:
    """Estimate of the union of sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg(s))


def kll(x: Column) -> Column:
    return F.kll_sketch_agg_double(x)


def kll_merge(s: Column) -> Column:
    return F.kll_merge_agg_double(s) if hasattr(F, "kll_merge_agg_double") else F.reduce(F.collect_list(s), F.lit(None).cast("binary"), lambda a, b: F.when(a.isNull(), b).otherwise(F.kll_sketch_merge_double(a, b)))


def kll_quantile(s: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(s, F.lit(q))


def _cells(key: Column, depth: int, width: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(width)).alias("cell")) for i in range(depth)])


def count_min(df: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """(row, cell, n): depth x width counters at most; sketches of parts add up."""
    return df.select(F.explode(_cells(F.col(key), depth, width)).alias("c")).groupBy("c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def count_min_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_query(sketch: DataFrame, keys: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """(key, estimate): never under the true count. The sketch, depth x width rows at most, is broadcast."""
    k = keys.select(key, F.explode(_cells(F.col(key), depth, width)).alias("c")).select(key, "c.row", "c.cell")
    return k.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def count_min_inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """(estimate) of the sum over keys of the products of both counts, never under it: the least dot product of a row. Of an empty sketch it is 0."""
    dots = a.select("row", "cell", F.col("n").alias("_a")).join(b, ["row", "cell"], "left").groupBy("row").agg(F.sum(F.col("_a") * F.coalesce("n", F.lit(0))).alias("dot"))
    return dots.agg(F.coalesce(F.min("dot"), F.lit(0)).cast("bigint").alias("estimate"))


def count_sketch(df: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """(row, cell, n) with signs, for unbiased estimates."""
    x = df.select(F.col(key), F.explode(_cells(F.col(key), depth, width)).alias("c"))
    sign = F.when(F.pmod(F.xxhash64(F.lit(17), "c.row", key), F.lit(2)) == 0, 1).otherwise(-1)
    return x.groupBy("c.row", "c.cell").agg(F.sum(sign).alias("n"))


def count_sketch_query(sketch: DataFrame, keys: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """(key, estimate): median over the rows."""
    k = keys.select(key, F.explode(_cells(F.col(key), depth, width)).alias("c")).select(key, "c.row", "c.cell")
    sign = F.when(F.pmod(F.xxhash64(F.lit(17), "row", key), F.lit(2)) == 0, 1).otherwise(-1)
    return k.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(key).agg(F.percentile(F.coalesce("n", F.lit(0)) * sign, 0.5).alias("estimate"))


def bloom_prefilter(left: DataFrame, right: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """Rows of left whose key may be in right, repeated rows as often as they stand: all that are, few that aren't, none with a null key.

    The filter is one array of bits / 60 numbers, broadcast as a single row; a
    row of left is probed by an expression, and meets no other.
    """
    spot = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(bits))
    one = lambda b: F.when(b.isNotNull(), F.expr("1L") * F.pow(F.lit(2.0), b % 60).cast("bigint"))
    words = -(-bits // 60)
    set_ = right.where(F.col(key).isNotNull()).select(F.explode(F.array(*[spot(i) for i in range(hashes)])).alias("b"))
    filled = set_.groupBy(F.floor(F.col("b") / 60).alias("w")).agg(F.bit_or(one(F.col("b"))).alias("m"))
    filled = left.sparkSession.range(words).withColumnRenamed("id", "w").join(filled, "w", "left")
    row = filled.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("bigint")).alias("m")))).alias("_f")).select(F.transform("_f", lambda s: s["m"]).alias("_f"))
    hit = F.col(key).isNotNull()
    for i in range(hashes):
        hit = hit & (F.get("_f", F.floor(spot(i) / 60).cast("int")).bitwiseAND(one(spot(i))) != 0)
    return left.crossJoin(F.broadcast(row)).where(hit).drop("_f")


def _digested(df: DataFrame, value: str, by: list[str], at_name: str, points: list[float], answer: Callable[[np.ndarray, np.ndarray], np.ndarray], compression: int) -> DataFrame:
    """(by, at_name, estimate): what `answer` tells of the means and middle ranks of a t-digest at the points. One digest for each task and key, of at most 2 * compression centroids, merged by key."""

    def squeeze(m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(m, kind="stable")
        m, w = m[order], w[order]
        at = (np.cumsum(w) - w / 2) / w.sum()
        cell = np.floor(compression / np.pi * (np.arcsin(2 * at - 1) + np.pi / 2)).astype(np.int64)
        first = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        ws = np.add.reduceat(w, first)
        return np.add.reduceat(m * w, first) / ws, ws

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for k, g in pdf.dropna(subset=[value]).groupby(by, dropna=False):
                m = g[value].to_numpy(float)
                old = held.get(k, (m[:0], m[:0]))
                held[k] = squeeze(np.append(old[0], m), np.append(old[1], np.ones(len(m))))
        for k, (m, w) in held.items():
            yield pd.DataFrame({**dict(zip(by, ([x] * len(m) for x in k))), "m": m, "w": w})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        m, w = squeeze(pdf["m"].to_numpy(), pdf["w"].to_numpy())
        at = (np.cumsum(w) - w / 2) / w.sum()
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(points) for c in by}, at_name: points, "estimate": answer(m, at)})

    parts = df.select(*by, F.col(value).cast("double").alias(value)).mapInPandas(part, f"{kind}, m double, w double")
    return parts.groupBy(*by).applyInPandas(whole, f"{kind}, {at_name} double, estimate double")


def tdigest_quantiles(df: DataFrame, value: str, by: list[str], qs: list[float], compression: int = 200) -> DataFrame:
    """(by, q, estimate) by t-digests."""
    return _digested(df, value, by, "q", qs, lambda m, at: np.interp(qs, at, m), compression)


def tdigest_cdf(df: DataFrame, value: str, by: list[str], xs: list[float], compression: int = 200) -> DataFrame:
    """(by, x, estimate): the share of values up to x by t-digests; 0 under the first centroid and 1 over the last."""
    return _digested(df, value, by, "x", xs, lambda m, at: np.interp(xs, m, at, left=0.0, right=1.0), compression)


def reservoir(df: DataFrame, key: str, k: int, by: list[str], seed: int) -> DataFrame:
    """k rows a stratum, uniformly: the least hashes of key and seed, so the sample doesn't depend on the partitioning."""
    pick = F.xxhash64(F.lit(seed), F.col(key))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(pick, key))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")
