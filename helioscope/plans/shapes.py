"""Features of ordered signals, dispersion, and what sketches tell of each other, over events, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.operators import shape, sketches, stats
from helioscope.plans.registry import query, rounded
from helioscope.session import load


@query("""WITH s AS (SELECT user_id, value - 50 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) - 1 AS i FROM events WHERE value IS NOT NULL),
    x AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q, avg(v) OVER k AS m, count(*) OVER k AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i), k AS (PARTITION BY user_id)),
    f AS (SELECT *, power(i - (n - 1) / 2, 2) AS u, n > 1 AND coalesce(v > p, true) AND coalesce(v > q, true) AS top, n > 1 AND coalesce(v < p, true) AND coalesce(v < q, true) AS low FROM x),
    d AS (SELECT *, CASE WHEN top THEN i - lag(i) OVER (PARTITION BY user_id, top ORDER BY i) END AS step FROM f)
    SELECT user_id, count(*) AS n, round(regr_slope(v, i), 6) AS trend_slope, round(regr_intercept(v, i), 6) AS trend_intercept, round(regr_r2(v, i), 6) AS trend_r_squared, round(sqrt(var_pop(v) * (1 - regr_r2(v, i))), 6) AS trend_residual_std,
    round(power(corr(v, u), 2) / (1 - regr_r2(v, i)), 6) AS non_linearity, count(*) FILTER ((v >= 0) <> (p >= 0)) AS zero_crossings, round(count(*) FILTER ((v >= 0) <> (p >= 0)) / count(*), 6) AS zero_crossing_rate,
    count(*) FILTER ((v >= m) <> (p >= m)) AS mean_crossings, round(count(*) FILTER ((v >= m) <> (p >= m)) / count(*), 6) AS mean_crossing_rate, count(*) FILTER (top) AS num_peaks, count(*) FILTER (low) AS num_troughs,
    round(count(*) FILTER (top) / nullif(count(*) FILTER (low), 0), 6) AS peak_trough_ratio, round(max(v) - min(v), 6) AS peak_to_peak, round(count(*) FILTER (top) / count(*), 6) AS peak_density,
    round(avg(step), 6) AS mean_peak_distance, round(CASE WHEN count(step) > 1 THEN stddev_pop(step) END, 6) AS peak_distance_std, round(max(abs(v)) / sqrt(avg(v * v)), 6) AS crest_factor FROM d GROUP BY user_id""")
def signal_features(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") - 50).alias("v"))
    x = shape.signal_features(e, "v", ["ts", "event_id"], ["user_id"])
    whole = {"user_id", "n", "zero_crossings", "mean_crossings", "num_peaks", "num_troughs"}
    return x.select(*(c if c in whole else rounded(**{c: F.col(c)})[0] for c in x.columns))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.1) AS lo, quantile_cont(c_acctbal, 0.9) AS hi, avg(c_acctbal) AS m FROM customer GROUP BY ALL)
    SELECT c_mktsegment, round(var_samp(least(greatest(c_acctbal, lo), hi)), 3) AS winsorized_variance, round(avg(abs(c_acctbal - m)), 4) AS mean_abs_deviation FROM customer JOIN q USING (c_mktsegment) GROUP BY c_mktsegment""")
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    x = stats.winsorized_variance(c, "c_acctbal", 0.1, ["c_mktsegment"]).join(stats.mean_abs_deviation(c, "c_acctbal", ["c_mktsegment"]), "c_mktsegment")
    return x.select("c_mktsegment", F.round("winsorized_variance", 3).alias("winsorized_variance"), F.round("mean_abs_deviation", 4).alias("mean_abs_deviation"))


@query()
def count_min_inner_product(spark: SparkSession, d: str) -> DataFrame:
    """Size of the join of line items and orders on the days of shipping and ordering, from two sketches."""
    a = load(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    b = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return sketches.count_min_inner(sketches.count_min(a, "day", 4, 1 << 14), sketches.count_min(b, "day", 4, 1 << 14))


@query()
def tdigest_shares(spark: SparkSession, d: str) -> DataFrame:
    return sketches.tdigest_cdf(load(spark, d, "events"), "value", ["event_type"], [10.0, 50.0, 90.0])
