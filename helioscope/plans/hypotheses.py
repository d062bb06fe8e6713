"""Further tests of hypotheses, and walks over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.operators import graph, stats
from helioscope.plans.graphs import edges, nations
from helioscope.plans.registry import query, rounded
from helioscope.session import load


@query("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM lineitem")
def ttest_1samp(spark: SparkSession, d: str) -> DataFrame:
    return stats.t_one_sample(load(spark, d, "lineitem"), "l_quantity", 25.0).withColumn("t", F.round("t", 6))


@query("SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM lineitem")
def ttest_rel(spark: SparkSession, d: str) -> DataFrame:
    return stats.t_paired(load(spark, d, "lineitem"), "l_discount", "l_tax").withColumn("t", F.round("t", 6))


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS c FROM orders GROUP BY ALL), z AS (SELECT o_orderpriority AS g, abs(o_totalprice - c) AS z FROM orders JOIN m USING (o_orderpriority)),
    g AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY g), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM g), b AS (SELECT sum(g.n * power(g.m - t.mean, 2)) AS b FROM g, t)
    SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f FROM t, b""")
def levene_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.levene(load(spark, d, "orders"), "o_totalprice", "o_orderpriority").select(F.round("f", 6).alias("f"))


@query("""WITH g AS (SELECT count(*) - 1 AS f, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), s AS (SELECT sum(f) AS f, sum(f * v) AS s, sum(f * ln(v)) AS l, sum(1 / f) AS r, count(*) AS k FROM g)
    SELECT round((f * ln(s / f) - l) / (1 + (r - 1 / f) / (3 * (k - 1))), 5) AS bartlett, k - 1 AS df FROM s""")
def bartlett(spark: SparkSession, d: str) -> DataFrame:
    return stats.bartlett(load(spark, d, "orders"), "o_totalprice", "o_orderpriority").withColumn("bartlett", F.round("bartlett", 5))


@query("""WITH o AS (SELECT event_type, count(*) AS o FROM events GROUP BY ALL), k AS (SELECT count(*) AS k, sum(o) AS n FROM o) SELECT round(sum(power(o - n / k, 2) / (n / k)), 6) AS chi2, count(*) - 1 AS df FROM o, k""")
def chisquare_uniform(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    keys = e.select("event_type").distinct()
    shares = keys.crossJoin(F.broadcast(keys.agg((1 / F.count(F.lit(1))).alias("share"))))
    return stats.chi2_goodness(e, "event_type", shares).withColumn("chi2", F.round("chi2", 6))


@query("""WITH c AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25)::DOUBLE AS a, count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS b, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS c, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS d FROM lineitem)
    SELECT round(a * d / (b * c), 6) AS odds_ratio, round((a / (a + b)) / (c / (c + d)), 6) AS relative_risk FROM c""")
def odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("e"), (F.col("l_quantity") > 25).alias("v"))
    return stats.two_by_two(x, "e", "v").select(*rounded(odds_ratio=F.col("odds_ratio"), relative_risk=F.col("relative_risk")))


@query("""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d)
    SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n FROM r""")
def wilcoxon_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(load(spark, d, "lineitem"), "l_discount", "l_tax")


@query("""WITH v AS (SELECT l_suppkey AS b, l_returnflag AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2 AS r FROM v),
    s AS (SELECT sum(s * s) AS q, count(*) AS k FROM (SELECT t, sum(r) AS s FROM r GROUP BY t)), n AS (SELECT count(DISTINCT b) AS n FROM r) SELECT round(12 / (n * k * (k + 1)) * q - 3 * n * (k + 1), 5) AS friedman, k - 1 AS df FROM s, n""")
def friedman(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    return stats.friedman(v, "l_suppkey", "l_returnflag", "v").withColumn("friedman", F.round("friedman", 5))


@query("""SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(var_samp(l_quantity), 5) AS cov, 1.0 AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(covar_samp(l_quantity, l_discount), 5), round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_discount', round(var_samp(l_discount), 5), 1.0 FROM lineitem""")
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariance_matrix(load(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("a", "b", F.round("cov", 5).alias("cov"), F.round("corr", 6).alias("corr"))


@query("""WITH l AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, epoch_us(l_shipdate) / 8.64e10 AS s, epoch_us(l_shipdate) / 8.64e10 + l_linenumber AS e FROM lineitem),
    g AS (SELECT *, lead(s) OVER (PARTITION BY a, b ORDER BY s, e) - e AS gap FROM l) SELECT a, b, count(*) AS contacts, round(sum(e - s), 4) AS duration, round(avg(CASE WHEN gap > 0 THEN gap END), 4) AS mean_gap FROM g GROUP BY ALL""")
def link_stream(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 8.64e10
    l = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), day.alias("start"), (day + F.col("l_linenumber")).alias("end"))
    return graph.link_stream(l).select("a", "b", "contacts", F.round("duration", 4).alias("duration"), F.round("mean_gap", 4).alias("mean_gap"))


@query()
def random_walks(spark: SparkSession, d: str) -> DataFrame:
    return graph.random_walks(nations(spark, d), 2, 4, 1)


@query()
def hits(spark: SparkSession, d: str) -> DataFrame:
    return graph.hits(edges(spark, d), 4)
