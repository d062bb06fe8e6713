"""Geometry, finance, special functions, extremes, sampling, series and text models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.functions import finance, geometry
from helioscope.functions import special as S
from helioscope.functions import text as T
from helioscope.operators import extremes, metrics, prefix, sampling, series, textmodels
from helioscope.plans.registry import query, rounded
from helioscope.plans.statistics import HOURLY, hourly
from helioscope.session import load


@query("""SELECT o_orderkey, round(o_totalprice / power(1.05, 3), 4) AS pv, round(o_totalprice * power(1.05, 3), 4) AS fv, round(ln(1 + o_totalprice / 1e6), 6) AS cont FROM orders""")
def present_future_value(spark: SparkSession, d: str) -> DataFrame:
    x, r, n = F.col("o_totalprice"), F.lit(0.05), F.lit(3)
    return load(spark, d, "orders").select("o_orderkey", F.round(finance.present_value(x, r, n), 4).alias("pv"), F.round(finance.future_value(x, r, n), 4).alias("fv"), F.round(finance.continuous_return(x / 1e6), 6).alias("cont"))


@query()
def black_scholes(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    args = (F.col("p_retailprice"), F.lit(1000.0), F.lit(0.03), 0.1 + F.col("p_size") / 200, F.lit(1.5))
    return p.select("p_partkey", *rounded(call=finance.black_scholes(*args), put=finance.black_scholes(*args, call=False)))


@query("""WITH n AS (SELECT n_nationkey AS k, (n_nationkey * 37) % 140 - 70.0 AS lat, (n_nationkey * 53) % 360 - 180.0 AS lon FROM nation), b AS (SELECT a.k AS a, b.k AS b, degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) AS t FROM n a JOIN n b ON a.k < b.k)
    SELECT a, b, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 4) AS bearing FROM b""")
def bearings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = load(spark, d, "nation").select(k.alias("k"), ((k * 37) % 140 - 70.0).alias("lat"), ((k * 53) % 360 - 180.0).alias("lon"))
    a, b = n.alias("a"), F.broadcast(n).alias("b")
    return a.join(b, F.col("a.k") < F.col("b.k")).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(geometry.bearing(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 4).alias("bearing"))


@query("""SELECT s_suppkey, (10 * greatest(s_nationkey, 1))::DOUBLE AS area, (2 * (10 + greatest(s_nationkey, 1)))::DOUBLE AS perimeter, (s_acctbal > 0 AND s_acctbal < 10) AS inside FROM supplier""")
def polygons(spark: SparkSession, d: str) -> DataFrame:
    h = F.greatest(F.col("s_nationkey"), F.lit(1)).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, ten = F.lit(0.0), F.lit(10.0)
    p = F.array(corner(zero, zero), corner(ten, zero), corner(ten, h), corner(zero, h))
    return load(spark, d, "supplier").select("s_suppkey", F.round(geometry.area(p), 4).alias("area"), F.round(geometry.perimeter(p), 4).alias("perimeter"), geometry.contains(p, F.col("s_acctbal"), F.lit(0.5)).alias("inside"))


@query("""WITH h AS (""" + HOURLY + """), n AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM h)
    SELECT event_type, CAST((i - 1) // 24 AS BIGINT) AS block, round(sum(v), 4) AS total, count(*) AS n FROM n GROUP BY ALL HAVING count(*) = 24""")
def hourly_to_daily(spark: SparkSession, d: str) -> DataFrame:
    return extremes.blocks(hourly(spark, d), "v", 24, ["hour"], ["event_type"]).select("event_type", "block", F.round("total", 4).alias("total"), "n")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), l AS (SELECT event_type, min(value) AS level FROM r WHERE k = round(0.99 * (n - 1)) GROUP BY ALL)
    SELECT event_id FROM events JOIN l USING (event_type) WHERE value >= level""")
def peak_demand(spark: SparkSession, d: str) -> DataFrame:
    return extremes.peaks(load(spark, d, "events"), "value", 0.99, ["event_type"]).select("event_id")


@query("""WITH t AS (SELECT unnest([50.0, 100.0, 150.0]::DOUBLE[]) AS threshold) SELECT threshold, count(*) AS n, round(avg(value - threshold), 6) AS mean_excess, round(sqrt(var_pop(value - threshold) / count(*)), 6) AS standard_error FROM events, t WHERE value > threshold GROUP BY ALL""")
def pot_mean_residual(spark: SparkSession, d: str) -> DataFrame:
    x = extremes.mean_residual_life(load(spark, d, "events"), "value", [50.0, 100.0, 150.0])
    return x.select("threshold", "n", *rounded(mean_excess=F.col("mean_excess"), standard_error=F.col("standard_error")))


@query("""WITH s AS (SELECT user_id, event_id, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), u AS (SELECT *, d >= 0 AS up FROM s WHERE d IS NOT NULL),
    m AS (SELECT *, CASE WHEN up = lag(up) OVER w THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
    SELECT user_id, CAST(run AS BIGINT) AS run, up, count(*) AS steps, round(sum(d), 4) AS change FROM r GROUP BY user_id, run, up HAVING abs(sum(d)) >= 50""")
def ramp_events(spark: SparkSession, d: str) -> DataFrame:
    x = extremes.ramps(load(spark, d, "events"), "value", 50.0, ["event_id"], ["user_id"])
    return x.select("user_id", "run", "up", "steps", F.round("change", 4).alias("change"))


@query("""WITH z AS (SELECT event_id, CASE WHEN count(value) OVER w >= 10 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 99 PRECEDING))
    SELECT event_id, round(z, 5) AS z, coalesce(abs(z) > 3, false) AS anomaly FROM z""")
def rolling_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return extremes.anomalies(load(spark, d, "events"), "value", ["event_id"], ["event_type"], 100).select("event_id", F.round("z", 5).alias("z"), "anomaly")


@query("""SELECT event_id, round(avg(CASE WHEN value BETWEEN 10 AND 60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS coverage FROM events""")
def running_coverage(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").withColumns({"lo": F.lit(10.0), "hi": F.lit(60.0)})
    return extremes.coverage(x, "value", "lo", "hi", ["event_id"], ["user_id"]).select("event_id", F.round("coverage", 6).alias("coverage"))


@query()
def train_test_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = sampling.train_test_split(load(spark, d, "orders"), "o_orderkey", 0.2, 1)
    return a.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("train")).union(b.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("test")))


@query()
def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bootstrap_means(load(spark, d, "orders"), "o_totalprice", "o_orderkey", 20, 1)


@query("SELECT p_size, round(ln(gamma(p_size)), 5) AS gammaln, round(exp(-power(p_size - 25, 2) / 200.0) / (10 * sqrt(2 * pi())), 9) AS normal_pdf, factorial(CAST(p_size % 12 AS INTEGER))::DOUBLE AS factorial, round(0.1 * exp(-0.1 * p_size), 9) AS exponential FROM part GROUP BY p_size")
def densities(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return load(spark, d, "part").select("p_size").distinct().select("p_size", F.round(S.gammaln(x), 5).alias("gammaln"), F.round(S.distribution("normal", x, mean=25.0, sd=10.0), 9).alias("normal_pdf"), S.factorial(x % 12).alias("factorial"), F.round(S.distribution("exponential", x, rate=0.1), 9).alias("exponential"))


@query(f"""WITH h AS ({HOURLY}), n AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h), k AS (SELECT DISTINCT event_type, n, unnest(range(0, n // 2 + 1)) AS k FROM n)
    SELECT event_type, k AS frequency, round(power(sum(v * cos(2 * pi() * ((i * k) % n.n) / n.n)), 2) + power(sum(v * sin(2 * pi() * ((i * k) % n.n) / n.n)), 2), 2) AS power FROM n JOIN k USING (event_type) GROUP BY ALL""")
def spectrum(spark: SparkSession, d: str) -> DataFrame:
    return series.spectrum(hourly(spark, d), "v", "hour", ["event_type"]).withColumn("power", F.round("power", 2))


HALVED = "list_transform(range(0, (len({0}) + 1) // 2), lambda k: ({0}[2 * k + 1] {1} {0}[least(2 * k + 2, len({0}))]) / sqrt(2))"


@query(f"""WITH h AS ({HOURLY}), a AS (SELECT event_type, list(v ORDER BY hour) AS x FROM h GROUP BY ALL), b AS (SELECT *, {HALVED.format('x', '+')} AS y FROM a), c AS (SELECT *, {HALVED.format('y', '+')} AS z FROM b),
    l AS (SELECT event_type, 1 AS level, {HALVED.format('x', '-')} AS d FROM c UNION ALL SELECT event_type, 2, {HALVED.format('y', '-')} FROM c UNION ALL SELECT event_type, 3, {HALVED.format('z', '-')} FROM c)
    SELECT event_type, level, unnest(range(0, len(d))) AS position, round(unnest(d), 4) + 0 AS detail FROM l""")
def haar_wavelet(spark: SparkSession, d: str) -> DataFrame:
    return series.haar(hourly(spark, d), "v", "hour", ["event_type"], 3).withColumn("detail", F.round("detail", 4) + 0)


@query()
def forecasts(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    ar = series.ar_fit(h, "v", "hour", ["event_type"], 3, 6).withColumn("model", F.lit("ar"))
    return ar.union(series.holt_winters(h, "v", "hour", ["event_type"], 24, 6).withColumn("model", F.lit("holt_winters")))


@query()
def stationarity(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    return series.adf(h, "v", "hour", ["event_type"]).join(series.kpss(h, "v", "hour", ["event_type"]), "event_type").join(series.permutation_entropy(h, "v", "hour", ["event_type"]), "event_type")


@query()
def savgol_smooth(spark: SparkSession, d: str) -> DataFrame:
    return series.savgol(hourly(spark, d), "v", "hour", ["event_type"], 7, 2)


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'whereas|liability|contract') THEN 'legal' WHEN regexp_matches(lower(text), 'patient|diagnosis|medication') THEN 'medical' WHEN regexp_matches(lower(text), 'revenue|profit|investment') THEN 'financial'
    WHEN regexp_matches(lower(text), 'claim|invention|patent') THEN 'patent' WHEN regexp_matches(lower(text), 'breaking|according to|officials') THEN 'news' WHEN regexp_matches(lower(text), '[#@]') THEN 'social_media' ELSE 'scientific' END AS domain FROM documents""")
def domain_detect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", textmodels.domain(F.col("text")).alias("domain"))


@query("""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), p AS (SELECT item_id, w, lag(w) OVER (ORDER BY item_id) AS r FROM b), q AS (SELECT * FROM p WHERE r IS NOT NULL AND len(w) > 0 AND len(r) > 0),
    h AS (SELECT item_id, len(w) AS a, len(r) AS b, list_sum(list_transform(list_distinct(w), lambda t: least(len(list_filter(w, lambda y: y = t)), len(list_filter(r, lambda y: y = t))))) AS n FROM q)
    SELECT item_id, round(n / a, 6) AS precision, round(n / b, 6) AS recall, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / a) * (n / b) / (n / a + n / b) END, 6) AS f1 FROM h""")
def rouge_n_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    x = prefix.lagged(x, ["w"], "item_id").withColumnRenamed("last_w", "r").where("r IS NOT NULL AND size(w) > 0 AND size(r) > 0")
    x = x.select("item_id", textmodels.rouge_n(F.col("w"), F.col("r"), 1).alias("s"))
    return x.select("item_id", *rounded(precision=F.col("s.precision"), recall=F.col("s.recall"), f1=F.col("s.f1")))


@query()
def rouge_l_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    x = prefix.lagged(x, ["w"], "item_id").withColumnRenamed("last_w", "r").where("r IS NOT NULL")
    return x.select("item_id", textmodels.rouge_l(F.col("w"), F.col("r")).alias("s")).select("item_id", "s.precision", "s.recall", "s.f1")


@query("""WITH k AS (SELECT item_id, unnest(CASE WHEN length(text) >= 3 THEN list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) ELSE [] END) AS kmer FROM benchmark), c AS (SELECT item_id, kmer, count(*) AS n FROM k GROUP BY ALL)
    SELECT item_id, kmer, n, round(n / sum(n) OVER (PARTITION BY item_id), 6) AS share FROM c""")
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return textmodels.kmers(load(spark, d, "benchmark"), "text", 3, ["item_id"]).withColumn("share", F.round("share", 6))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), c AS (SELECT token, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 3) SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER) AS "index" FROM c""")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return textmodels.vocabulary(load(spark, d, "benchmark").select(T.words(F.col("text")).alias("w")), "w", 3)


@query("""WITH x AS (SELECT o_orderkey, o_totalprice::DOUBLE / 1000 - 150 AS x, o_orderkey % 3 AS n FROM orders) SELECT o_orderkey, CASE WHEN x > 0 THEN round(log10(x), 6) END AS log10, CASE WHEN x >= 0 THEN round(power(x, 0.5), 6) END AS root, x * 10 > 709.782712893384 AS overflow, CASE WHEN n <> 0 THEN round(x / n, 6) + 0 END AS normal FROM x""")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    x, n = F.col("o_totalprice").cast("double") / 1000 - 150, F.col("o_orderkey") % 3
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.round(S.safe_log10(x), 6).alias("log10"), F.round(S.safe_pow(x, F.lit(0.5)), 6).alias("root"), S.safe_exp(x * 10).isNull().alias("overflow"), (F.round(S.safe_normalize(x, n), 6) + 0).alias("normal"))


@query("""WITH b AS (SELECT (l_returnflag = 'R')::INTEGER AS a1, (l_discount > 0.05)::INTEGER AS a2, (l_tax > 0.04)::INTEGER AS a3, (l_linestatus = 'F')::INTEGER AS b1, (l_quantity > 25)::INTEGER AS b2, (l_tax > 0.02)::INTEGER AS b3, l_discount, l_tax FROM lineitem)
    SELECT round(avg(a1 + a2 + a3), 6) AS cardinality, round(avg(a1 + a2 + a3) / 3, 6) AS density, round(avg(abs(a1 - b1) + abs(a2 - b2) + abs(a3 - b3)) / 3, 6) AS hamming_loss, round((count(*) FILTER (l_discount = 0) + count(*) FILTER (l_tax = 0)) / (count(l_discount) + count(l_tax)), 6) AS sparsity FROM b""")
def multilabel_scores(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem")
    y = l.select(F.array(F.col("l_returnflag") == "R", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04).alias("y"), F.array(F.col("l_linestatus") == "F", F.col("l_quantity") > 25, F.col("l_tax") > 0.02).alias("p"))
    return metrics.multilabel(y, "y", "p").crossJoin(metrics.sparsity(l, ["l_discount", "l_tax"])).select(*(F.round(c, 6).alias(c) for c in ("cardinality", "density", "hamming_loss", "sparsity")))  # one row each
