"""Scores of clusterings, forecasts and fits over embeddings, events, orders and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.functions import special as S
from helioscope.operators import evaluation as E
from helioscope.plans.registry import query, rounded
from helioscope.plans.signals import SIGNAL, signals
from helioscope.session import load

CLUSTERS = """c AS (SELECT label, vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM c GROUP BY ALL),
    d AS (SELECT c.label, vec_id, sum(power(v - m, 2)) AS d FROM c JOIN m USING (label, i) GROUP BY ALL), s AS (SELECT label, avg(sqrt(d)) AS scatter, sum(d) AS inertia, count(*) AS n FROM d GROUP BY ALL)"""


@query(f"""WITH {CLUSTERS}, p AS (SELECT a.label AS a, b.label AS b, sqrt(sum(power(a.m - b.m, 2))) AS dist FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
    r AS (SELECT a, max((x.scatter + y.scatter) / dist) AS r FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a),
    g AS (SELECT i, avg(v) AS g FROM c GROUP BY i), b AS (SELECT sum(n * power(m - g, 2)) AS b FROM m JOIN g USING (i)), t AS (SELECT sum(inertia) AS w, count(*) AS k, sum(n) AS n FROM s)
    SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round(2 * (k * 64 + 1) + n * 64 * (ln(2 * pi() * w / (n * 64)) + 1), 3) AS aic, round(w / n, 5) AS distortion FROM b, t""")
def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "embeddings")
    one = E.davies_bouldin(p, "label", "embedding").crossJoin(E.calinski_harabasz(p, "label", "embedding")).crossJoin(E.information_criteria(p, "label", "embedding"))
    return one.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("aic", 3).alias("aic"), F.round("distortion", 5).alias("distortion"))


@query("""WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS sa, sum(n) OVER (PARTITION BY b) AS sb, sum(n) OVER () AS s FROM t),
    x AS (SELECT sum(n / s * ln(n * s / (sa * sb))) AS mi, -sum(n / s * ln(sa / s)) AS ha, -sum(n / s * ln(sb / s)) AS hb FROM m) SELECT round(mi, 6) + 0 AS mutual_information, round(2 * mi / (ha + hb), 6) + 0 AS nmi, round(ha + hb - 2 * mi, 6) AS variation FROM x""")
def information_distances(spark: SparkSession, d: str) -> DataFrame:
    x = E.variation_of_information(load(spark, d, "labels"), "quality", "toxic")
    return x.select(*((F.round(c, 6) + 0).alias(c) for c in ("mutual_information", "nmi", "variation")))


@query(f"""WITH s AS ({SIGNAL}), p AS (SELECT vec_id, list_transform(v[1:8], lambda x: exp(x)) AS a, list_transform(v[9:16], lambda x: exp(x)) AS b FROM s), q AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM p)
    SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: p[i] * ln(2 * p[i] / (p[i] + q[i])) + q[i] * ln(2 * q[i] / (p[i] + q[i])))) / 2, 6) AS jensen_shannon FROM q""")
def jensen_shannon_vectors(spark: SparkSession, d: str) -> DataFrame:
    from helioscope.functions.arrays import softmax

    v = F.col("v")
    return signals(spark, d).select("vec_id", F.round(E.jensen_shannon(softmax(F.slice(v, 1, 8)), softmax(F.slice(v, 9, 8))), 6).alias("jensen_shannon"))


@query("""WITH l AS (SELECT label, list_transform(embedding, lambda x: exp(x::DOUBLE))[1:10] AS e FROM embeddings), p AS (SELECT label, -ln(e[label + 1] / list_sum(e)) AS c FROM l)
    SELECT round(avg(c), 6) AS cross_entropy, round(sum(c * CASE WHEN label = 0 THEN 3 ELSE 1 END) / sum(CASE WHEN label = 0 THEN 3 ELSE 1 END), 6) AS weighted FROM p""")
def multiclass_entropy(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "embeddings").select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("s"))
    return E.cross_entropy(x, "label", "s").crossJoin(E.cross_entropy(x, "label", "s", {0: 3.0}).withColumnRenamed("cross_entropy", "weighted")).select(*rounded(cross_entropy=F.col("cross_entropy"), weighted=F.col("weighted")))


@query("""WITH w AS (SELECT event_type, value, 10.0 AS low, 60.0 AS high FROM events) SELECT event_type, round(avg(high - low + CASE WHEN value < low THEN 20 * (low - value) WHEN value > high THEN 20 * (value - high) ELSE 0 END), 4) AS winkler, round(avg(high - low), 4) AS sharpness,
    round(1 - avg(power(value - 35, 2)) / avg(power(value - 20, 2)), 6) AS skill, round(avg((abs(value - 10) + abs(value - 30) + abs(value - 80)) / 3 - (20 + 70 + 50) / 9.0), 5) AS crps FROM w GROUP BY event_type""")
def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    v, low, high = F.col("value"), F.lit(10.0), F.lit(60.0)
    members = F.array(F.lit(80.0), F.lit(10.0), F.lit(30.0))
    g = load(spark, d, "events").groupBy("event_type")
    return g.agg(F.round(F.avg(E.winkler(v, low, high, 0.1)), 4).alias("winkler"), F.round(F.avg(high - low), 4).alias("sharpness"), F.round(E.skill(F.avg((v - 35) * (v - 35)), F.avg((v - 20) * (v - 20))), 6).alias("skill"), F.round(F.avg(E.crps_ensemble(v, members)), 5).alias("crps"))


@query("""WITH r AS (SELECT abs(value - 50) AS s, row_number() OVER (ORDER BY abs(value - 50)) AS i, count(*) OVER () AS n FROM events) SELECT min(s) AS quantile FROM r WHERE i >= least(ceil((n + 1) * 0.9), n)""")
def conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    return E.conformal_quantile(load(spark, d, "events").select(F.abs(F.col("value") - 50).alias("s")), "s", 0.1)


@query("""WITH f AS (SELECT p_size::DOUBLE AS x, min(p_retailprice) AS y FROM part WHERE p_size < 60 AND p_retailprice < 3000 GROUP BY p_size), g AS (SELECT x, min(y) OVER (ORDER BY x) AS y, coalesce(lead(x) OVER (ORDER BY x), 60) AS t FROM f) SELECT round(sum((t - x) * (3000 - y)), 3) AS hypervolume FROM g""")
def hypervolume(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return E.hypervolume2(x, "x", "y", (60.0, 3000.0)).select(F.round("hypervolume", 3).alias("hypervolume"))


@query("""WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), z AS (SELECT l_quantity - m AS z, l_extendedprice AS v, m FROM lineitem, m), s AS (SELECT count(*)::DOUBLE AS n, sum(z) AS s1, sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4, sum(v) AS t0, sum(z * v) AS t1, sum(z * z * v) AS t2, max(m) AS m FROM z),
    w AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d FROM s), c AS (SELECT m, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d AS p, (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d AS q,
    (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d AS r FROM w) SELECT round(p - q * m + r * m * m, 3) AS a, round(q - 2 * r * m, 4) AS b, round(r, 5) AS c FROM c""")
def polynomial_fit(spark: SparkSession, d: str) -> DataFrame:
    x = E.polyfit2(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return x.select(F.round("a", 3).alias("a"), F.round("b", 4).alias("b"), F.round("c", 5).alias("c"))


@query("""WITH h AS (SELECT 1.06 * stddev_samp(value) * power(count(value), -0.2) AS h, count(value) AS n FROM events), g AS (SELECT unnest([0.0, 25.0, 50.0, 100.0, 200.0])::DOUBLE AS x)
    SELECT x, round(sum(exp(-power((value - x) / h, 2) / 2) / sqrt(2 * pi())) / (max(n) * max(h)), 8) AS density, round(sum(CASE WHEN abs(value - x) <= h THEN 0.75 * (1 - power((value - x) / h, 2)) ELSE 0 END) / (max(n) * max(h)), 8) AS epanechnikov FROM events, h, g GROUP BY x""")
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    e, grid = load(spark, d, "events"), [0.0, 25.0, 50.0, 100.0, 200.0]
    x = E.kde(e, "value", grid).join(E.kde(e, "value", grid, "epanechnikov").withColumnRenamed("density", "epanechnikov"), "at")
    return x.select(F.col("at").alias("x"), F.round("density", 8).alias("density"), F.round("epanechnikov", 8).alias("epanechnikov"))


@query("""WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels), u AS (SELECT *, a + b AS r, a + c AS q, a + b + c + d AS n FROM t),
    k AS (SELECT *, unnest(range(greatest(0, r + q - n), least(r, q) + 1)) AS k FROM u), p AS (SELECT exp(lgamma(r + 1) - lgamma(k + 1) - lgamma(r - k + 1) + lgamma(n - r + 1) - lgamma(q - k + 1) - lgamma(n - r - q + k + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) AS p,
    exp(lgamma(r + 1) - lgamma(a + 1) - lgamma(r - a + 1) + lgamma(n - r + 1) - lgamma(q - a + 1) - lgamma(n - r - q + a + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) AS p0 FROM k), f AS (SELECT sum(CASE WHEN p <= p0 * (1 + 1e-7) THEN p ELSE 0 END) AS p FROM p)
    SELECT round(p, 6) AS p_value, round((n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2)) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM f, u""")
def exact_tables(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "labels")
    return E.fisher_exact(l, "quality", "toxic").crossJoin(E.chi2_yates(l, "quality", "toxic")).select(*rounded(p_value=F.col("p_value"), chi2=F.col("chi2")))


@query("""WITH m AS (SELECT avg(value) AS m, count(*)::DOUBLE AS n FROM events), s AS (SELECT max(n) AS n, avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4 FROM events, m), g AS (SELECT n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM s) SELECT round(n / 6 * (g1 * g1 + g2 * g2 / 4), 2) AS jarque_bera FROM g""")
def normality(spark: SparkSession, d: str) -> DataFrame:
    return E.dagostino(load(spark, d, "events"), "value").select(F.round("jarque_bera", 2).alias("jarque_bera"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vx, var_samp(l_discount) AS vy, covar_samp(l_quantity, l_discount) AS c FROM lineitem)
    SELECT round(sum(sqrt((vy * power(l_quantity - mx, 2) - 2 * c * (l_quantity - mx) * (l_discount - my) + vx * power(l_discount - my, 2)) / (vx * vy - c * c))) / count(*), 6) AS mean_distance FROM lineitem, s""")
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return E.mahalanobis2(load(spark, d, "lineitem"), "l_quantity", "l_discount").agg(F.round(F.avg("mahalanobis"), 6).alias("mean_distance"))


@query("""WITH g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) * sqrt(6) / pi() AS s FROM events GROUP BY ALL), e AS (SELECT avg(value - 100) AS m, var_samp(value) AS v, count(*) AS n FROM events WHERE value > 100)
    SELECT event_type, round(g.m - 0.5772156649015329 * s, 5) AS location, round(s, 5) AS scale, round((1 - e.m * e.m / v) / 2, 6) AS shape, round(e.m * (e.m * e.m / v + 1) / 2, 5) AS excess_scale, n FROM g, e""")
def extreme_fits(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    p = E.pareto_moments(e, "value", 100.0).withColumnRenamed("scale", "excess_scale")
    x = E.gumbel_moments(e, "value", ["event_type"]).crossJoin(F.broadcast(p))
    return x.select("event_type", F.round("location", 5).alias("location"), F.round("scale", 5).alias("scale"), F.round("shape", 6).alias("shape"), F.round("excess_scale", 5).alias("excess_scale"), "n")


@query(f"""WITH s AS ({SIGNAL}) SELECT vec_id, round(list_sum(v), 6) AS total, round(list_reduce(list_transform(v, lambda x: 1 + x / 10), lambda a, b: a * b), 6) AS product, round(list_avg(list_transform(v, lambda x: abs(x - list_avg(v)))), 6) AS mean_deviation FROM s""")
def compensated_sums(spark: SparkSession, d: str) -> DataFrame:
    from helioscope.functions.arrays import mean

    v = F.col("v")
    product = F.aggregate(F.transform(v, lambda x: 1 + x / 10), F.lit(1.0), lambda a, b: a * b)
    return signals(spark, d).withColumn("m", mean(v)).select("vec_id", *rounded(total=E.neumaier(v), product=product, mean_deviation=mean(F.transform(v, lambda x: F.abs(x - F.col("m"))))))


X = "l_quantity / 10"


@query(f"""WITH x AS (SELECT DISTINCT {X} AS x FROM lineitem) SELECT x, round(1 / (x * 0.5 * sqrt(2 * pi())) * exp(-power(ln(x) - 1, 2) / 0.5), 8) AS lognormal, round(1.5 / 2 * power(x / 2, 0.5) * exp(-power(x / 2, 1.5)), 8) AS weibull, round(1 / (pi() * 2 * (1 + power((x - 1) / 2, 2))), 8) AS cauchy,
    round(exp(lgamma(3) - lgamma(2.5)) / sqrt(5 * pi()) * power(1 + x * x / 5, -3), 8) AS student_t, round(exp(-x) * x, 8) AS gamma, round(1.5 * power(0.05, 1.5) / power(x, 2.5), 8) AS pareto, round(1 - exp(-power(x / 2, 1.5)), 8) AS weibull_cdf, round(0.5 + atan((x - 1) / 2) / pi(), 8) AS cauchy_cdf, round(x / (1 + x), 8) AS f_cdf FROM x""")
def distribution_values(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    D, C = S.distribution, S.cumulative
    cols = {"lognormal": D("lognormal", x, mean=1.0, sd=0.5), "weibull": D("weibull", x, shape=1.5, scale=2.0), "cauchy": D("cauchy", x, mean=1.0, scale=2.0), "student_t": D("student_t", x, df=5.0), "gamma": D("gamma", x, shape=2.0, scale=1.0), "pareto": D("pareto", x, low=0.05, shape=1.5), "weibull_cdf": C("weibull", x, shape=1.5, scale=2.0), "cauchy_cdf": C("cauchy", x, mean=1.0, scale=2.0), "f_cdf": C("f", x, d1=2.0, d2=2.0)}
    return load(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("x")).distinct().select("x", *(F.round(c, 8).alias(n) for n, c in cols.items()))
