"""Scores of clusterings, forecasts, distributions and fronts, each from grouped sums; no pairs of rows are formed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioscope.functions import arrays as V
from helioscope.operators.metrics import confusion


def _centres(points: DataFrame, label: str, x: str) -> DataFrame:
    """(label, n, centre) of clusters of vectors."""
    cells = points.select(label, F.posexplode(x).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return cells.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))


def _spread(points: DataFrame, label: str, x: str) -> DataFrame:
    """(label, n, centre, scatter, inertia): mean distance and sum of squared distances to the centre."""
    c = _centres(points, label, x)
    d = points.join(c, label).withColumn("_d", V.squared_euclidean(F.col(x).cast("array<double>"), F.col("centre")))
    return c.join(d.groupBy(label).agg(F.avg(F.sqrt("_d")).alias("scatter"), F.sum("_d").alias("inertia")), label)


def davies_bouldin(points: DataFrame, label: str, x: str) -> DataFrame:
    """Mean over clusters of the worst ratio of scatters to the distance of centres. Pairs are those of clusters."""
    s = _spread(points, label, x)
    a, b = s.alias("a"), s.alias("b")
    r = (F.col("a.scatter") + F.col("b.scatter")) / V.euclidean(F.col("a.centre"), F.col("b.centre"))
    worst = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(F.col(f"a.{label}").alias("k")).agg(F.max(r).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, label: str, x: str) -> DataFrame:
    """Ratio of the variance between clusters to that within them."""
    s = _spread(points, label, x)
    whole = _centres(points.withColumn("_all", F.lit(1)), "_all", x).select(F.col("centre").alias("m"), F.col("n").alias("total"))
    b = s.crossJoin(F.broadcast(whole)).withColumn("_b", F.col("n") * V.squared_euclidean(F.col("centre"), F.col("m")))
    t = b.agg(F.sum("_b").alias("b"), F.sum("inertia").alias("w"), F.count(F.lit(1)).alias("k"), F.max("total").alias("n"))
    return t.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def information_criteria(points: DataFrame, label: str, x: str) -> DataFrame:
    """AIC and BIC of spherical clusters of one variance."""
    s = _spread(points, label, x).agg(F.sum("inertia").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max(F.size("centre")).alias("d"))
    n, d = F.col("n"), F.col("d")
    log = -n * d / 2 * (F.ln(2 * math.pi * F.col("w") / (n * d)) + 1)
    free = F.col("k") * d + 1
    return s.select((2 * free - 2 * log).alias("aic"), (free * F.ln(n) - 2 * log).alias("bic"), (F.col("w") / n).alias("distortion"))


def variation_of_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information, its normalised form and the variation of information of two labellings."""
    t = confusion(df, a, b)
    n = t.agg(F.sum("n").cast("double").alias("s"))
    cells = t.join(t.groupBy("truth").agg(F.sum("n").alias("a")), "truth").join(t.groupBy("predicted").agg(F.sum("n").alias("b")), "predicted").crossJoin(F.broadcast(n))
    p, pa, pb = F.col("n") / F.col("s"), F.col("a") / F.col("s"), F.col("b") / F.col("s")
    x = cells.agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), (-F.sum(p * F.ln(pa))).alias("ha"), (-F.sum(p * F.ln(pb))).alias("hb"))
    return x.select(F.col("mi").alias("mutual_information"), (2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), (F.col("ha") + F.col("hb") - 2 * F.col("mi")).alias("variation"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Of two arrays of probabilities, in nats."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    kl = lambda a: F.aggregate(F.zip_with(a, m, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return (kl(p) + kl(q)) / 2


def cross_entropy(df: DataFrame, truth: str, scores: str, weights: dict | None = None) -> DataFrame:
    """Mean of -ln of the softmax share of the true class (from zero); weights by class."""
    p = F.element_at(V.softmax(F.col(scores)), F.col(truth) + 1)
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col(truth) == k, float(v)).otherwise(w)
    return df.agg((F.sum(-F.ln(p) * w) / F.sum(w)).alias("cross_entropy"))


def crps_normal(y: Column, mean: Column, sd: Column) -> Column:
    """Continuous ranked probability score of a normal forecast."""
    from helioscope.functions.special import normal_cdf, normal_pdf

    z = (y - mean) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def crps_ensemble(y: Column, members: Column) -> Column:
    """CRPS of an array of members: mean distance to the truth less half the mean distance of members, by their ranks."""
    n = F.size(members)
    s = F.array_sort(members)
    off = F.aggregate(members, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    spread = F.aggregate(F.transform(s, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x)
    return off - spread / (n * n)


def winkler(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Interval score: width, and 2 / alpha times what lies outside."""
    return high - low + F.when(y < low, 2 / alpha * (low - y)).when(y > high, 2 / alpha * (y - high)).otherwise(0.0)


def skill(score: Column, reference: Column) -> Column:
    return 1 - F.try_divide(score, reference)


def conformal_quantile(df: DataFrame, score: str, alpha: float) -> DataFrame:
    """The score of rank ceil((n + 1)(1 - alpha)), the greatest if there are fewer: counted by value."""
    from helioscope.operators.prefix import running

    c = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    r = running(c, score, ["_n"])
    rank = F.least(F.ceil((F.col("total__n") + 1) * (1 - alpha)), F.col("total__n"))
    return r.where(F.col("run__n") >= rank).agg(F.min(score).alias("quantile"))


def hypervolume2(front: DataFrame, x: str, y: str, top: tuple[float, float]) -> DataFrame:
    """Area between the minimal points of two costs and a reference corner: counted by x, the least y so far by ranges."""
    from pyspark.sql import Window

    f = front.where((F.col(x) < top[0]) & (F.col(y) < top[1])).groupBy(F.col(x).alias("x")).agg(F.min(y).alias("y"))
    n = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from helioscope.operators.graph import cut

    parts = cut(f.repartitionByRange(n, "x").withColumn("_p", F.spark_partition_id()))
    low = parts.groupBy("_p").agg(F.min("y").alias("_l"), F.min("x").alias("_x"))
    w = Window.orderBy("_p")  # one row a range
    ends = low.select("_p", F.min("_l").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_x").over(w).alias("_next"))
    own = Window.partitionBy("_p").orderBy("x")
    g = parts.join(F.broadcast(ends), "_p").withColumns({"_y": F.least(F.min("y").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_before"), "_to": F.coalesce(F.lead("x").over(own), "_next", F.lit(float(top[0])))})
    return g.agg(F.sum((F.col("_to") - F.col("x")) * (top[1] - F.col("_y"))).alias("hypervolume"))


def polyfit2(df: DataFrame, x: str, y: str) -> DataFrame:
    """a + b x + c x^2 by least squares, from one aggregate of centred power sums and Cramer's rule."""
    m = df.agg(F.avg(x).alias("_m"))
    z, v = F.col(x) - F.col("_m"), F.col(y)
    s = df.crossJoin(F.broadcast(m)).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(z).alias("s1"), F.sum(z * z).alias("s2"), F.sum(z * z * z).alias("s3"), F.sum(z * z * z * z).alias("s4"), F.sum(v).alias("t0"), F.sum(z * v).alias("t1"), F.sum(z * z * v).alias("t2"), F.max("_m").alias("m"))
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "m")}
    det = lambda a, b, d, e, f, g, h, i, j: a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)
    whole = det(c["n"], c["s1"], c["s2"], c["s1"], c["s2"], c["s3"], c["s2"], c["s3"], c["s4"])
    p = det(c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"], c["s3"], c["s4"]) / whole
    q = det(c["n"], c["t0"], c["s2"], c["s1"], c["t1"], c["s3"], c["s2"], c["t2"], c["s4"]) / whole
    r = det(c["n"], c["s1"], c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"]) / whole
    return s.select((p - q * c["m"] + r * c["m"] * c["m"]).alias("a"), (q - 2 * r * c["m"]).alias("b"), r.alias("c"))


def kde(df: DataFrame, x: str, grid: list[float], kernel: str = "gaussian") -> DataFrame:
    """(at, density) at grid points, with the bandwidth 1.06 sd n^(-1/5). Each row meets every grid point once, in one aggregate."""
    s = df.agg((1.06 * F.stddev_samp(x) * F.pow(F.count(x).cast("double"), F.lit(-0.2))).alias("_h"), F.count(x).alias("_n"))
    z = lambda g: (F.col(x) - g) / F.col("_h")
    k = {"gaussian": lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi), "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0), "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0)}[kernel]
    one = df.crossJoin(F.broadcast(s)).agg(F.array(*[F.struct(F.lit(float(g)).alias("at"), (F.sum(k(z(g))) / (F.max("_n") * F.max("_h"))).alias("density")) for g in grid]).alias("g"))
    return one.select(F.inline("g"))


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided p of two 0/1 columns: the sum of all tables' probabilities that aren't greater than this one's."""
    from helioscope.functions.special import gammaln

    n = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double")
    t = df.agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    r, c, s = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    choose = lambda m, k: gammaln(m + 1) - gammaln(k + 1) - gammaln(m - k + 1)
    mass = lambda k: F.exp(choose(r, k) + choose(s - r, c - k) - choose(s, c))
    ks = t.select("*", F.explode(F.sequence(F.greatest(F.lit(0.0), r + c - s).cast("bigint"), F.least(r, c).cast("bigint"))).alias("k"))
    p = ks.select(mass(F.col("k").cast("double")).alias("p"), mass(F.col("a")).alias("p0"))
    return p.agg(F.sum(F.when(F.col("p") <= F.col("p0") * (1 + 1e-7), F.col("p")).otherwise(0.0)).alias("p_value"))


def dagostino(df: DataFrame, x: str) -> DataFrame:
    """K-squared of skewness and kurtosis, and the Jarque-Bera statistic."""
    s = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(u) / F.sqrt(F.ln(F.sqrt(w2)))
    v = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + v * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return s.select((z1 * z1 + z2 * z2).alias("k2"), (n / 6 * (g1 * g1 + g2 * g2 / 4)).alias("jarque_bera"))


def chi2_yates(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of two 0/1 columns with Yates' correction."""
    n = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double")
    t = df.agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    p, q, r, s = (F.col(k) for k in "abcd")
    m = p + q + r + s
    gap = F.greatest(F.abs(p * s - q * r) - m / 2, F.lit(0.0))
    return t.select((m * gap * gap / ((p + q) * (r + s) * (p + r) * (q + s))).alias("chi2"))


def mahalanobis2(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with the distance of (x, y) from their mean by their covariance."""
    s = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_c"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    q = (F.col("_vy") * dx * dx - 2 * F.col("_c") * dx * dy + F.col("_vx") * dy * dy) / (F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c"))
    return df.crossJoin(F.broadcast(s)).withColumn("mahalanobis", F.sqrt(q)).drop("_mx", "_my", "_vx", "_vy", "_c")


def gumbel_moments(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """(location, scale) of a Gumbel distribution by moments."""
    g = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    scale = F.col("_s") * math.sqrt(6) / math.pi
    return g.select(*by, (F.col("_m") - 0.5772156649015329 * scale).alias("location"), scale.alias("scale"))


def pareto_moments(df: DataFrame, x: str, threshold: float) -> DataFrame:
    """(shape, scale, n) of a generalized Pareto distribution of the excesses by moments."""
    e = df.where(F.col(x) > threshold).agg(F.avg(F.col(x) - threshold).alias("m"), F.var_samp(F.col(x)).alias("v"), F.count(F.lit(1)).alias("n"))
    r = F.col("m") * F.col("m") / F.col("v")
    return e.select(((1 - r) / 2).alias("shape"), (F.col("m") * (r + 1) / 2).alias("scale"), "n")


def neumaier(values: Column) -> Column:
    """Compensated sum of an array."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, zero, step, lambda a: a["s"] + a["c"])
