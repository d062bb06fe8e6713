"""Hypothesis tests and rank statistics from grouped moments. P-values come from numpy formulas on the few rows that result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators.prefix import numbered, quantiles, running


def ranks(df: DataFrame, value: str, by: list[str] = (), name: str = "rank") -> DataFrame:
    """Average ranks, ties sharing their mean rank. Ranks are counted by distinct value first, so ties don't pile up in the window."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        return df.join(running(counts, value, ["_n"]).select(value, (F.col("run__n") - (F.col("_n") - 1) / 2).alias(name)), value)
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn(name, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranked, [*by, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    a = ranks(df.select(x, y), x, name="rx")
    return ranks(a, y, name="ry").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(tau, n): tau-b over the rows where both are given; null where all of x or of y are tied, n is 0 without rows.

    Distinct pairs are counted, and y becomes its place among the distinct ys.
    Two places first differ at one bit: below the same higher bits one has a
    zero there and the other a one. So each pair is written once for each bit,
    and in the order of (bit, higher bits, x) the ones meet the sum of the zeros
    before and after them. The rows are ranges of that order, so no group of
    equal bits is in one task. Sums are exact, of up to 38 digits.
    """
    t = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    places = numbered(t.select("y").distinct(), [F.col("y")], "place").select(F.col("y").alias("_y"), "place")
    bits = max(int(places.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]).bit_length(), 1)
    rows = t.join(places, F.col("y") == F.col("_y")).select("x", "place", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    one = F.expr("shiftright(place, bit) & 1") == 1
    c = rows.groupBy("bit", F.expr("shiftright(place, bit + 1)").alias("high"), "x").agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("zeros"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    r = running(c.withColumn("_key", F.struct("bit", "high", "x")), "_key", ["zeros"])
    g = r.groupBy("bit", "high").agg(
        F.sum((exact("ones") * exact("run_zeros")).cast("decimal(38,0)")).alias("met"), F.sum((exact("ones") * exact("zeros")).cast("decimal(38,0)")).alias("level"),
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.min(F.col("run_zeros") - F.col("zeros")).alias("start"),
    )
    # a one at x counts the zeros before it and, against it, those after: 2 * (run - start) - zeros at x - all zeros
    score = g.agg(F.sum((2 * F.col("met") - F.col("level") - (exact("ones") * (2 * exact("start") + exact("zeros")).cast("decimal(19,0)"))).cast("decimal(38,0)")).cast("double").alias("s"))
    ties = lambda c: t.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum((exact("m") * (exact("m") - 1)).cast("decimal(38,0)")).cast("double").alias(f"t{c}"))
    n = t.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    out = score.crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(n)
    total = F.col("n") * (F.col("n") - 1)
    return out.select((2 * F.col("s") / F.nullif(F.sqrt((total - F.col("tx")) * (total - F.col("ty"))), F.lit(0.0))).alias("tau"), "n")


def welch_t(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """t, degrees of freedom, and both means of two groups of unequal variances."""
    def of(g):
        x = F.when(F.col(group) == F.lit(g), F.col(value))
        return F.count(x), F.avg(x), F.var_samp(x)

    (n1, m1, v1), (n2, m2, v2) = of(first), of(second)
    one = df.agg(n1.alias("n1"), m1.alias("m1"), v1.alias("v1"), n2.alias("n2"), m2.alias("m2"), v2.alias("v2"))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return one.select(((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), (F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"), "m1", "m2")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F, degrees of freedom between and within."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.crossJoin(F.broadcast(t.select("mean"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"))
    x = t.crossJoin(between)
    return x.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence, degrees of freedom and Cramer's V of the table of two columns; cells that never occur count as zero."""
    t = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = t.groupBy(a).agg(F.sum("o").alias("ra")), t.groupBy(b).agg(F.sum("o").alias("rb"))
    n = t.agg(F.sum("o").alias("n"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    cells = t.join(ra, a).join(rb, b).crossJoin(F.broadcast(n))
    # sum (o - e)^2 / e = n * (sum o^2 / (ra * rb) - 1), so empty cells needn't be made
    x = cells.agg((F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))) - 1)).alias("chi2"), ((F.max("ka") - 1) * (F.max("kb") - 1)).alias("df"), F.max("n").alias("n"), F.least(F.max("ka"), F.max("kb")).alias("k"))
    return x.select("chi2", "df", F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1))).alias("cramers_v"))


def ks_two_sample(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Largest distance of two empirical distributions. Counted by distinct value before the window."""
    a, b = (F.sum(F.when(F.col(group) == F.lit(g), 1).otherwise(0)) for g in (first, second))
    c = df.where(F.col(group).isin(first, second)).groupBy(value).agg(a.alias("a"), b.alias("b"))
    d = running(c, value, ["a", "b"]).select(F.abs(F.col("run_a") / F.col("total_a") - F.col("run_b") / F.col("total_b")).alias("d"))
    return d.agg(F.max("d").alias("ks"))


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """U of the first group."""
    own = ranks(df.where(F.col(group).isin(first, second)).select(value, group), value)
    x = own.agg(F.sum(F.when(F.col(group) == F.lit(first), F.col("rank"))).alias("r"), F.sum(F.when(F.col(group) == F.lit(first), 1)).alias("n1"), F.sum(F.when(F.col(group) == F.lit(second), 1)).alias("n2"))
    return x.select((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n2")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H, without the correction for ties."""
    own = ranks(df.select(value, group), value)
    g = own.groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    x = g.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"))
    return x.select((12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)).alias("h"), (F.col("k") - 1).alias("df"))


def gini(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Gini coefficient of positive values by key, from ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    own = df.where(F.col(value) > 0).withColumn("_i", F.row_number().over(w))
    n = F.count(F.lit(1))
    return own.groupBy(*by).agg((2 * F.sum(F.col("_i") * F.col(value)) / (n * F.sum(value)) - (n + 1) / n).alias("gini"), n.alias("n"))


def mode(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Most frequent value by key, ties to the least."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*by, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))


def median_abs_deviation(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    m = quantiles(df, value, {"median": 0.5}, by)
    off = df.select(*by, value).join(m, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("_off"))
    return m.join(quantiles(off, "_off", {"mad": 0.5}, by), by)


def winsorized_mean(df: DataFrame, value: str, limit: float, by: list[str]) -> DataFrame:
    """Mean after values beyond the limit and 1 - limit quantiles are moved to them."""
    q = quantiles(df, value, {"_lo": limit, "_hi": 1 - limit}, by)
    return df.join(q, by).groupBy(*by).agg(F.avg(F.least(F.greatest(F.col(value), "_lo"), "_hi")).alias("winsorized_mean"))


def winsorized_variance(df: DataFrame, value: str, limit: float, by: list[str], ddof: int = 1) -> DataFrame:
    """Variance after values beyond the limit and 1 - limit quantiles are moved to them. Null values and keys are left out."""
    q = quantiles(df, value, {"_lo": limit, "_hi": 1 - limit}, by)
    moved = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), "_lo"), "_hi"))
    return df.join(q, by).groupBy(*by).agg((F.var_samp if ddof else F.var_pop)(moved).alias("winsorized_variance"))


def mean_abs_deviation(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean distance of a key's values to their mean. Null values and keys are left out."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    return df.select(*by, value).join(m, by).groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias("mean_abs_deviation"))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_one_sample(df: DataFrame, value: str, mean: float) -> DataFrame:
    x = F.col(value)
    return df.agg(((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"), (F.count(x) - 1).alias("df"))


def t_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return t_one_sample(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("_d")), "_d", 0.0)


def levene(df: DataFrame, value: str, group: str, centre: str = "median") -> DataFrame:
    """Levene's F of absolute deviations from the group's mean, or from its median (Brown-Forsythe)."""
    m = df.groupBy(group).agg(F.avg(value).alias("_c")) if centre == "mean" else quantiles(df, value, {"_c": 0.5}, [group])
    return anova(df.join(m, group).withColumn("_z", F.abs(F.col(value) - F.col("_c"))), "_z", group)


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    """Bartlett's statistic of equal variances, and its degrees of freedom."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.var_samp(value).alias("v"))
    f = F.col("n") - 1
    x = g.agg(F.sum(f).alias("f"), F.sum(f * F.col("v")).alias("s"), F.sum(f * F.ln("v")).alias("l"), F.sum(1 / f).alias("r"), F.count(F.lit(1)).alias("k"))
    c = 1 + (F.col("r") - 1 / F.col("f")) / (3 * (F.col("k") - 1))
    return x.select(((F.col("f") * F.ln(F.col("s") / F.col("f")) - F.col("l")) / c).alias("bartlett"), (F.col("k") - 1).alias("df"))


def chi2_goodness(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Chi-square of counts of a key against expected shares (key, share); keys that never occur count as zero."""
    o = df.groupBy(key).agg(F.count(F.lit(1)).alias("o"))
    x = expected.join(o, key, "left").select("share", F.coalesce("o", F.lit(0)).alias("o"))
    x = x.crossJoin(F.broadcast(o.agg(F.sum("o").alias("n"))))
    e = F.col("share") * F.col("n")
    return x.agg(F.sum(F.pow(F.col("o") - e, 2) / e).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def two_by_two(df: DataFrame, exposed: str, event: str) -> DataFrame:
    """Odds ratio and relative risk of two boolean columns."""
    n = lambda a, b: F.count_if((F.col(exposed) == a) & (F.col(event) == b)).cast("double")
    x = df.agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    return x.select(F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")).alias("odds_ratio"), F.try_divide(F.col("a") / (F.col("a") + F.col("b")), F.col("c") / (F.col("c") + F.col("d"))).alias("relative_risk"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sums of ranks of positive and negative differences, without zeros."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").select("_d", F.abs("_d").alias("_a"))
    r = ranks(d, "_a")
    return r.agg(F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's statistic of treatments ranked within blocks."""
    w = Window.partitionBy(block)
    rank = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(block, value)) - 1) / 2
    r = df.select(block, treatment, rank.alias("r"))
    s = r.groupBy(treatment).agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.count(F.lit(1)).alias("k"))
    x = s.crossJoin(r.agg(F.count_distinct(block).alias("n")))
    k, n = F.col("k"), F.col("n")
    return x.select((12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)).alias("friedman"), (k - 1).alias("df"))


def icc1(df: DataFrame, target: str, value: str) -> DataFrame:
    """Intraclass correlation of the one-way model; every target has equally many ratings."""
    g = df.groupBy(target).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("k"))
    x = g.agg((F.max("k") * F.var_samp("m")).alias("between"), F.avg("v").alias("within"), F.max("k").alias("k"))
    return x.select(((F.col("between") - F.col("within")) / (F.col("between") + (F.col("k") - 1) * F.col("within"))).alias("icc"))


def covariance_matrix(df: DataFrame, columns: list[str], ddof: int = 1) -> DataFrame:
    """(a, b, cov, corr) of all pairs of columns, from one aggregate."""
    from helioscope.functions.aggregates import covariance, pearson

    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), covariance(F.col(a), F.col(b), ddof).alias("cov"), pearson(F.col(a), F.col(b)).alias("corr")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
