"""Statistics as aggregate columns: the same expression works grouped, over a window and over a whole table.

Nulls are left out. NaN counts as a value; turn it into null at ingest (`clean`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def variance(x: Column, ddof: int = 1) -> Column:
    """Sum of squared deviations over n - ddof; null where n <= ddof."""
    if ddof in (0, 1):
        out = F.var_samp(x) if ddof else F.var_pop(x)
        return F.when(F.count(x) > ddof, out)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def std(x: Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(x, ddof))


def quantile(x: Column, q: float | list[float]) -> Column:
    """Exact quantile, linear between neighbours at q * (n - 1)."""
    for v in q if isinstance(q, list) else [q]:
        if not 0 <= v <= 1:
            raise ValueError(f"a quantile of {v} is outside 0 to 1")
    return F.percentile(x, q)


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def iqr(x: Column) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def describe(x: Column) -> dict[str, Column]:
    """count, mean, std, variance, min, quartiles, max, range, skewness and kurtosis."""
    return {
        "n": F.count(x), "mean": F.avg(x), "std": std(x), "variance": variance(x), "min": F.min(x), "q25": quantile(x, 0.25), "median": median(x),
        "q75": quantile(x, 0.75), "max": F.max(x), "range": F.max(x) - F.min(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
    }


def moment(x: Column, mean: Column, order: int) -> Column:
    """Central moment about a mean that is already a column (from a window or a join)."""
    return F.avg(F.pow(x - mean, order))


def raw_moment(x: Column, order: int) -> Column:
    return F.avg(F.pow(x, F.lit(order)))


def gmean(x: Column) -> Column:
    """Geometric mean; null unless all values are positive."""
    return F.when(F.min(x) > 0, F.exp(F.avg(F.ln(x))))


def hmean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.count(x) / F.sum(1 / x))


def weighted_mean(x: Column, w: Column) -> Column:
    w = F.when(x.isNotNull(), w)
    return F.sum(x * w) / F.sum(w)


def sem(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def coef_variation(x: Column) -> Column:
    return F.stddev_samp(x) / F.avg(x)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def energy(x: Column) -> Column:
    return F.sum(x * x)


def boxplot(x: Column) -> dict[str, Column]:
    """Quartiles, and fences at 1.5 interquartile ranges."""
    q1, q3 = quantile(x, 0.25), quantile(x, 0.75)
    return {"q1": q1, "median": median(x), "q3": q3, "low_fence": q1 - 1.5 * (q3 - q1), "high_fence": q3 + 1.5 * (q3 - q1)}


def entropy(p: Column) -> Column:
    """Shannon entropy (nats) of rows of probabilities; zeros add nothing."""
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def kl_divergence(p: Column, q: Column) -> Column:
    return F.sum(F.when(p > 0, p * F.ln(p / q)).otherwise(0.0))


def cross_entropy(p: Column, q: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.ln(q)).otherwise(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where either side is constant."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


def covariance(x: Column, y: Column, ddof: int = 1) -> Column:
    if ddof in (0, 1):
        return F.covar_samp(x, y) if ddof else F.covar_pop(x, y)
    n = F.regr_count(y, x)
    return F.covar_pop(x, y) * n / (n - ddof)


def linear_fit(x: Column, y: Column) -> dict[str, Column]:
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x), "n": F.regr_count(y, x)}


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def pinball(y: Column, p: Column, q: float) -> Column:
    """Quantile loss."""
    return F.avg(F.when(y >= p, (y - p) * q).otherwise((p - y) * (1 - q)))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y > 0.5, F.ln(p)).otherwise(F.ln(1 - p)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))
