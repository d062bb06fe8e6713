"""Special functions as column formulas (no Python on the data path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation with g = 7 (fixed values).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def expit(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), one at zero."""
    y = x * math.pi
    return F.when(x == 0, 1.0).otherwise(F.sin(y) / y)


def gammaln(x: Column) -> Column:
    """Logarithm of gamma for positive x."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def gamma(x: Column) -> Column:
    """Gamma, by reflection below one half."""
    return F.when(x >= 0.5, F.exp(gammaln(x))).otherwise(math.pi / (F.sin(x * math.pi) * F.exp(gammaln(1 - x))))


def betaln(a: Column, b: Column) -> Column:
    return gammaln(a) + gammaln(b) - gammaln(a + b)


def comb(n: Column, k: Column) -> Column:
    return F.round(F.exp(gammaln(n + 1) - gammaln(k + 1) - gammaln(n - k + 1)))


def _poly(coefs: list[float], x: Column) -> Column:
    """Sum of coefs[n] * x^n by Horner's rule: the expression grows with the number of terms only."""
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def _iterate(start: Column, steps: int, step) -> Column:
    """start, step(start), ... `steps` times; the lambda variable keeps the expression from repeating itself."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: step(s))


def erf(x: Column, terms: int = 60) -> Column:
    """Error function: its power series up to 3 in size, a continued fraction beyond."""
    a = F.abs(x)
    near = a * _poly([(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(terms)], F.least(a * a, F.lit(9.0))) * (2 / math.sqrt(math.pi))
    tail = a
    for k in range(40, 0, -1):
        tail = a + (k / 2) / tail
    far = 1 - F.exp(-a * a) / (tail * math.sqrt(math.pi))
    return F.signum(x) * F.when(a < 3, near).otherwise(far)


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return 0.5 * (1 + erf((x - mean) / (sd * math.sqrt(2))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def digamma(x: Column) -> Column:
    """For positive x: recurrence up to 6, then the asymptotic series."""
    shift = F.lit(0.0)
    for k in range(6):
        shift = shift - 1 / (x + k)
    z = x + 6
    s = 1 / (z * z)
    return shift + F.ln(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


def beta(a: Column, b: Column) -> Column:
    return F.exp(betaln(a, b))


def factorial(n: Column) -> Column:
    return F.round(F.exp(gammaln(n + 1)))


def perm(n: Column, k: Column) -> Column:
    return F.round(F.exp(gammaln(n + 1) - gammaln(n - k + 1)))


def erfinv(y: Column, steps: int = 3) -> Column:
    """An approximation with logarithms, then Newton steps."""
    a = 0.147
    t = F.ln(1 - y * y)
    u = 2 / (math.pi * a) + t / 2
    first = F.signum(y) * F.sqrt(F.sqrt(u * u - t / a) - u)
    return _iterate(first, steps, lambda x: x - (erf(x) - y) / (2 / math.sqrt(math.pi) * F.exp(-x * x)))


def normal_quantile(p: Column) -> Column:
    return math.sqrt(2) * erfinv(2 * p - 1)


def lambert_w(x: Column, steps: int = 8) -> Column:
    """Principal branch for x >= 0, by Halley steps from log1p."""
    def halley(w: Column) -> Column:
        f = w * F.exp(w) - x
        return w - f / (F.exp(w) * (w + 1) - (w + 2) * f / (2 * w + 2))

    return _iterate(F.log1p(x), steps, halley)


def _agm(m: Column, steps: int = 6) -> Column:
    """struct: arithmetic-geometric mean for parameter m, and the sum that the second integral needs."""
    start = F.struct(F.lit(1.0).alias("a"), F.sqrt(1 - m).alias("b"), (m / 2).alias("total"), F.lit(0.5).cast("double").alias("weight"))

    def step(s: Column) -> Column:
        c = (s["a"] - s["b"]) / 2
        return F.struct(((s["a"] + s["b"]) / 2).alias("a"), F.sqrt(s["a"] * s["b"]).alias("b"), (s["total"] + s["weight"] * 2 * c * c).alias("total"), (s["weight"] * 2).alias("weight"))

    return _iterate(start, steps, step)


def ellipk(m: Column) -> Column:
    return math.pi / (2 * _agm(m)["a"])


def ellipe(m: Column) -> Column:
    s = _agm(m)
    return math.pi / (2 * s["a"]) * (1 - s["total"])


def bessel_j0(x: Column, terms: int = 40) -> Column:
    """Power series, for sizes up to about 12."""
    return _poly([(-1) ** k / (4.0**k * math.factorial(k) ** 2) for k in range(terms)], x * x)


def bessel_i0(x: Column, terms: int = 40) -> Column:
    return _poly([1 / (4.0**k * math.factorial(k) ** 2) for k in range(terms)], x * x)


def safe_divide(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(default))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def safe_pow(base: Column, exponent: Column) -> Column:
    """base ** exponent; null where that is no finite real number."""
    whole = exponent == F.floor(exponent)
    return _finite(F.when(((base > 0) | ((base == 0) & (exponent >= 0)) | ((base < 0) & whole)), F.pow(base, exponent)))


def safe_exp(x: Column) -> Column:
    """Null on overflow."""
    return _finite(F.exp(x))


def safe_normalize(x: Column, norm: Column) -> Column:
    """x / norm; null for a norm of zero and where the result isn't finite."""
    return _finite(F.try_divide(x, norm))


def distribution(name: str, x: Column, **p: float) -> Column:
    """Densities (or masses) by name."""
    lit = {k: F.lit(float(v)) for k, v in p.items()}
    if name == "normal":
        return normal_pdf(x, p.get("mean", 0.0), p.get("sd", 1.0))
    if name == "exponential":
        return F.when(x >= 0, lit["rate"] * F.exp(-lit["rate"] * x)).otherwise(0.0)
    if name == "uniform":
        return F.when((x >= p["low"]) & (x <= p["high"]), 1 / (p["high"] - p["low"])).otherwise(0.0)
    if name == "gamma":
        return F.when(x > 0, F.exp((p["shape"] - 1) * F.ln(x) - x / p["scale"] - math.lgamma(p["shape"]) - p["shape"] * math.log(p["scale"]))).otherwise(0.0)
    if name == "beta":
        norm = math.lgamma(p["a"]) + math.lgamma(p["b"]) - math.lgamma(p["a"] + p["b"])
        return F.when((x > 0) & (x < 1), F.exp((p["a"] - 1) * F.ln(x) + (p["b"] - 1) * F.ln(1 - x) - norm)).otherwise(0.0)
    if name == "lognormal":
        return F.when(x > 0, normal_pdf(F.ln(x), p.get("mean", 0.0), p.get("sd", 1.0)) / x).otherwise(0.0)
    if name == "laplace":
        return F.exp(-F.abs(x - p["mean"]) / p["scale"]) / (2 * p["scale"])
    if name == "logistic":
        e = F.exp(-F.abs(x - p["mean"]) / p["scale"])
        return e / (p["scale"] * (1 + e) * (1 + e))
    if name == "cauchy":
        z = (x - p["mean"]) / p["scale"]
        return 1 / (math.pi * p["scale"] * (1 + z * z))
    if name == "weibull":
        return F.when(x >= 0, p["shape"] / p["scale"] * F.pow(x / p["scale"], F.lit(p["shape"] - 1)) * F.exp(-F.pow(x / p["scale"], F.lit(p["shape"])))).otherwise(0.0)
    if name == "pareto":
        return F.when(x >= p["low"], p["shape"] * F.pow(F.lit(p["low"]), F.lit(p["shape"])) / F.pow(x, F.lit(p["shape"] + 1))).otherwise(0.0)
    if name == "poisson":
        return F.exp(x * math.log(p["rate"]) - p["rate"] - gammaln(x + 1))
    if name == "binomial":
        n = p["n"]
        return F.exp(math.lgamma(n + 1) - gammaln(x + 1) - gammaln(n - x + 1) + x * math.log(p["p"]) + (n - x) * math.log(1 - p["p"]))
    if name == "geometric":
        return p["p"] * F.pow(F.lit(1 - p["p"]), x - 1)
    if name == "student_t":
        v = p["df"]
        return math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * F.pow(1 + x * x / v, F.lit(-(v + 1) / 2))
    if name == "chi2":
        return distribution("gamma", x, shape=p["df"] / 2, scale=2.0)
    raise ValueError(f"no distribution {name}")


def beta_inc(a: float, b: float, x: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta function, by its power series about the nearer end."""

    def series(p: float, q: float, y: Column) -> Column:
        front = F.exp(p * F.ln(y) + q * F.ln(1 - y) - math.log(p) - (math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)))
        coefs = [1.0]
        for n in range(terms):
            coefs.append(coefs[-1] * (p + q + n) / (p + 1 + n))
        return front * F.aggregate(F.array(*[F.lit(c) for c in reversed(coefs)]), F.lit(0.0), lambda s, c: s * y + c)

    turn = (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < turn, series(a, b, x)).otherwise(1 - series(b, a, 1 - x))


def cumulative(name: str, x: Column, **p: float) -> Column:
    """Distribution functions by name."""
    if name == "normal":
        return normal_cdf(x, p.get("mean", 0.0), p.get("sd", 1.0))
    if name == "lognormal":
        return F.when(x > 0, normal_cdf(F.ln(x), p.get("mean", 0.0), p.get("sd", 1.0))).otherwise(0.0)
    if name == "exponential":
        return F.when(x > 0, 1 - F.exp(-p["rate"] * x)).otherwise(0.0)
    if name == "uniform":
        return F.least(F.greatest((x - p["low"]) / (p["high"] - p["low"]), F.lit(0.0)), F.lit(1.0))
    if name == "weibull":
        return F.when(x > 0, 1 - F.exp(-F.pow(x / p["scale"], F.lit(p["shape"])))).otherwise(0.0)
    if name == "pareto":
        return F.when(x > p["low"], 1 - F.pow(p["low"] / x, F.lit(p["shape"]))).otherwise(0.0)
    if name == "logistic":
        return expit((x - p["mean"]) / p["scale"])
    if name == "laplace":
        z = (x - p["mean"]) / p["scale"]
        return F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2)
    if name == "cauchy":
        return 0.5 + F.atan((x - p["mean"]) / p["scale"]) / math.pi
    if name == "beta":
        return beta_inc(p["a"], p["b"], x)
    if name == "f":
        return F.when(x > 0, beta_inc(p["d1"] / 2, p["d2"] / 2, p["d1"] * x / (p["d1"] * x + p["d2"]))).otherwise(0.0)
    if name == "student_t":
        tail = beta_inc(p["df"] / 2, 0.5, p["df"] / (p["df"] + x * x)) / 2
        return F.when(x > 0, 1 - tail).otherwise(tail)
    raise ValueError(f"no distribution function {name}")


def inv_boxcox(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(lam * y + 1, F.lit(1 / lam))


def bessel_j1(x: Column, terms: int = 40) -> Column:
    """Power series, for sizes up to about 12."""
    return x / 2 * _poly([(-1) ** k / (4.0**k * math.factorial(k) * math.factorial(k + 1)) for k in range(terms)], x * x)


def bessel_i1(x: Column, terms: int = 40) -> Column:
    return x / 2 * _poly([1 / (4.0**k * math.factorial(k) * math.factorial(k + 1)) for k in range(terms)], x * x)


def struve_h0(x: Column, terms: int = 40) -> Column:
    """Power series, for sizes up to about 12."""
    return x / 2 * _poly([(-1) ** k / (4.0**k * math.gamma(k + 1.5) ** 2) for k in range(terms)], x * x)


def zernike_radial(n: int, m: int, r: Column) -> Column:
    """Radial polynomial of degree n and order m, of one parity."""
    out = F.lit(0.0)
    for k in range((n - m) // 2 + 1):
        out = out + (-1) ** k * math.comb(n - k, k) * math.comb(n - 2 * k, (n - m) // 2 - k) * F.pow(r, F.lit(n - 2 * k))
    return out


def dawson(x: Column, terms: int = 80) -> Column:
    """Power series times exp(-x^2), for sizes up to about 5."""
    return F.exp(-x * x) * x * _poly([1 / (math.factorial(k) * (2 * k + 1)) for k in range(terms)], x * x)
