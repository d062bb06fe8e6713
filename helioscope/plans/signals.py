"""Transforms, filters and windows over embeddings as signals of 64 values, and matrices of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.functions import matrices as M
from helioscope.functions import signals as S
from helioscope.plans.registry import query, rounded
from helioscope.session import load

SIGNAL = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


def signals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def sums(x: Column) -> Column:
    """Values weighted by place, so that every one and its place count."""
    return F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)


def kernel(body: str, of: str = "v", n: str = "64", out: str = "64") -> str:
    """SQL: sum over k of (k + 1) times sum over i of value i times the kernel."""
    return f"list_sum(list_transform(range(0, {out}), lambda k: (k + 1) * list_sum(list_transform(range(0, {n}), lambda i: {of}[i + 1] * ({body})))))"


@query(f"""WITH s AS ({SIGNAL}) SELECT vec_id, round({kernel('cos(2 * pi() * i * k / 64)')}, 4) + 0 AS fft_re, round({kernel('-sin(2 * pi() * i * k / 64)')}, 4) + 0 AS fft_im, round({kernel('cos(2 * pi() * i * k / 64)', out='33')}, 4) + 0 AS rfft_re,
    round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * v[k + 1])), 4) + 0 AS back, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * v[k + 1])), 4) + 0 AS real_back FROM s""")
def fourier_transforms(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).withColumns({"f": S.fft(F.col("v")), "r": S.rfft(F.col("v"))})
    x = x.withColumns({"b": S.ifft(F.col("f.re"), F.col("f.im")), "c": S.irfft(F.col("r.re"), F.col("r.im"), 64)})
    return x.select("vec_id", *(((F.round(sums(c), 4) + 0).alias(n)) for n, c in {"fft_re": F.col("f.re"), "fft_im": F.col("f.im"), "rfft_re": F.col("r.re"), "back": F.col("b.re"), "real_back": F.col("c")}.items()))


def transforms(x: DataFrame, names: dict[str, Column]) -> DataFrame:
    return x.select("vec_id", *((F.round(sums(c), 4) + 0).alias(n) for n, c in names.items()))


@query(f"""WITH s AS ({SIGNAL}) SELECT vec_id, round({kernel('2 * cos(pi() * (2 * i + 1) * k / 128)')}, 4) + 0 AS dct, round({kernel('2 * sin(pi() * (2 * i + 1) * (k + 1) / 128)')}, 4) + 0 AS dst,
    round({kernel('CASE WHEN i = 0 THEN 0.5 ELSE cos(pi() * i * (2 * k + 1) / 128) END / 64')}, 4) + 0 AS idct, round({kernel('sin(pi() * (i + 1) * (2 * k + 1) / 128) * CASE WHEN i = 63 THEN 0.5 ELSE 1 END / 64')}, 4) + 0 AS idst FROM s""")
def cosine_sine_transforms(spark: SparkSession, d: str) -> DataFrame:
    return transforms(signals(spark, d), {n: S.transform(F.col("v"), n) for n in ("dct", "dst", "idct", "idst")})


LAPPED, UNLAPPED = "pi() / 32 * (i + 0.5 + 16) * (k + 0.5)", "pi() / 64 * (k + 0.5 + 32) * (i + 0.5)"


@query(f"""WITH s AS ({SIGNAL}) SELECT vec_id, round({kernel('cos(2 * pi() * i * k / 64) + sin(2 * pi() * i * k / 64)')}, 4) + 0 AS dht, round({kernel('(cos(2 * pi() * i * k / 64) + sin(2 * pi() * i * k / 64)) / 64')}, 4) + 0 AS idht,
    round({kernel(f'cos({LAPPED})', out='32')}, 4) + 0 AS mdct, round({kernel(f'sin({LAPPED})', out='32')}, 4) + 0 AS mdst, round({kernel(f'cos({UNLAPPED}) / 64', out='128')}, 4) + 0 AS imdct, round({kernel(f'sin({UNLAPPED}) / 64', out='128')}, 4) + 0 AS imdst FROM s""")
def hartley_lapped_transforms(spark: SparkSession, d: str) -> DataFrame:
    return transforms(signals(spark, d), {n: S.transform(F.col("v"), n) for n in ("dht", "idht", "mdct", "mdst", "imdct", "imdst")})


PLANE = "list_sum(list_transform(range(0, 64), lambda k: (k + 1) * list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * ({})))))"
ANGLE = "2 * pi() * ((i // 8) * (k // 8) + (i % 8) * (k % 8)) / 8"


@query(f"""WITH s AS ({SIGNAL}) SELECT vec_id, round({PLANE.format(f'cos({ANGLE})')}, 4) + 0 AS fft2_re, round({PLANE.format(f'-sin({ANGLE})')}, 4) + 0 AS fft2_im, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * v[k + 1])), 4) + 0 AS back,
    round({PLANE.format('4 * cos(pi() * (2 * (i // 8) + 1) * (k // 8) / 16) * cos(pi() * (2 * (i % 8) + 1) * (k % 8) / 16)')}, 4) + 0 AS dct2, round({PLANE.format('4 * sin(pi() * (2 * (i // 8) + 1) * (k // 8 + 1) / 16) * sin(pi() * (2 * (i % 8) + 1) * (k % 8 + 1) / 16)')}, 4) + 0 AS dst2,
    round({PLANE.format('(cos(2 * pi() * (i // 8) * (k // 8) / 8) + sin(2 * pi() * (i // 8) * (k // 8) / 8)) * (cos(2 * pi() * (i % 8) * (k % 8) / 8) + sin(2 * pi() * (i % 8) * (k % 8) / 8))')}, 4) + 0 AS dht2 FROM s""")
def plane_transforms(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).withColumn("f", S.fft2(F.col("v"), 8)).withColumn("b", S.ifft2(F.col("f.re"), F.col("f.im"), 8))
    return transforms(x, {"fft2_re": F.col("f.re"), "fft2_im": F.col("f.im"), "back": F.col("b.re")} | {f"{n}2": S.transform2(F.col("v"), n, 8) for n in ("dct", "dst", "dht")})


@query("""WITH i AS (SELECT unnest(range(0, 16)) AS i) SELECT i, round(0.5 - 0.5 * cos(2 * pi() * i / 15), 6) AS hann, round(0.54 - 0.46 * cos(2 * pi() * i / 15), 6) AS hamming, round(0.42 - 0.5 * cos(2 * pi() * i / 15) + 0.08 * cos(4 * pi() * i / 15), 6) + 0 AS blackman,
    round(1 - abs(2 * i / 15 - 1), 6) AS bartlett, round(sin(pi() * (i + 0.5) / 16), 6) AS cosine FROM i""")
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return spark.range(16).select(F.col("id").alias("i")).select("i", *((F.round(S.window(n, i, 16), 6) + 0).alias(n) for n in ("hann", "hamming", "blackman", "bartlett", "cosine")))


@query(f"""WITH s AS ({SIGNAL}), w AS (SELECT list_transform(range(0, 64), lambda i: 0.54 - 0.46 * cos(2 * pi() * i / 63)) AS w), p AS (SELECT list_sum(w) / 64 AS g, 64 * list_sum(list_transform(w, lambda x: x * x)) / power(list_sum(w), 2) AS b FROM w)
    SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * v[k + 1] * w[k + 1])), 4) + 0 AS windowed, round(g, 6) AS coherent_gain, round(b, 6) AS noise_bandwidth FROM s, w, p""")
def windowed_signals(spark: SparkSession, d: str) -> DataFrame:
    p = S.window_properties("hamming", 64)
    return signals(spark, d).select("vec_id", (F.round(sums(S.apply_window(F.col("v"), "hamming", 64)), 4) + 0).alias("windowed"), F.round(p["coherent_gain"], 6).alias("coherent_gain"), F.round(p["noise_bandwidth"], 6).alias("noise_bandwidth"))


FRAME = "v[8 * s + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 16))"
PART = "list_sum(list_transform(range(0, 16), lambda i: {} * {}(2 * pi() * i * k / 16)))"


@query(f"""WITH s AS ({SIGNAL}), f AS (SELECT vec_id, unnest(range(0, 7)) AS s, v FROM s), p AS (SELECT vec_id, s, v, unnest(range(0, 9)) AS k FROM f), q AS (SELECT vec_id, s, k, {PART.format(FRAME, 'cos')} AS re, -{PART.format(FRAME, 'sin')} AS im FROM p), e AS (SELECT *, re * re + im * im AS power FROM q)
    SELECT vec_id, round(sum(re * (9 * s + k + 1)), 4) + 0 AS stft_re, round(sum(power * (9 * s + k + 1)), 4) AS spectrogram, round(sum((k + 1) * power * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / 7 / 6, 4) AS welch FROM e GROUP BY vec_id""")
def frame_spectra(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return transforms(signals(spark, d), {"stft_re": S.stft(v, 16, 8)["re"], "spectrogram": S.spectrogram(v, 16, 8), "welch": S.welch(v, 16, 8)})


@query(f"""WITH s AS ({SIGNAL}), u AS (SELECT vec_id, v, list_transform(range(0, 64), lambda i: 0.2 * v[i + 1] + CASE WHEN i > 0 THEN 0.3 * v[greatest(i, 1)] ELSE 0 END) AS u FROM s)
    SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * list_sum(list_transform(range(0, k + 1), lambda i: u[i + 1] * power(0.5, k - i))))), 4) + 0 AS iir,
    round(list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (0.25 * (i + 1) + 0.5 * (i + 2) + 0.125 * (i + 3)))), 4) + 0 AS convolved, round(list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (0.125 * (i + 1) + 0.5 * (i + 2) + 0.25 * (i + 3)))), 4) + 0 AS correlated,
    round(list_sum(list_transform(range(0, 16), lambda k: (k + 1) * (v[4 * k + 1] + v[4 * k + 2] + v[4 * k + 3] + v[4 * k + 4]) / 4)), 4) + 0 AS decimated FROM u""")
def filter_bank(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return transforms(signals(spark, d), {"iir": S.iir(v, [0.2, 0.3], [1.0, -0.5]), "convolved": S.convolve(v, [0.25, 0.5, 0.125]), "correlated": S.correlate(v, [0.25, 0.5, 0.125]), "decimated": S.decimate(v, 4)})


@query(f"""WITH s AS ({SIGNAL}), p AS (SELECT *, list_filter(range(1, 63), lambda i: v[i + 1] > v[i] AND v[i + 1] > v[i + 2]) AS p FROM s) SELECT vec_id, len(p) AS peaks, list_sum(p)::BIGINT AS places, len(list_filter(range(1, 64), lambda i: (v[i] < 0) <> (v[i + 1] < 0))) AS crossings,
    round(list_sum(list_transform(range(0, 63), lambda i: v[i + 1] * CASE WHEN i IN (0, 62) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) / 3, 5) AS simpson, round(list_sum(list_transform(range(1, 64), lambda k: k * list_sum(list_transform(range(1, k + 1), lambda i: (v[i] + v[i + 1]) / 2)))), 4) AS cumulative FROM p""")
def peaks_integrals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    p = S.peaks(v)
    x = signals(spark, d)
    return x.select("vec_id", F.size(p).cast("bigint").alias("peaks"), F.aggregate(p, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("places"), S.zero_crossings(v).cast("bigint").alias("crossings"), F.round(S.simpson(F.slice(v, 1, 63)), 5).alias("simpson"), F.round(sums(S.cumulative_trapezoid(v)), 4).alias("cumulative"))


NEAR = "list_transform(range(0, 64), lambda k: {}([v[greatest(k, 1)], v[k + 1], v[least(k + 2, 64)]]))"


@query(f"""WITH s AS ({SIGNAL}), n AS (SELECT vec_id, {NEAR.format('list_median')} AS a, {NEAR.format('list_min')} AS b, {NEAR.format('list_max')} AS c, {NEAR.format('list_avg')} AS e FROM s)
    SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * a[k + 1])), 4) + 0 AS median, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * b[k + 1])), 4) + 0 AS minimum, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * c[k + 1])), 4) + 0 AS maximum,
    round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * e[k + 1])), 4) + 0 AS uniform FROM n""")
def neighbourhood_filters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return transforms(signals(spark, d), {"median": S.neighbourhood(v, 3, "median"), "minimum": S.neighbourhood(v, 3, "min"), "maximum": S.neighbourhood(v, 3, "max"), "uniform": S.neighbourhood(v, 3, "uniform")})


@query("""WITH t AS (SELECT unnest(range(0, 64)) AS i), x AS (SELECT i, i / 16 + 0.01 AS t FROM t), p AS (SELECT *, t / (2 * pi()) - floor(t / (2 * pi())) AS p FROM x)
    SELECT i, round(cos(2 * pi() * (0.5 * t + 1.5 / 8 * t * t)), 6) + 0 AS chirp, CASE WHEN p < 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE AS square, round(2 * p - 1, 6) AS sawtooth, round(2 / (sqrt(4.5) * power(pi(), 0.25)) * (1 - t * t / 2.25) * exp(-t * t / 4.5), 6) AS ricker FROM p""")
def waveforms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("i") / 16 + 0.01
    return spark.range(64).select(F.col("id").alias("i")).select("i", (F.round(S.chirp(t, 0.5, 4.0, 2.0), 6) + 0).alias("chirp"), S.square(t).alias("square"), *rounded(sawtooth=S.sawtooth(t), ricker=S.ricker(t, 1.5)))


A3 = "[v[1] + 3, v[2], v[3], v[4], v[5] + 3, v[6], v[7], v[8], v[9] + 3]"
DET = "a[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (a[4] * a[9] - a[6] * a[7]) + a[3] * (a[4] * a[8] - a[5] * a[7])"


def three(v: Column) -> Column:
    """The first nine values as a matrix, with 3 on the diagonal."""
    return F.transform(F.slice(v, 1, 9), lambda x, i: x + F.when(i % 4 == 0, 3.0).otherwise(0.0))


@query(f"""WITH s AS ({SIGNAL}), m AS (SELECT vec_id, {A3} AS a, [v[10], v[11], v[12]] AS b FROM s), e AS (SELECT *, {DET} AS det FROM m)
    SELECT vec_id, round(det, 5) AS det, round((a[5] * a[9] - a[6] * a[8]) / det, 5) AS inverse_11, round((a[2] * a[6] - a[3] * a[5]) / det, 5) + 0 AS inverse_13,
    round((b[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (b[2] * a[9] - a[6] * b[3]) + a[3] * (b[2] * a[8] - a[5] * b[3])) / det, 5) + 0 AS x1, round(a[1] + a[5] + a[9], 5) AS trace, round(list_sum(list_transform(range(0, 9), lambda k: (k + 1) * a[k + 1])), 5) AS lu, round(list_sum(list_transform(range(0, 9), lambda k: (k + 1) * a[k + 1])), 5) AS qr, 3.0::DOUBLE AS rank FROM e""")
def small_matrices(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).select("vec_id", three(F.col("v")).alias("a"), F.slice("v", 10, 3).alias("b"))
    a = F.col("a")
    (l_, u), (q, r) = M.lu(a), M.qr(a)
    x = x.withColumns({"i": M.inv(a), "x": M.solve(a, F.col("b")), "l": l_, "u": u, "q": q, "r": r})
    return x.select("vec_id", F.round(M.det(a), 5).alias("det"), F.round(F.col("i")[0], 5).alias("inverse_11"), (F.round(F.col("i")[2], 5) + 0).alias("inverse_13"), (F.round(F.col("x")[0], 5) + 0).alias("x1"), F.round(M.trace(a, 3), 5).alias("trace"), F.round(sums(M.matmul(F.col("l"), F.col("u"))), 5).alias("lu"), F.round(sums(M.matmul(F.col("q"), F.col("r"))), 5).alias("qr"), M.matrix_rank(a).alias("rank"))


@query(f"""WITH s AS ({SIGNAL}), m AS (SELECT vec_id, v[1] + 5 AS a, v[2] AS b, v[3] + 4 AS c, v[4] AS p, v[5] AS q FROM s), e AS (SELECT *, (a + c) / 2 AS h, sqrt(power((a - c) / 2, 2) + b * b) AS r, a * c - b * b AS det FROM m)
    SELECT vec_id, round(h - r, 5) AS low, round(h + r, 5) AS high, round(h + r, 5) AS power, round((h + r) / (h - r), 5) AS cond, round(h + r, 5) AS singular, round(sqrt(a), 5) AS l11, round(b / sqrt(a), 5) + 0 AS l21, round((c * p - b * q) / det, 5) + 0 AS x1 FROM e""")
def symmetric_matrices(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    x = signals(spark, d).select("vec_id", F.array(v[0] + 5, v[1], v[1], v[2] + 4).alias("a"), F.slice(v, 4, 2).alias("b"))
    a = F.col("a")
    x = x.withColumns({"e": M.eigvalsh(a), "s": M.svdvals(a), "l": M.cholesky(a), "x": M.conjugate_gradient(a, F.col("b"), 4)})
    return x.select("vec_id", *rounded5(low=F.col("e")[0], high=F.col("e")[1], power=M.power_iteration(a, 200), cond=M.cond(a), singular=F.col("s")[0], l11=F.col("l")[0], l21=F.col("l")[2], x1=F.col("x")[0]))


def rounded5(**columns: Column) -> list[Column]:
    return [(F.round(c, 5) + 0).alias(n) for n, c in columns.items()]
