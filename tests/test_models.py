"""Special functions, geometry, finance, series and text models against known values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioscope.functions import finance, geometry
from helioscope.functions import special as S
from helioscope.operators import extremes, sampling, series, textmodels


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def lit(x):
    return F.lit(float(x))


def test_special_values(spark):
    for column, want in [
        (S.digamma(lit(1)), -0.5772156649), (S.digamma(lit(4.5)), 1.3888709264), (S.beta(lit(2), lit(3)), 1 / 12), (S.factorial(lit(6)), 720), (S.perm(lit(5), lit(2)), 20), (S.comb(lit(10), lit(3)), 120),
        (S.erfinv(lit(0.5)), 0.4769362762), (S.normal_quantile(lit(0.975)), 1.9599639845), (S.lambert_w(lit(1)), 0.5671432904), (S.ellipk(lit(0.5)), 1.8540746773), (S.ellipe(lit(0.5)), 1.3506438810),
        (S.bessel_j0(lit(2.5)), -0.0483837765), (S.bessel_i0(lit(1.5)), 1.6467231898), (S.sinc(lit(0.5)), 2 / math.pi), (S.softplus(lit(0)), math.log(2)),
    ]:
        assert value(spark, column) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("name,params,low,high", [
    ("normal", {"mean": 1.0, "sd": 2.0}, -20, 22), ("exponential", {"rate": 0.7}, 0, 60), ("gamma", {"shape": 2.5, "scale": 1.5}, 0, 80), ("beta", {"a": 2.0, "b": 3.0}, 0, 1), ("lognormal", {}, 0, 400), ("laplace", {"mean": 0.0, "scale": 1.0}, -40, 40),
    ("logistic", {"mean": 0.0, "scale": 1.0}, -60, 60), ("weibull", {"shape": 1.5, "scale": 2.0}, 0, 40), ("chi2", {"df": 4.0}, 0, 90), ("student_t", {"df": 5.0}, -300, 300), ("uniform", {"low": 0.0, "high": 2.0}, 0, 2),
])
def test_densities_sum_to_one(spark, name, params, low, high):
    n = 40_000
    h = (high - low) / n
    x = low + (F.col("id") + 0.5) * h
    assert spark.range(n).agg(F.sum(S.distribution(name, x, **params)) * h).first()[0] == pytest.approx(1, abs=4e-3)


@pytest.mark.parametrize("name,params", [("poisson", {"rate": 3.0}), ("binomial", {"n": 12, "p": 0.3})])
def test_masses_sum_to_one(spark, name, params):
    assert spark.range(13 if name == "binomial" else 60).agg(F.sum(S.distribution(name, F.col("id").cast("double"), **params))).first()[0] == pytest.approx(1)


def test_geometry(spark):
    p = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]])
    assert value(spark, geometry.area(p)) == 12 and value(spark, geometry.perimeter(p)) == 14 and value(spark, geometry.signed_area(p)) == 12
    c = value(spark, geometry.centroid(p))
    assert (c["x"], c["y"]) == (2, 1.5)
    assert value(spark, geometry.contains(p, lit(1), lit(1))) and not value(spark, geometry.contains(p, lit(5), lit(1)))
    assert value(spark, geometry.circumradius(lit(3), lit(4), lit(5))) == 2.5 and value(spark, geometry.inradius(lit(3), lit(4), lit(5))) == 1
    lat, lon = geometry.destination(lit(10), lit(20), lit(45), lit(500))
    assert value(spark, S.haversine(lit(10), lit(20), lat, lon)) == pytest.approx(500, rel=1e-6)
    assert value(spark, geometry.bearing(lit(0), lit(0), lit(0), lit(10))) == pytest.approx(90)


def test_black_scholes_parity(spark):
    a = (lit(100), lit(95), lit(0.03), lit(0.2), lit(1.5))
    call, put = (value(spark, finance.black_scholes(*a, call=c)) for c in (True, False))
    assert call - put == pytest.approx(100 - 95 * math.exp(-0.045)) and call == pytest.approx(14.3, abs=0.6)


def test_blocks_and_peaks(spark):
    df = spark.createDataFrame([(h, 10.0) for h in range(50)], "h int, v double")
    assert [r["total"] for r in extremes.blocks(df, "v", 24, ["h"]).orderBy("block").collect()] == [240, 240]
    x = spark.createDataFrame([(i, v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0, 50.0])], "i int, v double")
    assert sorted(r["i"] for r in extremes.peaks(x, "v", 0.8).collect()) == [3, 4]
    assert extremes.ramps(x, "v", 30.0, ["i"]).first()["change"] == 40


def test_sampling(spark):
    df = spark.range(5000)
    a, b = sampling.train_test_split(df, "id", 0.2, 3)
    assert a.count() + b.count() == 5000 and a.join(b, "id").count() == 0 and 800 < b.count() < 1200
    again = sampling.train_test_split(df.repartition(7), "id", 0.2, 3)[1]
    assert again.exceptAll(b).count() == 0
    m = sampling.bootstrap_means(df.withColumn("v", F.col("id") * 1.0), "v", "id", 30, 1).toPandas()
    assert abs(m["mean"].mean() - 2499.5) < 30 and abs(m["n"].mean() - 5000) < 100


@pytest.fixture(scope="module")
def wave(spark):
    t = np.arange(120)
    x = 5 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 12)
    return spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, x)], "k string, t int, v double"), x


def test_series(wave):
    df, x = wave
    got = {r["frequency"]: r["power"] for r in series.spectrum(df, "v", "t", ["k"]).collect()}
    assert got[10] == pytest.approx(abs(np.fft.rfft(x)[10]) ** 2)
    future = 5 + 0.1 * np.arange(120, 126) + 3 * np.sin(2 * np.pi * np.arange(120, 126) / 12)
    for f in (series.ar_fit(df, "v", "t", ["k"], 4, 6), series.holt_winters(df, "v", "t", ["k"], 12, 6)):
        assert [r["forecast"] for r in f.orderBy("step").collect()] == pytest.approx(future.tolist(), abs=1.0)
    assert series.kpss(df, "v", "t", ["k"]).first()["kpss"] > 0.46
    line = df.withColumn("v", F.col("t") * 2.0 + 1)
    assert [r["smoothed"] for r in series.savgol(line, "v", "t", ["k"], 7, 2).orderBy("t").collect()] == pytest.approx((2.0 * np.arange(120) + 1).tolist())
    assert series.permutation_entropy(line, "v", "t", ["k"]).first()["entropy"] == 0
    assert [r["detail"] for r in series.haar(line, "v", "t", ["k"], 1).collect()] == pytest.approx([-math.sqrt(2)] * 60)


def test_text_models(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat is on the mat", "abcd", "acbd", "été", "")], "a string, b string, c string, d string, n string, e string")
    w = lambda c: F.split(c, " ")
    r = df.select(textmodels.rouge_n(w("a"), w("b"), 1).alias("x"), textmodels.rouge_l(w("a"), w("b")).alias("l"), textmodels.transposition_distance("c", "d").alias("t"), textmodels.nfc("n").alias("n"), textmodels.without_diacritics("n").alias("p"), textmodels.char_cosine(F.col("e"), F.col("e")).alias("e"), textmodels.char_cosine(F.col("c"), F.col("d")).alias("cc"), textmodels.occurrences(F.lit("aaaa"), "aa").alias("o")).first()
    assert r["x"]["f1"] == pytest.approx(5 / 6) and r["l"]["f1"] == pytest.approx(5 / 6) and r["t"] == 1 and r["n"] == "été" and r["p"] == "ete" and r["e"] == 1 and r["cc"] == pytest.approx(1) and r["o"] == [0, 1, 2]
    logs = spark.createDataFrame([("2024-01-01 10:00:00 ERROR app.db: lost user=7 ms=12",), ("nothing",)], "line string")
    got = textmodels.parse_logs(logs, "line").collect()
    assert got[0]["level"] == "ERROR" and got[0]["fields"] == {"user": "7", "ms": "12"} and got[1]["level"] is None
    tags = textmodels.viterbi(spark.createDataFrame([(["the", "dog", "runs"],), ([],)], "w array<string>"), "w", {"D": 0.8, "N": 0.1, "V": 0.1}, {("D", "N"): 0.9, ("N", "V"): 0.8}, {("D", "the"): 0.9, ("N", "dog"): 0.5, ("V", "runs"): 0.5}).collect()
    assert [t["tags"] for t in tags] == [["D", "N", "V"], []]
