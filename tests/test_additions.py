"""Operators added beside the registered queries' SQL: graphs, hulls, made data, matrices, transforms and back, ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioscope.functions import encodings, geometry, matrices, signals
from helioscope.functions import special as S
from helioscope.operators import evaluation, graph, prefix, structure
from helioscope.sources import generators


def cliques(spark):
    """Two cliques of five, tied by one edge, and a tail of two."""
    e = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10), (14, 20), (20, 21)]
    return spark.createDataFrame(e, "src bigint, dst bigint")


def test_core_numbers_by_peeling(spark):
    rng = random.Random(3)
    links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, left, k = {}, {n: set(m) for n, m in near.items()}, 0
    while left:
        n = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[n]))
        want[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    got = structure.core_numbers(spark.createDataFrame(sorted(links), "src bigint, dst bigint"))
    assert {r["id"]: r["core"] for r in got.collect()} == want


def test_louvain_parts_cliques(spark):
    e = cliques(spark)
    c = structure.louvain(e)
    got = {r["id"]: r["community"] for r in c.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    assert graph.modularity(e, c.withColumnRenamed("community", "label")).first()[0] > 0.35


def test_extent_and_circuits(spark):
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src bigint, dst bigint")
    assert tuple(structure.extent(line).first()) == (4, 2, 1)
    assert structure.eulerian(line).first()["kind"] == "path"
    assert structure.eulerian(line.union(spark.createDataFrame([(5, 1)], "src bigint, dst bigint"))).first()["kind"] == "circuit"


def test_hulls(spark):
    rng = random.Random(1)
    rows = [("a", rng.random(), rng.random()) for _ in range(200)] + [("a", x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)] + [("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 3.0, 4.0)]
    got = {r["k"]: (r["corners"], r["area"], r["diameter"]) for r in geometry.hulls(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), ["k"]).collect()}
    assert got["a"] == (4, pytest.approx(1), pytest.approx(math.sqrt(2))) and got["b"] == (1, 0, 0) and got["c"] == (2, 0, pytest.approx(5))


def test_transforms_there_and_back(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((1, 2, 7, 16))] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    for name in ("dct", "dst", "dht", "fftshift"):
        back = {"fftshift": "ifftshift"}.get(name, f"i{name}")
        for r in df.select("x", signals.transform(signals.transform(F.col("x"), name), back).alias("y")).collect():
            assert r["y"] == (None if r["x"] is None else pytest.approx(r["x"]))


def test_filters_and_designs(spark):
    x = [float(v) for v in np.random.default_rng(1).normal(size=30)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    b, a = signals.butter2(0.3)
    assert sum(b) / sum(a) == pytest.approx(1) and sum(signals.firwin(21, 0.4)) == pytest.approx(1)
    got = df.select(signals.iir(F.col("x"), b, a).alias("y"), signals.filtfilt(F.col("x"), b, a).alias("z"), signals.romberg(F.slice("x", 1, 17)).alias("r"), signals.hilbert(F.col("x")).alias("h")).first()
    y = []
    for i in range(30):
        y.append(sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k))
    assert got["y"] == pytest.approx(y) and len(got["z"]) == 30
    line = spark.createDataFrame([([float(v) ** 3 for v in range(17)],)], "x array<double>")
    assert line.select(signals.romberg(F.col("x"))).first()[0] == pytest.approx(16**4 / 4)
    wave = spark.createDataFrame([([math.cos(2 * math.pi * 3 * i / 32) for i in range(32)],)], "x array<double>")
    assert wave.select(signals.hilbert(F.col("x")).alias("h")).first()["h"] == pytest.approx([math.sin(2 * math.pi * 3 * i / 32) for i in range(32)], abs=1e-9)
    assert [signals.next_fast_len(n) for n in (7, 11, 17, 121)] == [8, 12, 18, 125]


def test_matrices(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(4, 4))
    spd = m @ m.T + 4 * np.eye(4)
    q, k, v = (rng.normal(size=(4, 4)) for _ in range(3))
    df = spark.createDataFrame([(spd.ravel().tolist(), rng.normal(size=4).tolist(), q.ravel().tolist(), k.ravel().tolist(), v.ravel().tolist())], "a array<double>, b array<double>, q array<double>, k array<double>, v array<double>")
    r = df.select("b", matrices.solve(F.col("a"), F.col("b")).alias("x"), matrices.conjugate_gradient(F.col("a"), F.col("b"), 8).alias("c"), matrices.svdvals(F.col("a")).alias("s"), matrices.attention(F.col("q"), F.col("k"), F.col("v"), True).alias("t"), matrices.power_iteration(F.col("a"), 500).alias("p")).first()
    want = np.linalg.solve(spd, r["b"])
    assert r["x"] == pytest.approx(want) and r["c"] == pytest.approx(want) and r["s"] == pytest.approx(np.linalg.svd(spd)[1]) and r["p"] == pytest.approx(np.linalg.eigvalsh(spd)[-1], rel=1e-4)
    assert r["t"][:4] == pytest.approx(v[0])


def test_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 9), rng.random()])) for _ in range(500)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(5)
    got = {r["k"]: (r["p"], r["q"]) for r in prefix.quantiles(df, "v", {"p": 0.5, "q": 0.9}, ["k"]).collect()}
    for key in ("a", "b", None, "c"):
        own = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.quantile(own, [0.5, 0.9])))
    assert set(got) == {"a", "b", None, "c"}
    ids = spark.createDataFrame([(i * 3 % 101, str(i)) for i in range(101)], "id int, s string").repartition(4)
    byid = {r["id"]: r["s"] for r in ids.collect()}
    assert {r["id"]: r["last_s"] for r in prefix.lagged(ids, ["s"], "id").collect()} == {i: byid.get(i - 1) for i in range(101)}
    assert [r["id"] for r in prefix.numbered(ids, [-F.col("id")], "n").orderBy("n").collect()] == list(range(100, -1, -1))


def test_encodings_round_trip(spark):
    xs = [0, 1, -1, 63, -64, 300, 2**40, -(2**40), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", encodings.zigzag(F.col("x")).alias("z"))
    got = df.select("x", "z", encodings.varint(F.col("z")).alias("b")).withColumn("y", encodings.unzigzag(encodings.unvarint(F.col("b")))).collect()
    assert all(r["x"] == r["y"] for r in got) and {r["x"]: r["z"] for r in got}[-1] == 1 and {r["x"]: bytes(r["b"]) for r in got}[300] == b"\xd8\x04"


def test_made_data(spark):
    b = generators.make_blobs(spark, 3000, 3, 2, 0.5, seed=4).select("label", F.col("x")[0].alias("x")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.stddev("x").alias("s")).collect()
    assert len(b) == 3 and all(r["n"] == 1000 and abs(r["s"] - 0.5) < 0.06 for r in b)
    r = generators.make_regression(spark, 2000, 2, seed=1).agg(F.max(F.abs(F.col("y") - F.col("x")[0] - 2 * F.col("x")[1]))).first()[0]
    assert r == pytest.approx(0, abs=1e-9)
    c = generators.make_classification(spark, 2000, 3, 0.1, seed=1).agg(F.avg("label")).first()[0]
    assert 0.4 < c < 0.6


def test_distribution_functions(spark):
    x = F.lit(1.5)
    got = spark.range(1).select(S.cumulative("student_t", x, df=4.0).alias("t"), S.cumulative("f", x, d1=3.0, d2=7.0).alias("f"), S.cumulative("beta", F.lit(0.3), a=2.0, b=5.0).alias("b"), S.bessel_j1(x).alias("j"), S.dawson(x).alias("d"), S.zernike_radial(4, 2, F.lit(0.5)).alias("z")).first()
    assert got["t"] == pytest.approx(0.896, abs=1e-3) and got["b"] == pytest.approx(0.579825, abs=1e-6) and got["j"] == pytest.approx(0.5579365, abs=1e-6) and got["d"] == pytest.approx(0.4282491, abs=1e-6) and got["z"] == pytest.approx(4 * 0.0625 - 3 * 0.25) and 0.6 < got["f"] < 0.8


def test_skill_and_crps(spark):
    r = spark.range(1).select(evaluation.crps_normal(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("c"), evaluation.crps_ensemble(F.lit(2.0), F.array(F.lit(1.0), F.lit(4.0))).alias("e"), evaluation.neumaier(F.array(F.lit(1.0), F.lit(1e100), F.lit(1.0), F.lit(-1e100))).alias("n")).first()
    assert r["c"] == pytest.approx(0.2336949, abs=1e-6) and r["e"] == pytest.approx(1.5 - 0.75) and r["n"] == 2.0


def test_edge_lists_and_npy(spark, tmp_path):
    import io

    import numpy as np

    from helioscope.sources import formats

    e = spark.createDataFrame([("a", "b", 1.5), ("b", "c", 2.0)], "src string, dst string, weight double")
    formats.write_edge_list(e, f"{tmp_path}/e", weighted=True)
    assert sorted(map(tuple, formats.read_edge_list(spark, f"{tmp_path}/e").collect())) == [("a", "b", 1.5), ("b", "c", 2.0)]
    (tmp_path / "own.txt").write_text("# comment\n\n 1  2\n2\t3 x\nlone\n")
    assert sorted(map(tuple, formats.read_edge_list(spark, f"{tmp_path}/own.txt").collect())) == [("1", "2", None), ("2", "3", None)]
    v = spark.createDataFrame([(1, [1.0, 2.5]), (2, []), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["b"] for r in v.select("id", formats.npy_bytes(F.col("v")).alias("b")).collect()}
    assert np.load(io.BytesIO(got[1])).tolist() == [1.0, 2.5] and len(np.load(io.BytesIO(got[2]))) == 0 and got[3] is None


def test_safe_numbers_and_multilabel(spark):
    from helioscope.functions import special
    from helioscope.operators import metrics

    x = spark.createDataFrame([(0, 2.0, 3.0), (1, -8.0, 1 / 3), (2, 0.0, -1.0), (3, 10.0, 400.0), (4, -2.0, 3.0), (5, None, 1.0)], "i int, b double, e double")
    assert [r[0] for r in x.orderBy("i").select(special.safe_pow(F.col("b"), F.col("e"))).collect()] == [8.0, None, None, None, -8.0, None]
    assert [r[0] for r in x.orderBy("i").select(special.safe_normalize(F.col("e"), F.col("b"))).collect()][:3] == [1.5, -1 / 24, None]
    y = spark.createDataFrame([([True, None], [True, True]), ([False, True], [True, True]), (None, [True]), ([True], [])], "y array<boolean>, p array<boolean>")
    assert metrics.multilabel(y, "y", "p").first() == (1.0, 0.5, 0.5)
