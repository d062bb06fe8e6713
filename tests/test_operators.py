"""Operators against pinned answers, numpy and properties."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioscope.functions import aggregates as A
from helioscope.functions import arrays as V
from helioscope.functions import special as S
from helioscope.functions import text as T
from helioscope.operators import cluster, features, graph, metrics, quality, sketches, stats
from helioscope.operators import matrix as M
from helioscope.operators import windows as W
from helioscope.sources import formats
from helioscope.streaming import windows as E


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], f"i int, {name} double")


def one(df):
    return df.first()[0]


def test_describe_pins(spark):
    x = F.col("x")
    r = column(spark, [1, 2, 3, 4, 5]).agg(*[v.alias(k) for k, v in A.describe(x).items()]).first()
    assert (r["n"], r["mean"], r["min"], r["max"], r["median"]) == (5, 3, 1, 5, 3)
    y = column(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    assert one(y.agg(A.std(x, 0))) == 2 and one(y.agg(A.std(x, 1))) == pytest.approx(2.13809, abs=1e-5)
    assert one(column(spark, [3]).agg(A.variance(x))) is None
    z = [1, 2, 3, 10]
    assert one(column(spark, z).agg(A.quantile(x, 0.25))) == np.quantile(z, 0.25)
    assert one(column(spark, z).agg(A.variance(x, 2))) == pytest.approx(np.var(z, ddof=2))
    with pytest.raises(ValueError):
        A.quantile(x, 1.5)


def test_centres(spark):
    x = F.col("x")
    v = [1.0, 2.0, 4.0]
    assert one(column(spark, v).agg(A.gmean(x))) == pytest.approx(2) and one(column(spark, v).agg(A.hmean(x))) == pytest.approx(3 / 1.75)
    assert one(column(spark, [0, 1]).agg(A.gmean(x))) is None
    assert one(column(spark, [0.5, 0.5, 0]).agg(A.entropy(x))) == pytest.approx(math.log(2))


def test_distances(spark):
    a, b = [1.0, -2.0, 3.0], [0.5, 2.0, 1.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    x, y = np.array(a), np.array(b)
    want = {"euclidean": np.linalg.norm(x - y), "manhattan": np.abs(x - y).sum(), "chebyshev": np.abs(x - y).max(), "braycurtis": np.abs(x - y).sum() / np.abs(x + y).sum(), "canberra": (np.abs(x - y) / (np.abs(x) + np.abs(y))).sum()}
    for k, w in want.items():
        assert one(df.select(V.DISTANCES[k](F.col("a"), F.col("b")))) == pytest.approx(w)
    assert one(df.select(V.dot(F.col("a"), F.col("b")))) == pytest.approx(x @ y)
    assert one(df.select(V.cumsum(F.col("a")))) == [1, -1, 2] and one(df.select(V.diff(F.col("a")))) == [-3, 5]
    assert one(df.select(V.softmax(F.col("a")))) == pytest.approx((np.exp(x) / np.exp(x).sum()).tolist())


def test_special(spark):
    for v in (0.1, 0.7, 1.0, 2.5, 4.2, -1.3):
        df = column(spark, [v])
        assert one(df.select(S.erf(F.col("x")))) == pytest.approx(math.erf(v), abs=1e-9)
        if v > 0:
            assert one(df.select(S.gammaln(F.col("x")))) == pytest.approx(math.lgamma(v), abs=1e-9)
        assert one(df.select(S.gamma(F.col("x")))) == pytest.approx(math.gamma(v))
        assert one(df.select(S.normal_cdf(F.col("x")))) == pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), abs=1e-9)


def test_text_pins(spark):
    df = spark.createDataFrame([("this is a test this is only a test",)], "t string")
    w = T.words(F.col("t"))
    counts = {r[0]: r[1] for r in df.select(F.explode(w).alias("w")).groupBy("w").count().collect()}
    assert counts == {"this": 2, "is": 2, "a": 2, "test": 2, "only": 1}
    pair = spark.createDataFrame([("the cat sat on the mat", "the cat is on the mat", "", "ab")], "a string, b string, e string, s string")
    a, b, e, s = (T.words(F.col(c)) for c in "abes")
    assert one(pair.select(T.jaccard(a, b))) == pytest.approx(4 / 6)
    assert one(pair.select(T.jaccard(e, e))) == 0 and one(pair.select(T.ngrams(s, 2))) == [] and one(pair.select(T.skipgrams(e, 2))) == []
    assert one(pair.select(T.char_ngrams(F.col("s"), 2))) == ["ab"]


def test_interpolate_pins(spark):
    for values, want in (([None, 2, 3, None], [2, 2, 3, 3]), ([1, None, None, 4], [1, 2, 3, 4])):
        got = W.interpolate(column(spark, values), "x", "i").orderBy("i").collect()
        assert [r["filled"] for r in got] == want


def test_runs_round_trip(spark):
    df = column(spark, [1, 1, 2, 2, 2, 1])
    enc = formats.run_length(df, "x", ["i"])
    assert [(r["value"], r["length"]) for r in enc.orderBy("run").collect()] == [(1, 2), (2, 3), (1, 1)]
    assert [r["value"] for r in formats.run_length_decode(enc).orderBy("i").collect()] == [1, 1, 2, 2, 2, 1]
    d = formats.delta_encode(df, "x", ["i"])
    assert [r["value"] for r in formats.delta_decode(d, ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 2, 1]
    coded, codes = formats.dictionary(df, "x")
    assert coded.join(codes.withColumnRenamed("x", "y"), "code").where("x <> y").count() == 0


def test_folds(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 10, 10, 10])], "k string, i int, x double")
    s = W.folded(df, "x", ["i"], ["k"])
    e = 1.0
    for v in [2, 3, 10, 10, 10]:
        e = 0.5 * v + 0.5 * e
    assert one(s.select(W.ewma(F.col("series"), 0.5))) == pytest.approx(e)
    assert one(s.select(W.cusum(F.col("series"), 2.0, 0.5, 5.0))) == 3


def test_windows_stream_equals_batch(spark, sf_dir, tmp_path):
    df = E.event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    agg = {"n": F.count(F.lit(1)), "v": F.max("value")}
    want = E.tumbling(df, "ts", "1 hour", ["event_type"], **agg)
    stream = E.replay(df, str(tmp_path / "events"))
    got = E.drain(E.tumbling(stream.withWatermark("ts", "40 days"), "ts", "1 hour", ["event_type"], **agg), "tumbling_test", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_watermark_pins(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.2), (2, 0.7), (3, 0.6)], "seq long, ts double")
    got = [(r["watermark"], r["late"]) for r in E.watermark_audit(df, "ts", "seq", 0.5).orderBy("seq").collect()]
    assert got[0] == (None, False) and got[1] == (0.5, False) and got[2] == (pytest.approx(0.7), True) and got[3][1]
    a = E.watermark_audit(df, "ts", "seq", 0.5)
    assert (E.late_policy(a, "ts", "drop").count(), E.late_policy(a, "ts", "allow", 0.2).count(), E.late_policy(a, "ts", "side").count()) == (3, 4, 4)


def test_anchored_windows(spark):
    df = spark.createDataFrame([([(5.0, 1.0), (14.0, 1.0), (15.0, 2.0), (40.0, 3.0)],)], "s array<struct<t:double,v:double>>")
    assert [(r["start"], r["n"], r["total"]) for r in one(df.select(E.anchored_tumbling(F.col("s"), 10.0)))] == [(5, 2, 2), (15, 1, 2), (40, 1, 3)]


def test_metrics_pins(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "y double, p double")
    r = {x["class"]: x for x in metrics.classification_report(df, "y", "p").collect()}
    assert r[1.0]["precision"] == r[1.0]["recall"] == pytest.approx(2 / 3)
    same = metrics.cluster_agreement(df, "y", "y").first()
    assert same["ari"] == 1 and same["v_measure"] == pytest.approx(1)
    q = spark.createDataFrame([(1, 3.0, 0.9), (1, 0.0, 0.8), (1, 2.0, 0.1)], "q int, rel double, s double")
    want = (7 + 0 + 3 / 2) / (7 + 3 / math.log2(3))
    assert metrics.ndcg(q, "q", "rel", "s", 3).first()["ndcg"] == pytest.approx(want)


def test_sketches(spark):
    df = spark.range(10_000)
    assert abs(one(df.agg(F.hll_sketch_estimate(sketches.hll(F.col("id"))))) - 10_000) < 500
    x = column(spark, range(1, 101)).withColumn("k", F.lit("a"))
    got = {r["q"]: r["estimate"] for r in sketches.tdigest_quantiles(x, "x", ["k"], [0.5, 0.99]).collect()}
    assert abs(got[0.5] - 50) <= 2 and abs(got[0.99] - 99) <= 2
    data = spark.createDataFrame([(i % 7,) for i in range(100)], "k int")
    cm = sketches.count_min(data, "k", 4, 64)
    both = sketches.count_min_merge(cm, cm)
    est = {r["k"]: r["estimate"] for r in sketches.count_min_query(both, data.distinct(), "k", 4, 64).collect()}
    assert all(est[k] >= 2 * (100 // 7) for k in range(7))
    cs = sketches.count_sketch(data, "k", 5, 64)
    assert all(abs(r["estimate"] - 14.3) < 5 for r in sketches.count_sketch_query(cs, data.distinct(), "k", 5, 64).collect())
    one_part, many = (sorted(r[0] for r in sketches.reservoir(spark.range(100).repartition(n).withColumn("g", F.lit(1)), "id", 10, ["g"], 3).collect()) for n in (1, 5))
    assert one_part == many


def test_graph_pins(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, 6)], "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4}
    assert {r["id"]: r["triangles"] for r in graph.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r["src"] for r in graph.k_core(e, 2).collect()} == {1, 2, 3}
    assert sum(r["rank"] for r in graph.pagerank(e, 10).collect()) == pytest.approx(1)
    w = e.withColumn("weight", F.lit(2.0))
    assert {r["id"]: r["distance"] for r in graph.shortest_paths(w, 1, 4).collect()} == {1: 0, 2: 2, 3: 4, 6: 6}
    t = spark.createDataFrame([(1, 2, 0.0, 5.0), (2, 3, 4.0, 6.0), (2, 3, 7.0, 9.0)], "src long, dst long, depart double, arrive double")
    assert {r["id"]: r["arrival"] for r in graph.earliest_arrival(t, 1, 0.0, 3).collect()} == {1: 0, 2: 5, 3: 9}


def test_clusters(spark):
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate([(1.0, 1.0), (1.1, 1.0), (0.9, 1.1), (5.0, 5.0), (5.1, 5.0), (4.9, 5.1), (20.0, 20.0)])], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(pts, 0.5, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: None}
    v = pts.where("id < 6").select((F.col("id") * 7 % 6).alias("id"), F.array("x", "y").alias("x"))
    km = cluster.kmeans(v, 2, 5).collect()
    assert len({r["centre"] for r in km}) in (1, 2)


def test_matrix_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2, 3, (4, 5)), rng.integers(-2, 3, (5, 3))
    coo = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
    got = np.zeros((4, 3))
    for r in M.matmul(coo(a), coo(b)).collect():
        got[r["i"], r["j"]] = r["v"]
    assert (got == a @ b).all()
    n = M.norms(coo(a)).first()
    assert n["frobenius"] == pytest.approx(np.linalg.norm(a)) and n["norm_1"] == np.abs(a).sum(0).max() and n["norm_inf"] == np.abs(a).sum(1).max()
    x = rng.normal(size=16)
    want = np.fft.fft(x)
    for r in M.dft(column(spark, x), "i", "x", 16, [0, 3, 7]).collect():
        assert r["re"] == pytest.approx(want[r["k"]].real) and r["im"] == pytest.approx(want[r["k"]].imag)


def test_decompose_pins(spark):
    v = [10 + 0.5 * i + [2, -1, 3, -4][i % 4] for i in range(20)]
    got = M.decompose(column(spark, v), "x", 4, ["i"]).orderBy("i").collect()
    assert [round(r["seasonal"], 6) for r in got[:4]] == [2, -1, 3, -4]
    assert all(abs(r["residual"]) < 1e-9 for r in got if r["residual"] is not None)


def test_features(spark):
    df = column(spark, [1, 2, 3, 4])
    assert [r["scaled"] for r in features.minmax(df, "x").orderBy("i").collect()] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert features.variance_threshold(df.withColumn("c", F.lit(1.0)), ["x", "c"]) == ["x"]
    assert [r[0] for r in df.select(features.bins("x", [0, 2, 3, 4])).collect()] == [0, 1, 2, 2]
    assert one(df.select(features.yeo_johnson(F.lit(-1.5), 2.0))) == pytest.approx(-math.log1p(1.5))


def test_tests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", 5.0)], "g string, x double")
    assert stats.mann_whitney(df, "x", "g", "a", "b").first()["u"] == 0.5
    assert stats.ks_two_sample(df, "x", "g", "a", "b").first()["ks"] == pytest.approx(2 / 3)
    assert stats.anova(df, "x", "g").first()["f"] == pytest.approx(3.27097, abs=1e-4)


def test_formats(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6.0).reshape(3, 2))
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    assert [r["values"] for r in formats.read_npy(spark, f"{tmp_path}/a.npy").orderBy("i").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 2\n1 1 5.0\n2 1 7.5\n")
    assert sorted(map(tuple, formats.read_matrix_market(spark, f"{tmp_path}/m.mtx").collect())) == [(0, 0, 5.0), (0, 1, 7.5), (1, 0, 7.5)]
    (tmp_path / "a.arff").write_text("@relation r\n@attribute w numeric\n@attribute c {x,y}\n@data\n1.5,x\n?,y\n")
    assert sorted(map(tuple, formats.read_arff(spark, f"{tmp_path}/a.arff").collect()), key=str) == [(1.5, "x"), (None, "y")]
    (tmp_path / "t.csv").write_text("n,a\nx,1\ny,\n")
    assert [tuple(r) for r in formats.read_csv(spark, f"{tmp_path}/t.csv", "n string, a long").orderBy("n").collect()] == [("x", 1), ("y", None)]
    table = f"{tmp_path}/delta"
    formats.write_delta_log(spark.range(3), table, 0)
    formats.write_delta_log(spark.range(3, 5), table, 1)
    assert formats.read_delta_log(spark, table).count() == 5 and formats.read_delta_log(spark, table, 0).count() == 3


def test_quality(spark):
    df = column(spark, [1, None, 9])
    assert tuple(quality.report(df, {"x": (2, 8)}).first()) == ("x", 3, 1, 2, 1, 1)
    assert tuple(quality.violations(df, {"small": "x < 5"}).first()) == ("small", 2)
    assert quality.schema_errors(df.schema, spark.createDataFrame([], "i long, y double").schema) == ["missing: y"]


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_bloom_prefilter_keeps_repeated_rows(spark):
    from helioscope.operators import sketches

    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    got = sketches.bloom_prefilter(left, right, "k", 1000, 3).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a"), (1, "a")]


def test_arff_reads_every_attribute(spark, tmp_path):
    from helioscope.sources import formats

    path = tmp_path / "wide.arff"
    path.write_text("@relation r\n" + "".join(f"@attribute a{i} numeric\n" for i in range(10_001)) + "@data\n")
    assert len(formats.arff_attributes(spark.read.text(str(path)).withColumnRenamed("value", "line"))) == 10_001


def test_domain_rule_has_all_domains_in_order(spark):
    from pyspark.sql import functions as F

    from helioscope.operators import textmodels

    cases = {"Whereas a patient": "legal", "MEDICATION": "medical", "profit": "financial", "an invention": "patent", "according to #x": "news", "hi @you": "social_media", "nothing": "scientific"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", textmodels.domain(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases
