import numpy as np
import pytest
from pyspark.sql import functions as F

from helioscope.operators.pipeline import PCA, Imputer, Pipeline, Scaler, equal_frequency


def test_pipeline_stages(spark):
    seen = []
    p = Pipeline().with_columns(y=F.col("id") * 2).where("y > 4").tap("look", lambda df: seen.append(df.columns)).checkpoint()
    p = p.branch(lambda df: "a", {"a": Pipeline().with_columns(z=F.col("y") + 1)})
    assert [r["z"] for r in p(spark.range(5)).orderBy("id").collect()] == [7, 9] and seen == [["id", "y"]]
    both = Pipeline().parallel([Pipeline().where("id < 2"), Pipeline().where("id > 3")], lambda xs: xs[0].union(xs[1]))
    assert sorted(r["id"] for r in both(spark.range(5)).collect()) == [0, 1, 4]
    with pytest.raises(KeyError):
        Pipeline().branch(lambda df: "b", {})(spark.range(1))


def test_fitted_stages(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    s = Scaler(["a", "b"]).fit(df)
    got = s.transform(df)
    assert got.agg(F.avg("a"), F.stddev_pop("a")).first() == (pytest.approx(0, abs=1e-9), pytest.approx(1))
    assert s.inverse(got).agg(F.sum("b")).first()[0] == pytest.approx(x[:, 1].sum())
    pca = PCA(["a", "b", "c"], 2).fit(df)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]
    assert pca.values == pytest.approx(want) and pca.transform(df).agg(F.var_samp("pc1")).first()[0] == pytest.approx(want[0])
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,), (8.0,)], "v double")
    assert [r["v"] for r in Imputer(["v"], "median").fit(holes).transform(holes).collect()] == [1, 3, 3, 8]
    bins = equal_frequency(spark.range(100).withColumn("v", F.col("id") * 1.0), "v", 4).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in bins) == [25] * 4
