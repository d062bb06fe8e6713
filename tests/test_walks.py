import pytest

from helioscope.operators import graph, stats


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    near = {1: {2}, 2: {1, 3}, 3: {2, 4}, 4: {3}}
    walks = graph.random_walks(e, 3, 5, 1).collect()
    assert len(walks) == 12 and all(b in near[a] for w in walks for a, b in zip(w["path"], w["path"][1:]))
    assert {r["id"]: r["depth"] for r in graph.bfs(e, 1, 2).collect()} == {1: 0, 2: 1, 3: 2}
    h = graph.hits(e, 3).collect()
    assert sum(r["hub"] for r in h) == pytest.approx(1) and sum(r["authority"] for r in h) == pytest.approx(1)


def test_link_stream(spark):
    links = spark.createDataFrame([(1, 2, 0.0, 2.0), (2, 1, 5.0, 6.0), (1, 2, 5.5, 7.0)], "src long, dst long, start double, end double")
    r = graph.link_stream(links).first()
    assert (r["contacts"], r["duration"], r["mean_gap"]) == (3, 4.5, 3.0)


def test_icc(spark):
    df = spark.createDataFrame([(t, float(v)) for t, vs in enumerate([(9, 2), (6, 1), (8, 4), (7, 1)]) for v in vs], "t int, v double")
    between = 2 * 1.0625 / 3 * 1  # of means 5.5, 3.5, 6, 4
    assert stats.icc1(df, "t", "v").first()["icc"] < 0 < between
