"""Recurrences carried over the triggers of a stream against the same over whole series."""

import numpy as np
import pytest

from helioscope.streaming import state
from helioscope.streaming import windows as W


def stream(spark, folder, parts):
    """A stream of one file a part, in the order of the parts."""
    for p in parts:
        spark.createDataFrame(p, "k string, at int, v double, n string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("k string, at int, v double, n string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def parts():
    rng = np.random.default_rng(2)
    rows = [(k, i, float(v), "x") for k in "ab" for i, v in enumerate(np.round(np.append(rng.normal(0, 1, 20), rng.normal(8, 1, 20)), 2))]
    cut = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 11), (11, 25), (25, 40))]
    cut[1] += [("a", 12, None, "x"), (None, 13, 1.0, "x"), ("a", 14, float("nan"), "x")]
    return [[p[i] for i in rng.permutation(len(p))] for p in cut]


def series(parts, k):
    return [v for _, v in sorted((i, v) for p in parts for key, i, v, _ in p if key == k and v is not None and v == v)]


def test_analysis_over_triggers(spark, tmp_path, parts):
    got = W.drain(state.analyzed(stream(spark, f"{tmp_path}/in", parts), "v", ["at"], ["k"], 0.3, 0.5, 12.0), "analyzed_test").collect()
    for k in "ab":
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        v = series(parts, k)
        assert [r["v"] for r in own] == v and [r["n"] for r in own] == list(range(1, len(v) + 1))
        ewma, up, down = v[0], 0.0, 0.0
        for i, r in enumerate(own):
            mean = np.mean(v[: i + 1])
            ewma = 0.3 * v[i] + 0.7 * ewma if i else v[0]
            up, down = max(0, up + v[i] - mean - 0.5), max(0, down - v[i] + mean - 0.5)
            assert (r["mean"], r["ewma"], r["cusum_up"], r["cusum_down"]) == pytest.approx((mean, ewma, up, down), abs=1e-9)
            assert r["change"] == float(up > 12 or down > 12)
            if i:
                assert r["variance"] == pytest.approx(np.var(v[: i + 1], ddof=1), abs=1e-9)
            if r["change"]:
                up = down = 0.0
        assert any(r["change"] and r["at"] >= 20 for r in own) and not any(r["change"] for r in own if r["at"] < 20)
    assert {r["k"] for r in got} == {"a", "b"}


def test_forecasts_of_a_line_and_of_seasons(spark, tmp_path):
    line = [[("a", i, 3.0 * i, "x") for i in range(a, a + 60)] for a in (0, 60)]
    got = W.drain(state.forecast(stream(spark, f"{tmp_path}/line", line), "v", ["at"], ["k"], 0.5, 0.5, steps=2), "forecast_line").collect()
    assert max(got, key=lambda r: r["at"])["forecast"] == pytest.approx(3.0 * 121 - 3.0 * (1 - 0.5) / 0.5, abs=1e-3)
    waves = [[("a", i, [10.0, 20.0, 60.0][i % 3], "x") for i in range(a, a + 150)] for a in (0, 150)]
    got = W.drain(state.forecast(stream(spark, f"{tmp_path}/waves", waves), "v", ["at"], ["k"], 0.2, gamma=0.4, period=3), "forecast_waves").collect()
    assert max(got, key=lambda r: r["at"])["forecast"] == pytest.approx(10.0, abs=0.1)
    with pytest.raises(ValueError):
        state.forecast(spark.readStream.format("rate").load(), "value", ["timestamp"], ["value"], 0.2, gamma=0.1)


def test_no_rows(spark, tmp_path):
    x = state.analyzed(stream(spark, f"{tmp_path}/none", [[]]), "v", ["at"], ["k"], 0.3, 0.5, 12.0)
    assert state.settled(x, spark).count() == 0
