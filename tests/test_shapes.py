"""Signal features, dispersion and sketch answers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioscope.operators import joins, shape, sketches, stats


def brute(v):
    """Features of one signal by their definitions; None where not defined."""
    v = np.array(v, float)
    n, i = len(v), np.arange(len(v), dtype=float)
    out = dict.fromkeys(("trend_slope", "trend_intercept", "trend_r_squared", "trend_residual_std", "non_linearity"))
    yy = ((v - v.mean()) ** 2).sum()
    if n > 1:
        line = np.polyfit(i, v, 1)
        left = ((v - np.polyval(line, i)) ** 2).sum()
        out |= {"trend_slope": line[0], "trend_intercept": line[1], "trend_residual_std": np.sqrt(left / n)}
        if yy > 0:
            out |= {"trend_r_squared": 1 - left / yy, "non_linearity": 0.0}
            if left > 1e-12 * yy:
                out["non_linearity"] = 1 - ((v - np.polyval(np.polyfit(i, v, 2), i)) ** 2).sum() / left
    for name, level in (("zero", 0.0), ("mean", v.mean())):
        out[f"{name}_crossings"] = int(((v[1:] >= level) != (v[:-1] >= level)).sum())
    tops = [k for k in range(n) if n > 1 and all(v[k] > v[j] for j in (k - 1, k + 1) if 0 <= j < n)]
    lows = [k for k in range(n) if n > 1 and all(v[k] < v[j] for j in (k - 1, k + 1) if 0 <= j < n)]
    steps = np.diff(tops)
    return out | {
        "n": n, "num_peaks": len(tops), "num_troughs": len(lows), "peak_trough_ratio": len(tops) / len(lows) if lows else None, "peak_to_peak": np.ptp(v), "peak_density": len(tops) / n,
        "mean_peak_distance": steps.mean() if len(steps) else None, "peak_distance_std": steps.std() if len(steps) > 1 else None, "crest_factor": np.abs(v).max() / np.sqrt((v * v).mean()) if v.any() else None,
    }


def held(row, want):
    for k, w in want.items():
        assert row[k] == (None if w is None else pytest.approx(w, rel=1e-8, abs=1e-8)), k


def test_signal_features_by_definition(spark):
    rng = np.random.default_rng(5)
    series = {"long": rng.normal(size=83).round(1).tolist(), None: rng.normal(size=9).tolist(), "one": [3.0], "two": [1.0, 2.0], "flat": [4.0] * 5, "zeros": [0.0, 0.0], "bent": [float(i * i) for i in range(6)], "line": [2.0 * i for i in range(7)]}
    rows = [(k, i, v) for k, s in series.items() for i, v in enumerate(s)] + [("long", 7, None), ("void", 0, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, at int, v double")
    got = {r["k"]: r.asDict() for r in shape.signal_features(df, "v", ["at"], ["k"], block=16).collect()}
    assert set(got) == set(series)
    for k, s in series.items():
        held(got[k], brute(s))


def test_signal_features_of_ties_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 1.0), (1, 0, 1.0), (1, 1, 5.0)], "n int, _r int, _v double")
    held(shape.signal_features(df, "_v", ["_r"], ["n"]).select(F.col("trend_slope"), F.col("num_peaks")).first().asDict(), {k: v for k, v in brute([1.0, 1.0, 2.0, 5.0]).items() if k in ("trend_slope", "num_peaks")})
    assert shape.signal_features(df.limit(0), "_v", ["_r"], ["n"]).count() == 0


def test_dispersion_leaves_nulls_out(spark):
    v = [1.0, 2.0, 3.0, 4.0, 50.0]
    df = spark.createDataFrame([("a", x) for x in v] + [("a", None), ("b", None)], "k string, v double")
    low, high = np.quantile(v, [0.2, 0.8])
    assert {r[0]: r[1] for r in stats.winsorized_variance(df, "v", 0.2, ["k"]).collect()}["a"] == pytest.approx(np.var(np.clip(v, low, high), ddof=1))
    assert {r[0]: r[1] for r in stats.mean_abs_deviation(df, "v", ["k"]).collect()} == {"a": pytest.approx(np.abs(np.array(v) - 12).mean()), "b": None}


def test_inner_product_of_sketches(spark):
    a = spark.range(3000).select((F.col("id") % 37).alias("k"))
    b = spark.range(500).select((F.col("id") % 50 + 20).alias("k"))
    exact = a.join(b, "k").count()
    pair = lambda width: sketches.count_min_inner(sketches.count_min(a, "k", 4, width), sketches.count_min(b, "k", 4, width)).first()[0]
    assert pair(1 << 20) == exact and pair(16) >= exact
    assert sketches.count_min_inner(sketches.count_min(a.limit(0), "k", 4, 16), sketches.count_min(b, "k", 4, 16)).first()[0] == 0


def test_shares_by_digests(spark):
    x = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") / 5000).alias("v"))
    got = {(r["k"], r["x"]): r["estimate"] for r in sketches.tdigest_cdf(x, "v", ["k"], [-1.0, 0.25, 0.9, 2.0]).collect()}
    for (_, at), share in got.items():
        assert share == pytest.approx(min(max(at, 0.0), 1.0), abs=0.01)
    assert len(got) == 8


def test_kendall_of_any_number_of_pairs(spark):
    rng = np.random.default_rng(3)
    for x, y in ((rng.normal(size=400), rng.normal(size=400)), (rng.integers(0, 9, 300), rng.integers(0, 5, 300)), (np.arange(50), -np.arange(50)), ([1, 1, 2], [4, 4, 4])):
        x, y = np.asarray(x, float), np.asarray(y, float)
        s = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum()
        ties = [((v[:, None] - v) != 0).sum() for v in (x, y)]
        rows = list(zip(x.tolist(), y.tolist())) + [(None, 1.0), (1.0, None)]
        got = stats.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
        assert got["n"] == len(x)
        assert got["tau"] == (pytest.approx(s / np.sqrt(ties[0] * ties[1])) if all(ties) else None)
    assert tuple(stats.kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first()) == (None, 0.0)


def test_nearest_by_blocks(spark):
    points = spark.range(200).select("id", (F.col("id") * 0.7).alias("x"))
    centres = spark.range(60).select(F.col("id").alias("centre"), (F.col("id") * 3 % 61).cast("double").alias("c"))
    far = F.abs(F.col("x") - F.col("c"))
    want = joins.nearest(points, centres, far).collect()
    assert sorted(joins.nearest(points, centres, far, block=7).collect()) == sorted(want) and len(want) == 200
    assert joins.nearest(points, centres.limit(0), far).count() == 0
