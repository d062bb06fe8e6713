"""Series by group in numpy: what needs a whole series at once. A group must fit in a task; groups run side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _grouped(df: DataFrame, by: list[str], fn, out: str) -> DataFrame:
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fn(pdf)
        got = pd.DataFrame(rows, columns=names)
        for i, c in enumerate(by):
            got.insert(i, c, pdf[c].iloc[0])
        return got

    return df.groupBy(*by).applyInPandas(run, f"{kind}, {out}")


def spectrum(df: DataFrame, value: str, at: str, by: list[str]) -> DataFrame:
    """(frequency, power) of the real FFT."""
    def fn(pdf):
        x = pdf.sort_values(at)[value].to_numpy(float)
        return [(k, float(p)) for k, p in enumerate(np.abs(np.fft.rfft(x)) ** 2)]

    return _grouped(df, by, fn, "frequency bigint, power double")


def haar(df: DataFrame, value: str, at: str, by: list[str], levels: int) -> DataFrame:
    """(level, position, detail): Haar wavelet coefficients; an odd last value is repeated."""
    def fn(pdf):
        x, rows = pdf.sort_values(at)[value].to_numpy(float), []
        for level in range(1, levels + 1):
            if len(x) < 2:
                break
            x = np.append(x, x[-1]) if len(x) % 2 else x
            d = (x[::2] - x[1::2]) / np.sqrt(2)
            rows += [(level, k, float(v)) for k, v in enumerate(d)]
            x = (x[::2] + x[1::2]) / np.sqrt(2)
        return rows

    return _grouped(df, by, fn, "level int, position bigint, detail double")


def ar_fit(df: DataFrame, value: str, at: str, by: list[str], order: int, steps: int) -> DataFrame:
    """(step, forecast) of an autoregression by least squares with an intercept."""
    def fn(pdf):
        x = pdf.sort_values(at)[value].to_numpy(float)
        if len(x) <= 2 * order:
            return []
        z = np.column_stack([np.ones(len(x) - order), *[x[order - k - 1 : len(x) - k - 1] for k in range(order)]])
        c = np.linalg.lstsq(z, x[order:], rcond=None)[0]
        past, rows = list(x[-order:]), []
        for s in range(1, steps + 1):
            v = float(c[0] + sum(c[k + 1] * past[-k - 1] for k in range(order)))
            past.append(v)
            rows.append((s, v))
        return rows

    return _grouped(df, by, fn, "step int, forecast double")


def holt_winters(df: DataFrame, value: str, at: str, by: list[str], period: int, steps: int, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> DataFrame:
    """(step, forecast) by additive level, trend and season, started from the first two periods."""
    def fn(pdf):
        x = pdf.sort_values(at)[value].to_numpy(float)
        if len(x) < 2 * period:
            return []
        level = x[:period].mean()
        trend = (x[period : 2 * period].mean() - level) / period
        season = list(x[:period] - level)
        for t in range(period, len(x)):
            old = level
            level = alpha * (x[t] - season[t - period]) + (1 - alpha) * (level + trend)
            trend = beta * (level - old) + (1 - beta) * trend
            season.append(gamma * (x[t] - level) + (1 - gamma) * season[t - period])
        n = len(x)
        return [(s, float(level + s * trend + season[n - period + (s - 1) % period])) for s in range(1, steps + 1)]

    return _grouped(df, by, fn, "step int, forecast double")


def adf(df: DataFrame, value: str, at: str, by: list[str], lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant."""
    def fn(pdf):
        x = pdf.sort_values(at)[value].to_numpy(float)
        dx = np.diff(x)
        n = len(dx) - lags
        if n <= lags + 2:
            return [(None, 0)]
        z = np.column_stack([np.ones(n), x[lags:-1], *[dx[lags - k : len(dx) - k] for k in range(1, lags + 1)]])
        y = dx[lags:]
        c, *_ = np.linalg.lstsq(z, y, rcond=None)
        r = y - z @ c
        cov = np.linalg.pinv(z.T @ z) * (r @ r) / (n - z.shape[1])
        return [(float(c[1] / np.sqrt(cov[1, 1])), n)]

    return _grouped(df, by, fn, "adf double, n bigint")


def kpss(df: DataFrame, value: str, at: str, by: list[str], lags: int = 4) -> DataFrame:
    """KPSS level statistic with Bartlett weights."""
    def fn(pdf):
        e = pdf.sort_values(at)[value].to_numpy(float)
        e = e - e.mean()
        n = len(e)
        s2 = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[: n - k]) / n for k in range(1, min(lags, n - 1) + 1))
        return [(float((np.cumsum(e) ** 2).sum() / (n * n * s2)) if s2 > 0 else None,)]

    return _grouped(df, by, fn, "kpss double")


def permutation_entropy(df: DataFrame, value: str, at: str, by: list[str], order: int = 3) -> DataFrame:
    """Entropy of ordinal patterns over ln(order!)."""
    import math

    def fn(pdf):
        x = pdf.sort_values(at)[value].to_numpy(float)
        if len(x) < order:
            return [(None,)]
        w = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order), axis=1, kind="stable")
        _, c = np.unique(w, axis=0, return_counts=True)
        p = c / c.sum()
        return [(float(-(p * np.log(p)).sum() / math.log(math.factorial(order))) + 0.0,)]

    return _grouped(df, by, fn, "entropy double")


def savgol(df: DataFrame, value: str, at: str, by: list[str], window: int, degree: int) -> DataFrame:
    """(at, smoothed) by local polynomials; ends use the nearest full window."""
    def fn(pdf):
        pdf = pdf.sort_values(at)
        x = pdf[value].to_numpy(float)
        half, n = window // 2, len(x)
        if n < window:
            return list(zip(pdf[at], x.tolist()))
        t = np.arange(-half, half + 1)
        fit = np.linalg.pinv(np.vander(t, degree + 1))
        out = []
        for i in range(n):
            c = min(max(i, half), n - half - 1)
            out.append(float(np.polyval(fit @ x[c - half : c + half + 1], i - c)))
        return list(zip(pdf[at], out))

    kind = df.schema[at].dataType.simpleString()
    return _grouped(df, by, fn, f"{at} {kind}, smoothed double")
