"""Signals in array columns: transforms, filters, windows and matrices. Rows of one length in a batch are computed together in numpy; a null row stays null."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Rows = Callable[[np.ndarray], np.ndarray]


def _stacked(s: pd.Series, fn: Rows) -> list:
    """fn of (rows, n) arrays, for the rows of each length at once."""
    out: list = [None] * len(s)
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        if x is not None:
            by_length.setdefault(len(x), []).append(i)
    for n, at in by_length.items():
        m = np.stack([np.asarray(s.iloc[i], float) for i in at]).reshape(len(at), n)
        for i, y in zip(at, fn(m)):
            out[i] = y
    return out


def rowwise(x: Column, fn: Rows) -> Column:
    """array<double> of fn over the last axis."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_stacked(s, fn), dtype=object)

    return run(x)


def scalar(x: Column, fn: Rows) -> Column:
    """double of fn over the last axis."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else float(y) for y in _stacked(s, fn)], dtype="float64")

    return run(x)


def complex_rows(re: Column, im: Column, fn: Rows) -> Column:
    """struct<re,im> of fn over rows of complex numbers."""

    @F.pandas_udf("re array<double>, im array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = pd.Series([None if x is None or y is None else np.concatenate([x, y]) for x, y in zip(a, b)], dtype=object)
        got = _stacked(pairs, lambda m: fn(m[:, : m.shape[1] // 2] + 1j * m[:, m.shape[1] // 2 :]))
        return pd.DataFrame({"re": [None if g is None else g.real.copy() for g in got], "im": [None if g is None else g.imag.copy() for g in got]})

    return run(re, im)


def _zero(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(0.0))


def fft(x: Column, im: Column | None = None) -> Column:
    return complex_rows(x, _zero(x) if im is None else im, np.fft.fft)


def ifft(re: Column, im: Column) -> Column:
    return complex_rows(re, im, np.fft.ifft)


def rfft(x: Column) -> Column:
    return complex_rows(x, _zero(x), lambda m: np.fft.rfft(m.real))


def irfft(re: Column, im: Column, n: int) -> Column:
    return complex_rows(re, im, lambda m: np.fft.irfft(m, n) + 0j)["re"]


def _plane(fn: Rows, rows: int) -> Rows:
    return lambda m: fn(m.reshape(len(m), rows, -1)).reshape(len(m), -1)


def fft2(x: Column, rows: int, im: Column | None = None) -> Column:
    """Of matrices with that many rows, one row of them behind the other."""
    return complex_rows(x, _zero(x) if im is None else im, _plane(np.fft.fft2, rows))


def ifft2(re: Column, im: Column, rows: int) -> Column:
    return complex_rows(re, im, _plane(np.fft.ifft2, rows))


def rfft2(x: Column, rows: int) -> Column:
    return complex_rows(x, _zero(x), _plane(lambda m: np.fft.rfft2(m.real), rows))


def irfft2(re: Column, im: Column, rows: int, columns: int) -> Column:
    return complex_rows(re, im, _plane(lambda m: np.fft.irfft2(m, (rows, columns)) + 0j, rows))["re"]


def _dct(m: np.ndarray) -> np.ndarray:
    n = m.shape[-1]
    y = np.fft.rfft(np.concatenate([m, m[..., ::-1]], -1))[..., :n]
    return (y * np.exp(-0.5j * np.pi * np.arange(n) / n)).real


def _idct(m: np.ndarray) -> np.ndarray:
    n = m.shape[-1]
    v = np.concatenate([m * np.exp(0.5j * np.pi * np.arange(n) / n), np.zeros((*m.shape[:-1], 1))], -1)
    return np.fft.irfft(v, 2 * n)[..., :n]


def _signs(n: int) -> np.ndarray:
    return 1.0 - 2.0 * (np.arange(n) % 2)


def _dst(m: np.ndarray) -> np.ndarray:
    return _dct(m * _signs(m.shape[-1]))[..., ::-1]


def _idst(m: np.ndarray) -> np.ndarray:
    return _idct(m[..., ::-1]) * _signs(m.shape[-1])


def _dht(m: np.ndarray) -> np.ndarray:
    f = np.fft.fft(m)
    return f.real - f.imag


def _both(fn: Rows) -> Rows:
    """fn over both axes of matrices."""
    return lambda m: np.swapaxes(fn(np.swapaxes(fn(m), -1, -2)), -1, -2)


def _lapped(n: int, sine: bool) -> np.ndarray:
    i, k = np.arange(2 * n)[:, None], np.arange(n)[None, :]
    angle = np.pi / n * (i + 0.5 + n / 2) * (k + 0.5)
    return np.sin(angle) if sine else np.cos(angle)


#: One-dimensional transforms. dct, dst: type II, twice the sum of products; idct, idst undo them. mdct, mdst: 2n values to n, imdct, imdst back with aliases, over n.
TRANSFORMS: dict[str, Rows] = {
    "dct": _dct, "idct": _idct, "dst": _dst, "idst": _idst, "dht": _dht, "idht": lambda m: _dht(m) / m.shape[-1], "fht": _dht,
    "mdct": lambda m: m @ _lapped(m.shape[-1] // 2, False), "imdct": lambda m: m @ _lapped(m.shape[-1], False).T / m.shape[-1],
    "mdst": lambda m: m @ _lapped(m.shape[-1] // 2, True), "imdst": lambda m: m @ _lapped(m.shape[-1], True).T / m.shape[-1],
    "fftshift": lambda m: np.fft.fftshift(m, -1), "ifftshift": lambda m: np.fft.ifftshift(m, -1),
}


def transform(x: Column, name: str) -> Column:
    return rowwise(x, TRANSFORMS[name])


def transform2(x: Column, name: str, rows: int) -> Column:
    """A transform over both axes of matrices of that many rows."""
    return rowwise(x, _plane(_both(TRANSFORMS[name]), rows))


def hilbert(x: Column) -> Column:
    """Imaginary part of the analytic signal."""

    def fn(m: np.ndarray) -> np.ndarray:
        n = m.shape[-1]
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        return np.fft.ifft(np.fft.fft(m) * h).imag

    return rowwise(x, fn)


def next_fast_len(n: int) -> int:
    """The least number from n with no prime factor over 5."""
    while True:
        k = n
        for p in (2, 3, 5):
            while k % p == 0:
                k //= p
        if k == 1:
            return n
        n += 1


def frequencies(n: int, step: float = 1.0, real: bool = False) -> Column:
    """Sample frequencies of fft, or of rfft."""
    return F.array(*[F.lit(float(f)) for f in (np.fft.rfftfreq(n, step) if real else np.fft.fftfreq(n, step))])


#: Weights of the cosine windows (fixed values).
COSINES = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "rectangular": (1.0,)}


def window(name: str, i: Column, n: int) -> Column:
    """Value i of a symmetric window of n."""
    if name == "bartlett":
        return 1 - F.abs(2 * i / (n - 1) - 1)
    if name == "cosine":
        return F.sin(math.pi * (i + 0.5) / n)
    out = F.lit(0.0)
    for k, a in enumerate(COSINES[name]):
        out = out + (-1) ** k * a * F.cos(2 * math.pi * k * i / (n - 1))
    return out


def window_array(name: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: window(name, i, n))


def apply_window(x: Column, name: str, n: int) -> Column:
    return F.zip_with(x, window_array(name, n), lambda a, b: a * b)


def window_properties(name: str, n: int) -> Column:
    """struct: coherent gain, and equivalent noise bandwidth in bins."""
    w = window_array(name, n)
    s = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    q = F.aggregate(w, F.lit(0.0), lambda a, b: a + b * b)
    return F.struct((s / n).alias("coherent_gain"), (n * q / (s * s)).alias("noise_bandwidth"))


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _frames(m: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(m, size, axis=-1)[:, ::step]


def stft(x: Column, size: int, step: int) -> Column:
    """struct<re,im>: periodic Hann frames, their real transforms one behind the other."""
    return complex_rows(x, _zero(x), lambda m: np.fft.rfft(_frames(m.real, size, step) * _hann(size)).reshape(len(m), -1))


def spectrogram(x: Column, size: int, step: int) -> Column:
    """Power of each frame and frequency."""
    return rowwise(x, lambda m: (np.abs(np.fft.rfft(_frames(m, size, step) * _hann(size))) ** 2).reshape(len(m), -1))


def welch(x: Column, size: int, step: int) -> Column:
    """Mean power of the frames by frequency, over the window's energy; inner frequencies count twice."""

    def fn(m: np.ndarray) -> np.ndarray:
        w = _hann(size)
        p = (np.abs(np.fft.rfft(_frames(m, size, step) * w)) ** 2).mean(1) / (w @ w)
        p[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
        return p

    return rowwise(x, fn)


def convolve(x: Column, taps: list[float]) -> Column:
    """Full convolution."""
    return rowwise(x, lambda m: np.stack([np.convolve(r, taps) for r in m]))


def correlate(x: Column, y: list[float]) -> Column:
    """Full cross-correlation."""
    return convolve(x, list(reversed(y)))


def _lfilter(b: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    b, a = b / a[0], a / a[0]
    out = np.zeros_like(m)
    for i in range(m.shape[-1]):
        for k in range(min(i + 1, len(b))):
            out[:, i] += b[k] * m[:, i - k]
        for k in range(1, min(i + 1, len(a))):
            out[:, i] -= a[k] * out[:, i - k]
    return out


def iir(x: Column, b: list[float], a: list[float]) -> Column:
    """Recursive filter from rest."""
    return rowwise(x, lambda m: _lfilter(np.array(b, float), np.array(a, float), m))


def filtfilt(x: Column, b: list[float], a: list[float]) -> Column:
    """The filter forwards and backwards, from rest each time."""
    p, q = np.array(b, float), np.array(a, float)
    return rowwise(x, lambda m: _lfilter(p, q, _lfilter(p, q, m)[:, ::-1])[:, ::-1])


def decimate(x: Column, factor: int) -> Column:
    """Means of `factor` values each; a rest is left out."""
    return rowwise(x, lambda m: m[:, : m.shape[1] // factor * factor].reshape(len(m), -1, factor).mean(2))


def firwin(n: int, cutoff: float) -> list[float]:
    """Low-pass taps under a Hamming window, of unit gain at zero; cutoff over the Nyquist frequency."""
    i = np.arange(n) - (n - 1) / 2
    h = cutoff * np.sinc(cutoff * i) * np.hamming(n)
    return (h / h.sum()).tolist()


def butter2(cutoff: float) -> tuple[list[float], list[float]]:
    """Second-order Butterworth low-pass by the bilinear transform; cutoff over the Nyquist frequency."""
    k = math.tan(math.pi * cutoff / 2)
    norm = 1 + math.sqrt(2) * k + k * k
    return [k * k / norm, 2 * k * k / norm, k * k / norm], [1.0, 2 * (k * k - 1) / norm, (1 - math.sqrt(2) * k + k * k) / norm]


def peaks(x: Column) -> Column:
    """Zero-based places greater than both neighbours."""
    n = F.size(x)
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: (F.get(x, i) > F.get(x, i - 1)) & (F.get(x, i) > F.get(x, i + 1)))


def zero_crossings(x: Column) -> Column:
    """Steps between a negative value and one that isn't."""
    neg = F.transform(x, lambda v: F.when(v < 0, 1).otherwise(0))
    return F.aggregate(F.zip_with(F.slice(neg, F.lit(2), F.size(x) - 1), F.slice(neg, F.lit(1), F.size(x) - 1), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)


def neighbourhood(x: Column, size: int, agg: str) -> Column:
    """Filters over `size` values about each, the ends repeated: median, min, max, uniform."""
    fn = {"median": np.median, "min": np.min, "max": np.max, "uniform": np.mean}[agg]
    half = size // 2
    return rowwise(x, lambda m: fn(np.lib.stride_tricks.sliding_window_view(np.pad(m, ((0, 0), (half, size - 1 - half)), "edge"), size, axis=-1), axis=-1))


def simpson(x: Column, step: float = 1.0) -> Column:
    """Integral of an odd number of equally spaced values."""
    n = F.size(x)
    w = F.transform(x, lambda v, i: v * F.when((i == 0) | (i == n - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0))
    return F.aggregate(w, F.lit(0.0), lambda s, v: s + v) * (step / 3)


def cumulative_trapezoid(x: Column, step: float = 1.0) -> Column:
    return rowwise(x, lambda m: np.cumsum((m[:, 1:] + m[:, :-1]) * (step / 2), axis=1))


def romberg(x: Column, step: float = 1.0) -> Column:
    """Integral of 2^k + 1 equally spaced values."""

    def fn(m: np.ndarray) -> np.ndarray:
        n = m.shape[1] - 1
        row, stride = [], n
        while stride >= 1:
            y = m[:, ::stride]
            new = [(y.sum(1) - (y[:, 0] + y[:, -1]) / 2) * step * stride]
            for j, old in enumerate(row, 1):
                new.append(new[-1] + (new[-1] - old) / (4**j - 1))
            row, stride = new, stride // 2
        return row[-1]

    return scalar(x, fn)


def chirp(t: Column, f0: float, t1: float, f1: float) -> Column:
    """Linear sweep of frequencies."""
    return F.cos(2 * math.pi * (f0 * t + (f1 - f0) / (2 * t1) * t * t))


def square(t: Column, duty: float = 0.5) -> Column:
    return F.when(F.pmod(t / (2 * math.pi), F.lit(1.0)) < duty, 1.0).otherwise(-1.0)


def sawtooth(t: Column) -> Column:
    return 2 * F.pmod(t / (2 * math.pi), F.lit(1.0)) - 1


def ricker(t: Column, a: float) -> Column:
    z = t * t / (a * a)
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - z) * F.exp(-z / 2)
