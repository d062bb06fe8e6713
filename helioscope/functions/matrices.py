"""Square matrices in array columns, row behind row: one matrix a row of the table, the rows of a batch decomposed together in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from helioscope.functions.signals import rowwise, scalar


def _square(m: np.ndarray) -> np.ndarray:
    n = round(m.shape[1] ** 0.5)
    return m.reshape(len(m), n, n)


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(len(m), -1)


def det(a: Column) -> Column:
    return scalar(a, lambda m: np.linalg.det(_square(m)))


def inv(a: Column) -> Column:
    """Inverse; the pseudo-inverse of a singular matrix."""
    return rowwise(a, lambda m: _flat(np.linalg.pinv(_square(m))))


pinv = inv


def trace(a: Column, n: int) -> Column:
    out = F.lit(0.0)
    for i in range(n):
        out = out + F.get(a, F.lit(i * (n + 1)))
    return out


def matrix_rank(a: Column) -> Column:
    return scalar(a, lambda m: np.linalg.matrix_rank(_square(m)))


def cond(a: Column) -> Column:
    return scalar(a, lambda m: np.linalg.cond(_square(m)))


def eigvalsh(a: Column) -> Column:
    """Rising eigenvalues of symmetric matrices."""
    return rowwise(a, lambda m: np.linalg.eigvalsh(_square(m)))


def svdvals(a: Column) -> Column:
    """Falling singular values."""
    return rowwise(a, lambda m: np.linalg.svd(_square(m), compute_uv=False))


def solve(a: Column, b: Column) -> Column:
    """x of a x = b; least squares where a is singular. a and b are joined in one array for the batch."""

    def fn(m: np.ndarray) -> np.ndarray:
        n = round((np.sqrt(1 + 4 * m.shape[1]) - 1) / 2)
        return np.einsum("rij,rj->ri", np.linalg.pinv(m[:, : n * n].reshape(-1, n, n)), m[:, n * n :])

    return rowwise(F.concat(a, b), fn)


lstsq = solve


def cholesky(a: Column) -> Column:
    """Lower factor of positive definite matrices."""
    return rowwise(a, lambda m: _flat(np.linalg.cholesky(_square(m))))


def qr(a: Column) -> tuple[Column, Column]:
    """Orthogonal and upper factors, the diagonal of the latter positive."""

    def parts(m: np.ndarray, first: bool) -> np.ndarray:
        q, r = np.linalg.qr(_square(m))
        s = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
        return _flat(q * s[:, None, :]) if first else _flat(r * s[:, :, None])

    return rowwise(a, lambda m: parts(m, True)), rowwise(a, lambda m: parts(m, False))


def lu(a: Column) -> tuple[Column, Column]:
    """Unit lower and upper factors without exchanges; null factors where a pivot is zero."""

    def parts(m: np.ndarray, lower: bool) -> np.ndarray:
        u = _square(m).copy()
        n = u.shape[1]
        l_ = np.broadcast_to(np.eye(n), u.shape).copy()
        for k in range(n):
            f = u[:, k + 1 :, k] / np.where(u[:, k, k] == 0, np.nan, u[:, k, k])[:, None]
            l_[:, k + 1 :, k] = f
            u[:, k + 1 :] -= f[:, :, None] * u[:, k, None, :]
        return _flat(l_ if lower else u)

    return rowwise(a, lambda m: parts(m, True)), rowwise(a, lambda m: parts(m, False))


def matmul(a: Column, b: Column) -> Column:
    def fn(m: np.ndarray) -> np.ndarray:
        half = m.shape[1] // 2
        return _flat(_square(m[:, :half]) @ _square(m[:, half:]))

    return rowwise(F.concat(a, b), fn)


def transpose(a: Column) -> Column:
    return rowwise(a, lambda m: _flat(np.swapaxes(_square(m), 1, 2)))


def power_iteration(a: Column, steps: int = 100) -> Column:
    """Size of the greatest eigenvalue."""

    def fn(m: np.ndarray) -> np.ndarray:
        s = _square(m)
        v = np.ones((len(s), s.shape[1]))
        for _ in range(steps):
            w = np.einsum("rij,rj->ri", s, v)
            v = w / np.maximum(np.linalg.norm(w, axis=1), 1e-300)[:, None]
        return np.linalg.norm(np.einsum("rij,rj->ri", s, v), axis=1)

    return scalar(a, fn)


def conjugate_gradient(a: Column, b: Column, steps: int) -> Column:
    """x of a x = b for positive definite matrices, after `steps`."""

    def fn(m: np.ndarray) -> np.ndarray:
        n = round((np.sqrt(1 + 4 * m.shape[1]) - 1) / 2)
        s, r = m[:, : n * n].reshape(-1, n, n), m[:, n * n :].copy()
        x, p = np.zeros_like(r), r.copy()
        for _ in range(steps):
            q, old = np.einsum("rij,rj->ri", s, p), (r * r).sum(1)
            alpha = old / np.maximum((p * q).sum(1), 1e-300)
            x, r = x + alpha[:, None] * p, r - alpha[:, None] * q
            p = r + ((r * r).sum(1) / np.maximum(old, 1e-300))[:, None] * p
        return x

    return rowwise(F.concat(a, b), fn)


def attention(q: Column, k: Column, v: Column, causal: bool = False) -> Column:
    """Scaled dot-product attention of square matrices (positions by features); causal: only positions up to the row's own."""

    def fn(m: np.ndarray) -> np.ndarray:
        a, b, c = (_square(x) for x in np.split(m, 3, axis=1))
        n = a.shape[1]
        s = a @ np.swapaxes(b, 1, 2) / np.sqrt(n)
        s = np.where(np.tri(n, dtype=bool), s, -np.inf) if causal else s
        w = np.exp(s - s.max(2, keepdims=True))
        return _flat(w / w.sum(2, keepdims=True) @ c)

    return rowwise(F.concat(q, k, v), fn)
