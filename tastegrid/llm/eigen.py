"""Leading eigenpairs of a small symmetric matrix: Householder tridiagonalisation, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, mirrors) of a matrix of the same eigenvalues; mirror k acts on the places from k + 1 on."""
    a, n = a.astype(float).copy(), len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        x[0] += np.copysign(size, x[0])
        norm = np.linalg.norm(x)
        v = x / norm if norm > 0 else x
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x, how many eigenvalues are smaller: the negative terms of the Sturm sequence."""
    tiny = EPS * max(1e-300, np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    q, n = d[0] - x, np.zeros(len(x), int)
    for k in range(len(d)):
        if k:
            q = d[k] - x - e[k - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def largest(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The count largest eigenvalues of the tridiagonal matrix, falling, to the last bit that bisection can tell."""
    radius = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    want = len(d) - 1 - np.arange(count)  # eigenvalues below the one looked for
    lo, hi = np.full(count, (d - radius).min()), np.full(count, (d + radius).max())
    pad = EPS * max(1e-300, np.abs(lo).max(), np.abs(hi).max()) * len(d)
    lo, hi = lo - pad, hi + pad
    while True:
        mid = (lo + hi) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        above = counts_below(d, e, mid) > want
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)


def solve(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray) -> np.ndarray:
    """(T - x I) y = b by elimination with row exchanges; pivots of zero are replaced by tiny ones."""
    n, tiny = len(d), EPS * max(1e-300, np.abs(d).max(), np.abs(e).max(initial=0))
    main, up, up2, y = d - x, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        low = e[k]
        if abs(low) > abs(main[k]):
            main[k], low = low, main[k]
            up[k], main[k + 1] = main[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if abs(main[k]) < tiny:
            main[k] = tiny
        f = low / main[k]
        main[k + 1] -= f * up[k]
        up[k + 1] -= f * up2[k]
        y[k + 1] -= f * y[k]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for k in range(n - 1, -1, -1):
        after = (up[k] * y[k + 1] if k + 1 < n else 0.0) + (up2[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] = (y[k] - after) / main[k]
    return y


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix.

    Vectors of eigenvalues closer than 1e-3 of the matrix's norm to the one before are kept orthogonal to each
    other, so that clusters and multiple eigenvalues have whole bases."""
    count = min(count, len(a))
    scale = np.abs(a).max(initial=0)
    if not count or scale == 0:
        return np.zeros(count), np.eye(len(a))[:, :count]
    d, e, mirrors = tridiagonal(a / scale)
    values = largest(d, e, count)
    norm = max(np.abs(values).max(), EPS)
    rng, out, first = np.random.default_rng(0), np.zeros((len(a), count)), 0
    for k, x in enumerate(values):
        if k and values[k - 1] - x > 1e-3 * norm:
            first = k
        shift = x - (k - first) * 4 * EPS * norm  # equal values: not the same solution again
        y = rng.normal(size=len(a))
        for _ in range(6):
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
            y = solve(d, e, shift, y / np.linalg.norm(y))
            y /= np.abs(y).max()
        for _ in range(2):
            y -= out[:, first:k] @ (out[:, first:k].T @ y)
        out[:, k] = y / np.linalg.norm(y)
    for k in range(len(mirrors) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ out[k + 1 :])
    return values * scale, out / np.linalg.norm(out, axis=0)
