"""Symmetric eigendecompositions brought up to date by rank-one terms.

``V diag(d) V' + rho x x'`` has the eigenvalues that solve the secular equation
``1 + rho sum_i z_i^2 / (d_i - t) = 0`` with ``z = V' x``, one between each two old ones.
Entries of ``z`` that do not matter, and all but one of those that share an eigenvalue, are
deflated: their eigenpairs stay. Eigenvectors are taken from the ``z`` for which the
computed roots are exact, which keeps them orthogonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(np.float64).eps
STEPS = 100


def secular_roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``d_i - t_j`` for the roots ``t_j`` of ``1 + sum_i w_i / (d_i - t)``, as a matrix.

    ``d`` ascends strictly and ``w`` is positive. A root is found as a distance from the nearer
    end of its interval, so differences to that end lose no digits. Steps solve the equation
    with the two nearest poles kept and the others replaced by a constant; a step that
    leaves the bracket, and every other late one, is a bisection.
    """
    k = len(d)
    each = np.arange(k)
    after = np.append(d[1:], d[-1] + w.sum())
    half = (after - d) / 2
    # From here on the root is in the left or the right half of its interval.
    left = 1 + (w[:, None] / (d[:, None] - (d + half))).sum(0) >= 0
    near = np.where(left | (each == k - 1), each, np.minimum(each + 1, k - 1))
    delta = d[:, None] - d[near]
    low = np.where(left, 0.0, np.where(each == k - 1, half, -half))
    high = np.where(left, half, np.where(each == k - 1, 2 * half, 0.0))
    t = (low + high) / 2
    done = np.zeros(k, bool)
    for step in range(STEPS):
        gap = delta - t
        terms = w[:, None] / gap
        f = 1 + terms.sum(0)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        done |= np.abs(f) <= 4 * EPS * k * (1 + np.abs(terms).sum(0))
        done |= high - low <= 4 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            return gap
        slopes = np.cumsum(terms / gap, 0)
        before = slopes[each, each]
        behind = slopes[-1] - before
        one, two = gap[each, each], gap[np.minimum(each + 1, k - 1), each]
        c = f - one * before - two * behind
        a = (one + two) * f - one * two * (before + behind)
        b = one * two * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move[-1] = one[-1] + before[-1] * one[-1] ** 2 / (f[-1] - one[-1] * before[-1])  # one pole only
            new = t + move
        bad = ~((new > low) & (new < high))
        if step > 10 and step % 2:
            bad[:] = True
        t = np.where(done, t, np.where(bad, (low + high) / 2, new))
    raise ArithmeticError("the secular equation was not solved")


def _inner(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(d) + rho z z'``, without anything to deflate."""
    k = len(d)
    if k == 1:
        return d + rho * z * z, np.ones((1, 1))
    gap = secular_roots(d, rho * z * z)
    # z for which the roots are exact, each factor near 1.
    places = np.arange(k)
    between = d[None, :] - d[:, None]
    lower = places[None, :] < places[:, None]
    shifted = np.append(between[:, 1:], np.ones((k, 1)), 1)
    size = np.prod(-gap / np.where(lower, between, shifted), 1)
    vectors = (np.sign(z) * np.sqrt(np.abs(size)))[:, None] / gap
    vectors /= np.sqrt((vectors * vectors).sum(0))
    nearest = np.abs(gap).argmin(0)
    return d[nearest] - gap[nearest, places], vectors


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors after adding ``rho x x'``, ``rho`` not negative."""
    z = x @ vectors
    norm = float(np.sqrt(z @ z))
    scale = rho * norm * norm
    if scale == 0:
        return values, vectors
    z, values, vectors = z / norm, values.copy(), vectors.copy()
    least = 8 * EPS * max(abs(values[0]), abs(values[-1]), scale)
    close = np.diff(values) <= least
    if close.any():
        edges = np.flatnonzero(~close) + 1
        for group in np.split(np.arange(len(values)), edges):
            part = z[group]
            length = float(np.sqrt(part @ part))
            if len(group) > 1 and scale * length > least:  # a reflection brings all of it to the last one
                mirror = part.copy()
                mirror[-1] += length if part[-1] >= 0 else -length
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, group] -= 2 * np.outer(vectors[:, group] @ mirror, mirror)
                z[group] = 0.0
                z[group[-1]] = -length if part[-1] >= 0 else length
    used = np.flatnonzero(scale * np.abs(z) > least)
    if len(used):
        values[used], inner = _inner(values[used], z[used], scale)
        vectors[:, used] = vectors[:, used] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen: how many, their exact sums, and the eigendecomposition of their centred sum of squares."""

    n: int
    sums: np.ndarray  # of Python integers
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, object), np.zeros(width), np.eye(width))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add_rows(self, rows: np.ndarray) -> None:
        """Add rows of integers, each as one centred rank-one term."""
        n = self.n
        mean = self.mean() if n else np.zeros(rows.shape[1])
        for row in rows.astype(np.float64):
            away = row - mean
            if n:
                self.values, self.vectors = rank_one(self.values, self.vectors, away, n / (n + 1))
            n += 1
            mean = mean + away / n
        self.n = n
        self.sums = self.sums + exact_sums(rows)

    def merge(self, other: Spectrum) -> None:
        """Add another's rows: a term for each of its eigenpairs, and one for the distance of the means."""
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
            return
        if not other.n:
            return
        terms = [(other.vectors[:, i], max(float(v), 0.0)) for i, v in enumerate(other.values)]
        terms.append((other.mean() - self.mean(), self.n * (other.n / (self.n + other.n))))
        for x, rho in terms:
            self.values, self.vectors = rank_one(self.values, self.vectors, x, rho)
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums of integers as Python integers."""
    if len(rows) == 0 or np.abs(rows).max(initial=0) < (1 << 62) // len(rows):
        return rows.sum(0).astype(object)
    return rows.astype(object).sum(0)
