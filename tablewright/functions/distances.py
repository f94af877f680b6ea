"""Distances between two small blocks of points, used inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np

# fixed values: metric names; those in one line mean the same
ALIASES = {
    "euclidean": "euclidean", "l2": "euclidean", "nan_euclidean": "euclidean", "minkowski": "minkowski",
    "manhattan": "manhattan", "l1": "manhattan", "cityblock": "manhattan",
    "chebyshev": "chebyshev", "cosine": "cosine", "correlation": "correlation", "sqeuclidean": "sqeuclidean",
    "canberra": "canberra", "braycurtis": "braycurtis", "hamming": "hamming",
}




def cross_distances(a: np.ndarray, b: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """len(a) × len(b) distances, one dimension at a time so memory stays at one matrix."""
    out = np.zeros((len(a), len(b)))
    other = np.zeros_like(out) if metric == "braycurtis" else None
    for j in range(a.shape[1]):
        x, y = a[:, j, None], b[None, :, j]
        diff = np.abs(x - y)
        if metric == "euclidean":
            out += diff * diff
        elif metric == "manhattan":
            out += diff
        elif metric == "chebyshev":
            np.maximum(out, diff, out=out)
        elif metric == "minkowski":
            out += diff ** p
        elif metric == "hamming":
            out += diff != 0
        elif metric == "canberra":
            size = np.abs(x) + np.abs(y)
            out += np.divide(diff, size, out=np.zeros_like(diff), where=size > 0)
        elif metric == "braycurtis":
            out += diff
            other += np.abs(x + y)
        else:
            raise ValueError(f"unknown metric {metric}")
    if metric == "euclidean":
        return np.sqrt(out)
    if metric == "minkowski":
        return out ** (1.0 / p)
    if metric == "hamming":
        return out / a.shape[1]
    if metric == "braycurtis":
        return np.divide(out, other, out=np.zeros_like(out), where=other > 0)
    return out


MANY_DIMENSIONS = 8  # from here on a matrix product is the faster way to Euclidean distances
_DOUBT = 1e-3  # share of the squared lengths below which a product has lost digits to cancellation


def pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Euclidean distances of chosen pairs, summed over dimensions in the order that ``cross_distances`` takes."""
    out = np.zeros(len(rows))
    for j in range(a.shape[1]):
        diff = a[rows, j] - b[cols, j]
        out += diff * diff
    return np.sqrt(out)


def product_distances(a: np.ndarray, b: np.ndarray, limit: float | None = None) -> np.ndarray:
    """Euclidean distances by one matrix product, to about eleven digits.

    Pairs so close together that the product loses digits, and those that it cannot tell from ``limit``, are computed by their
    differences, so that copies have distance 0 and ``d <= limit`` holds for the same pairs as with ``cross_distances``.
    """
    centre = b.mean(axis=0) if len(b) else 0.0
    x, y = a - centre, b - centre
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    if not len(a) or not len(b) or not np.isfinite(nx.max() + ny.max()):
        return cross_distances(a, b, "euclidean")
    d = x @ y.T
    d *= -2.0
    d += nx[:, None]
    d += ny
    size = (nx + ny.max())[:, None]
    doubt = d <= _DOUBT * size
    if limit is not None and np.isfinite(limit):
        gap = 1e-12 * (size + limit * limit)
        doubt |= (d >= limit * limit - gap) & (d <= limit * limit + gap)
    np.maximum(d, 0.0, out=d)
    np.sqrt(d, out=d)
    rows, cols = np.nonzero(doubt)
    if 8 * len(rows) > d.size:
        return cross_distances(a, b, "euclidean")
    d[rows, cols] = pair_distances(a, b, rows, cols)
    return d


class Space:
    """A metric as (row transform, true metric for pruning, conversion to the asked distance)."""

    def __init__(self, metric: str, p: float = 2.0):
        name = ALIASES.get(metric)
        if name is None:
            raise ValueError(f"unsupported metric {metric}; choose one of {sorted(ALIASES)}")
        self.name, self.p = name, p
        self.base = "euclidean" if name in ("cosine", "correlation", "sqeuclidean") else name
        # Bray-Curtis breaks the triangle inequality, Minkowski does below p = 1
        self.prunable = not (name == "braycurtis" or (name == "minkowski" and p < 1))
        # the distance is at least the difference in any one coordinate
        self.by_coordinate = self.base in ("euclidean", "manhattan", "chebyshev") or (name == "minkowski" and p >= 1)

    def rows(self, m: np.ndarray) -> np.ndarray:
        if self.name == "correlation":
            m = m - m.mean(axis=1, keepdims=True)
        if self.name in ("cosine", "correlation"):
            size = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(size == 0, 1.0, size)
        return m

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return cross_distances(a, b, self.base, self.p)

    def quick(self, a: np.ndarray, b: np.ndarray, limit: float | None = None) -> np.ndarray:
        """``between`` to about eleven digits where that is faster; comparisons with ``limit`` come out alike."""
        if self.base != "euclidean" or a.shape[1] < MANY_DIMENSIONS:
            return self.between(a, b)
        return product_distances(a, b, limit)

    def outward(self, d: np.ndarray) -> np.ndarray:
        if self.name == "sqeuclidean":
            return d * d
        return d * d / 2 if self.name in ("cosine", "correlation") else d

    def inward(self, d: float) -> float:
        """A distance in the asked metric as one in the pruning metric."""
        if self.name == "sqeuclidean":
            return float(np.sqrt(d))
        return float(np.sqrt(2 * d)) if self.name in ("cosine", "correlation") else float(d)
