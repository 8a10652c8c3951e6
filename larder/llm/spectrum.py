"""Eigendecompositions that take in one vector at a time: numpy on one small matrix, used inside tasks.

A spectrum is (weight, mean, values, vectors) of the scatter of the vectors seen so far. A new vector moves
the mean and adds a rank-one term; `updated` solves the secular equation of that term.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def empty(size: int) -> tuple:
    return 0.0, np.zeros(size), np.zeros(size), np.eye(size)


def updated(values, vectors, direction, factor: float):
    """Eigenvalues, ascending, and eigenvectors of V diag(values) V' + factor * direction direction', factor >= 0.

    Deflation: directions along which the term has no part stay as they are; eigenvectors of equal values are
    reflected so that only one of them has a part.
    """
    z = vectors.T @ direction
    norm = float(np.sqrt(z @ z))
    if factor <= 0 or norm == 0:
        return values, vectors
    rho, z = factor * norm * norm, z / norm
    limit = 8 * EPS * max(values[-1], rho)
    new = np.flatnonzero(np.diff(values) > limit) + 1
    edges = np.concatenate(([0], new, [len(values)]))
    if len(edges) <= len(values):
        vectors = vectors.copy()
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:  # equal values: one reflection turns their part of z to the last of them
                part = z[a:b].copy()
                size = np.sqrt(part @ part)
                part[-1] += np.copysign(size, part[-1])
                length = part @ part
                if length > 0:
                    vectors[:, a:b] -= np.outer(vectors[:, a:b] @ part, part * (2 / length))
                    last = z[b - 1]
                    z[a:b] = 0
                    z[b - 1] = -np.copysign(size, last)
    live = np.flatnonzero(np.abs(z) * rho > limit)
    if not len(live):
        return values, vectors
    roots, turned = _secular(values[live], z[live], rho)
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[live] = roots
    out_vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


def _secular(d, z, rho: float):
    """Roots of 1 + rho * sum(z^2 / (d - x)) = 0 for ascending d, and the eigenvectors in d's coordinates.

    Each root is kept as its distance to the nearer pole. z is computed anew from the roots, so the vectors are
    orthogonal even where roots lie close together.
    """
    k = len(d)
    z2 = rho * z * z
    total = float(z2.sum())
    gap = np.append(np.diff(d), total)  # the last root lies at most that far beyond the last pole
    middle = d + gap / 2
    at_middle = 1 + (z2 / (d[None, :] - middle[:, None])).sum(1)
    upper = at_middle < 0  # then the root lies in the upper half, beside the next pole
    upper[-1] = False
    base = np.arange(k) + upper
    apart = d[None, :] - d[base][:, None]  # pole j seen from the base of root i
    low = np.where(upper, -gap / 2, 0.0)
    high = np.where(upper, 0.0, gap / 2)
    high[-1] = gap[-1]
    x = (low + high) / 2
    below = np.tri(k, dtype=bool)  # poles up to the root's own
    own, following = apart[np.arange(k), np.arange(k)], apart[np.arange(k), np.minimum(np.arange(k) + 1, k - 1)]
    with np.errstate(all="ignore"):
        for _ in range(100):
            delta = apart - x[:, None]
            term = z2 / delta
            slope = term / delta
            left, right = np.where(below, term, 0).sum(1), np.where(below, 0, term).sum(1)
            f = 1 + left + right
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            done = (np.abs(f) <= EPS * k * (1 + np.abs(left) + np.abs(right))) | (high - low <= 2 * EPS * np.abs(x))
            if done.all():
                break
            # the root of c + p / (own pole - y) + q / (next pole - y), which has f's value and both slopes here
            own_slope, next_slope = np.where(below, slope, 0).sum(1), np.where(below, 0, slope).sum(1)
            p, q = own - x, following - x
            c = f - p * own_slope - q * next_slope
            a = (p + q) * f - p * q * (own_slope + next_slope)
            b = p * q * f
            c[-1], a[-1], b[-1] = 0, 1, 0
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = f[-1] * p[-1] / (f[-1] - p[-1] * own_slope[-1])  # the last root has one pole
            near = x + step
            x = np.where(done | (near == x), x, np.where(np.isfinite(near) & (near > low) & (near < high), near, (low + high) / 2))
    delta = apart - x[:, None]  # pole j minus root i
    roots = d[base] + x
    # z that has exactly these roots: for pole j, the product of (root - pole j) over (another pole - pole j),
    # each pole above j beside the root before it, each pole below j beside its own root
    poles = d[:, None] - d[None, :]
    away = -delta[:-1].T
    others = np.where(np.arange(k)[:, None] > np.arange(k - 1), -poles[:, :-1], -poles[:, 1:])
    fresh = np.sqrt(np.abs(np.prod(away / others, 1) * delta[-1]))
    fresh = np.copysign(fresh, z)
    turned = fresh[:, None] / delta.T
    return roots, turned / np.sqrt((turned * turned).sum(0))


def with_vector(spectrum: tuple, x) -> tuple:
    """The spectrum after one more vector: a centred rank-one update."""
    weight, mean, values, vectors = spectrum
    away = x - mean
    values, vectors = updated(values, vectors, away, weight / (weight + 1))
    return weight + 1, mean + away / (weight + 1), values, vectors


def merged(one: tuple, other: tuple) -> tuple:
    """The spectrum of both: a rank-one update by each eigenpair of the other, and one by the difference of means."""
    if not one[0] or not other[0]:
        return one if one[0] else other
    weight, mean, values, vectors = one
    for value, vector in zip(other[2], other[3].T):
        if value > 0:
            values, vectors = updated(values, vectors, vector, float(value))
    away, total = other[1] - mean, weight + other[0]
    values, vectors = updated(values, vectors, away, weight * other[0] / total)
    return total, mean + away * (other[0] / total), values, vectors
