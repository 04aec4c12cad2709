"""SetSketch: registers that hold exponentially spaced, truncated minima of a set's hash values.

Register i of a set holds K_i = floor(1 - log_b(h_i)), cut to 0..q + 1, with h_i the least of the set's
exponentially distributed values for i. Registers of a union are the larger of each pair, so sketches
merge; two registers are equal about as often as the sets' Jaccard similarity, so bands of them serve as
locality-sensitive keys. See O. Ertl, SetSketch: Filling the Gap between MinHash and HyperLogLog, 2021.
"""

from __future__ import annotations

import numpy as np

from arbolex.llm.textarrays import mix

M = 128
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2


def sketch(elements: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """uint16 registers, one row of m for each set elements[bounds[i]:bounds[i + 1]] of 64-bit hashes.

    An element's values for all registers ascend in a pseudo-random order of registers; a set's element
    is done as soon as its next value is above all minima so far, so that large sets cost little more
    than one value an element.
    """
    sets = len(bounds) - 1
    least = np.full(sets * m, np.inf)
    row = np.repeat(np.arange(sets), np.diff(bounds))
    h = elements.astype(np.uint64)
    place, step = mix(h ^ np.uint64(0xA0761D6478BD642F)), mix(h ^ np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    x = np.zeros(len(h))
    for j in range(m):
        u = (mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64)
        x = x - np.log((u + 0.5) / (1 << 53)) / (m - j)
        np.minimum.at(least, row * m + (place & np.uint64(m - 1)).astype(np.int64), x)
        most = least.reshape(sets, m).max(1)
        alive = x < most[row]
        if not alive.any():
            break
        h, row, x, place, step = h[alive], row[alive], x[alive], place[alive], step[alive]
        place = place + step
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16).reshape(sets, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets: rows of registers, and the sets' sizes.

    The counts of greater, smaller and equal registers are multinomial with probabilities
    p(u - vJ), p(v - uJ) and the rest, p(x) = -log_b(1 - x (b - 1) / b), u and v the sizes' shares.
    The likelihood is concave in J; a ternary search finds its maximum in 0..min(u / v, v / u).
    """
    greater, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - greater - smaller
    u = size_a / (size_a + size_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((greater, up), (smaller, down), (equal, 1 - up - down))]
        return sum(terms)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        third = (high - low) / 3
        left, right = low + third, high - third
        rise = likelihood(left) < likelihood(right)
        low, high = np.where(rise, left, low), np.where(rise, high, right)
    return (low + high) / 2
