"""Draws of table numbers in a Pitman-Yor restaurant.

A dish with n customers sits at t tables with probability proportional to S(n, t) * prod_{i<t} (strength + discount *
(others + i)) * base ** t, given the restaurant's other tables; S are generalised Stirling numbers. Up to ``EXACT``
customers the numbers come from their recursion. Beyond, S(n, t) = n! / (t! d**t) * P(t Sibuya variables sum to n): for
many tables that probability is taken at its saddle point, for few the recursion is carried on in closed form. So one
law holds for every n, and a draw costs the same for a thousand customers as for a billion.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, expm1, lgamma, log, sqrt

import numpy as np

EXACT, FEW, TERMS, POINTS = 1024, 32, 200, 256


def _lgamma(x) -> np.ndarray:
    """Log of the gamma function of positive numbers, by Stirling's series eight places further on."""
    x = np.asarray(x, float)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(np.prod([x + i for i in range(8)], 0))


@lru_cache(8)
def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logs of generalised Stirling numbers: row n, column t."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(size):
        with np.errstate(divide="ignore"):
            stay = out[n] + np.log(np.maximum(n - discount * np.arange(size + 1), 0))
        out[n + 1] = stay
        out[n + 1, 1:] = np.logaddexp(stay[1:], out[n, :-1])
    return out


def _few_tables(d: float, n: int, t: np.ndarray) -> np.ndarray:
    """log S(n, t) from row EXACT, for t far below it: with g_t = S(n, t) / gamma(n - d t), g_t' = g_{t-1} (n - d t) ** (d - 1)."""
    at = np.arange(FEW + 1)
    held = stirling(d)[EXACT, : FEW + 1] - _lgamma(EXACT - d * at)
    shift = d * at / 2
    step = np.log(((n - shift) ** d - (EXACT - shift) ** d) / d)
    grown = held[None] + np.where(at[:, None] >= at, (at[:, None] - at) * step[:, None] - _lgamma(np.maximum(at[:, None] - at, 0) + 1), -np.inf)
    return (np.logaddexp.reduce(grown, 1) + _lgamma(n - d * at))[t]


def _many_tables(d: float, n: int, t: np.ndarray) -> np.ndarray:
    """log S(n, t) at the saddle point of the Sibuya sum's generating function (1 - (1 - z) ** d) ** t."""
    low, high = np.full(len(t), -80.0), np.full(len(t), -1e-12)  # bounds of log(1 - z)
    for _ in range(50):
        v = (low + high) / 2
        y, gap = np.exp(v), -np.expm1(d * v)
        mean = d * (1 - y) * np.exp((d - 1) * v) / gap
        up = t * mean > n
        low, high = np.where(up, v, low), np.where(up, high, v)
    z, f = -np.expm1(v), -np.expm1(d * v)
    first = d * np.exp((d - 1) * v)  # f' and f'' in z
    second = d * (1 - d) * np.exp((d - 2) * v)
    spread = z * first / f + z * z * (second / f - (first / f) ** 2)
    density = t * np.log(f) - n * np.log(z) - 0.5 * np.log(2 * np.pi * t * spread)
    return density + lgamma(n + 1) - _lgamma(t + 1.0) - t * log(d)


def _series(d: float, n: int, t: np.ndarray) -> np.ndarray:
    """log S(n, t) as the alternating sum over j of C(t, j) gamma(n - j d) / gamma(-j d), for t small against n ** d."""
    j = np.arange(1, min(TERMS, int(t.max()), int(n / d)) + 1)
    inside = j <= t[:, None]
    left = np.where(inside, t[:, None] - j, 0)
    size = _lgamma(t + 1.0)[:, None] - _lgamma(left + 1.0) + (_lgamma(n - j * d) - lgamma(n - d) + _lgamma(1 + j * d) - _lgamma(j + 1.0))
    total = (np.where(inside, np.exp(size), 0.0) * np.where(j % 2, 1.0, -1.0) * np.sin(np.pi * ((j * d) % 2)) / np.pi).sum(1)
    return np.log(total) + lgamma(n - d) - _lgamma(t + 1.0) - t * log(d)


def log_stirling(d: float, n: int, t: np.ndarray) -> np.ndarray:
    """log S(n, t) for an array of t from 1 to n."""
    if n <= EXACT:
        return stirling(d)[n, t]
    kinds = np.select([t == n, t < 1.2 * n**d, t <= FEW], [0, 1, 2], 3)
    out = np.zeros(len(t))
    for kind, way in ((1, _series), (2, _few_tables), (3, _many_tables)):
        if (kinds == kind).any():
            out[kinds == kind] = way(d, n, t[kinds == kind])
    return out


def log_odds(d: float, strength: float, n: int, base: float, others: float, t: np.ndarray) -> np.ndarray:
    """Log of the unnormalised probability of t tables."""
    a = strength / d + others
    return log_stirling(d, n, t) + _lgamma(a + t) - lgamma(a) + t * (log(d) + log(base))


def _mode(d: float, strength: float, n: int, base: float, others: float) -> int:
    """About the most probable number of tables: where one more changes nothing, at the saddle point that goes with it."""
    a, low, high = strength / d + others, -80.0, -1e-12
    for _ in range(60):
        v = (low + high) / 2
        f = -expm1(d * v)
        t = n * f / (d * -expm1(v) * exp((d - 1) * v))
        low, high = (v, high) if f * base * (a + t) > t else (low, v)
    return min(n, max(1, round(t)))


def _draw_large(d: float, strength: float, n: int, base: float, others: float, rng) -> int:
    """One draw for a dish of many customers, among all numbers of tables whose odds matter."""
    mode = _mode(d, strength, n, base, others)
    width = 16 + int(4 * sqrt(mode))
    while True:
        a, b = max(1, mode - width), min(n, mode + width)
        t = np.unique(np.linspace(a, b, POINTS).astype(np.int64)) if b - a >= POINTS else np.arange(a, b + 1)
        odds = log_odds(d, strength, n, base, others, t)
        top = odds.max()
        if (a == 1 or odds[0] < top - 25) and (b == n or odds[-1] < top - 25):
            break
        mode, width = int(t[odds.argmax()]), 2 * width
    share = np.exp(odds - top) * np.diff(t, append=b + 1)  # a point stands for the numbers up to the next
    at = int(np.searchsorted(np.cumsum(share), rng.random() * share.sum()))
    return int(rng.integers(t[at], t[at + 1] if at + 1 < len(t) else b + 1))


def draw_tables(n: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng, chunk: int = 1 << 20) -> np.ndarray:
    """New table numbers of dishes with ``n`` customers; ``others``: the restaurant's tables of other dishes."""
    out = np.minimum(n, 1)
    many = np.flatnonzero(n > 1)
    many = many[np.argsort(n[many], kind="stable")]
    sizes, first = np.unique(n[many], return_index=True)
    table = stirling(discount) if len(sizes) else None
    for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(many)]):
        if size > EXACT:
            for i in many[a:b].tolist():
                out[i] = _draw_large(discount, strength, size, float(base[i]), float(others[i]), rng)
            continue
        steps, row = np.arange(size), table[size, 1 : size + 1]
        for at in range(a, b, max(1, chunk // size)):
            rows = many[at : min(b, at + max(1, chunk // size))]
            odds = np.cumsum(np.log((strength + discount * (others[rows, None] + steps)) * base[rows, None]), 1) + row
            odds = np.cumsum(np.exp(odds - odds.max(1, keepdims=True)), 1)
            out[rows] = 1 + (odds < odds[:, -1:] * rng.random((len(rows), 1))).sum(1)
    return out
