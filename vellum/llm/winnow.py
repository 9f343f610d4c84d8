"""Sampled anchors of fixed-length windows: equal windows have equal anchors at equal offsets."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_CHUNK = 1 << 20
_A = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(v: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k values, by doubling."""
    out, have, span, power, size = None, 0, v, _A, 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                n = len(v) - have - size + 1
                out = span[:n] if out is None else out[:n] * power + span[have : have + n]
                have += size
            if 2 * size > k:
                return out
            span = span[:-size] * power + span[size:]
            power, size = power * power, 2 * size


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    m, size = x, 1
    while 2 * size <= w:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return np.minimum(m[: len(x) - w + 1], m[w - size :]) if w > size else m


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_A), -1, 1 << 64))
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones * _A, ones * inverse
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Segments:
    """Runs of window starts that share an anchor: lo to hi, anchored at p with hash h.

    ``sig`` is a hash of all that the windows of the segment cover, and of their places.
    """

    h: np.ndarray
    sig: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    p: np.ndarray


def span_hashes(v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of v[begin:end] for each pair."""
    up, down = _powers(1 << max(12, int(len(v)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v) * up[: len(v)], dtype=np.uint64)])
    return (sums[end] - sums[begin]) * down[begin]


def segments(v: np.ndarray, window: int, gram: int) -> Segments:
    """The segments of a sequence of unit hashes; none if it is shorter than a window.

    A window's anchor is its gram with the least hash, the first on a tie. So it depends on the
    window's content alone, and equal windows meet at it.
    """
    parts = []
    for s in range(0, max(0, len(v) - window + 1), _CHUNK):
        x = v[s : s + _CHUNK + window - 1]
        g = mix(rolling(x, gram))
        a = (sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), window - gram + 1) & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        hi = np.concatenate([lo[1:], [len(a)]]) - 1
        p = a[lo]
        shape = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (p - lo).astype(np.uint64)
        sig = mix(span_hashes(x, lo, hi + window) ^ mix(shape))
        parts.append((g[p], sig, lo + s, hi + s, p + s))
    if not parts:
        e = np.zeros(0, np.int64)
        return Segments(e.astype(np.uint64), e.astype(np.uint64), e, e, e)
    return Segments(*(np.concatenate(c) for c in zip(*parts, strict=True)))
