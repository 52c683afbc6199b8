"""Vectorised kernels over the code points of one text."""

from __future__ import annotations

from functools import cache

import numpy as np

_N = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))


@cache
def _table(kind: str) -> np.ndarray:
    return np.fromiter(map(getattr(str, kind), map(chr, range(_N))), bool, _N)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alpha(codes: np.ndarray) -> np.ndarray:
    return _table("isalpha")[codes]


def alnum(codes: np.ndarray) -> np.ndarray:
    return _table("isalnum")[codes]


def upper(codes: np.ndarray) -> np.ndarray:
    return _table("isupper")[codes]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, _INV)):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, from prefix sums of a polynomial modulo 2**64."""
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(text: str) -> np.ndarray:
    """Hashes of the words: maximal runs of letters and digits, in lower case."""
    codes = points(text.lower())
    return span_hashes(codes, *runs(alnum(codes)))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of all words if there are fewer; none if there is no word."""
    w = words(text or "")
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h))
