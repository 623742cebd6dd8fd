"""Vectorised word and shingle hashing over batches of normalised texts.

A normalised text is lower case with single spaces between words. Whole batches are hashed with a polynomial prefix
sum over bytes, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

TOKEN_BITS = 44
_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> bytes:
    """Lower case, words separated by one space each; only spaces, tabs and line breaks separate."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) if text else b""


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every normalised text, and the number of words of each text."""
    counts = np.fromiter((r.count(b" ") + 1 for r in raw), np.int64, len(raw))
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.flatnonzero(a == 32)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * _power(_P, len(a)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_P_INV, len(a))[starts]), counts


def shingle_tokens(texts: list[bytes], words: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, token of TOKEN_BITS bits) of each run of that many words, repeats included.

    Texts of different seeds have no token in common.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = h[:n].copy()
    for k in range(1, words):
        s = s * _MUL + h[k : n + k]
    inside = doc[:n] == doc[words - 1 :]
    if seeds is not None:
        s = s + seeds[doc[:n]]
    return doc[:n][inside], mix(s[inside]) >> np.uint64(64 - TOKEN_BITS)


def slices(texts: list[bytes], chars: int = 1_000_000, most: int = 4096):
    """Ranges of the list of bounded total length, to keep the working arrays within the caches."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and (size + len(t) > chars or k - at >= most):
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
