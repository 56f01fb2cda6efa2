"""Hashes of the words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; words are sums of them times powers of an odd base, modulo 2**64.
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of texts whose powers a worker keeps: 16 bytes each.
KEPT = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; kept for the next call unless there are more than KEPT."""
    if len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    size = max(n + 1, 1 << 16)
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    if size <= KEPT:
        _powers[:] = made
    return made[0][: n + 1], made[1][: n + 1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): words are runs of bytes other than ASCII white space."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    space = _SPACE[buffer]
    step = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    up, down = _power(len(buffer))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buffer] * up[: len(buffer)], dtype=np.uint64)])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashed, np.searchsorted(start, bounds)


def batches_of(texts: list[str | None], limit: int = 1 << 20):
    """Slices of the texts as bytes, of about limit bytes at most unless one text is longer; ASCII letters lower-cased."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words: one for the whole sequence; none: empty."""
    word, first = words(texts)
    n = np.diff(first)
    rolled = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        rolled += word[j : j + len(rolled)] * _PLACES[j]
    rolled = mix(rolled)
    out = []
    for a, m in zip(first.tolist(), n.tolist(), strict=False):
        if m >= k:
            out.append(np.unique(rolled[a : a + m - k + 1]))
        elif m:
            out.append(mix(np.array([(word[a : a + m] * _PLACES[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
