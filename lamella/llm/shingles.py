"""Sets of word shingles as 64-bit hashes, by whole batches of texts in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z as a-z), and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = ~_SPACE[data]
    change = np.diff(inside.astype(np.int8), prepend=0)
    begin = np.flatnonzero(change == 1)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    length = np.flatnonzero(change == -1) - begin
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    values = BYTE[data[inside]] * powers(_BASE, int(length.max()))[place]
    return mix(np.add.reduceat(values, at) + length.astype(np.uint64)), np.searchsorted(begin, bounds)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer words than width make one shingle, no words none."""
    words, starts = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        joined = joined * _STEP + words[k : k + len(joined)]
    joined = mix(joined)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        else:
            one = np.full(min(1, b - a), b - a, dtype=np.uint64)
            for i in range(a, b):
                one = one * _STEP + words[i : i + 1]
            out.append(mix(one ^ np.uint64(0xA5A5A5A5)))
    return out
