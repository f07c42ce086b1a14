"""Vectorised 64-bit hashes of bytes, words and word shingles."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E6C63D0676A9A99)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def powers(n: int, which: str = "base") -> np.ndarray:
    have = _POWERS[which]
    if len(have) < n:
        step = np.full(max(n, 1 << 18), BASE if which == "base" else BASE_INVERSE, np.uint64)
        step[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power before each position; data are unsigned bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, the same for equal bytes wherever they stand."""
    inverse = powers(len(sums), "inverse")
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    space = _SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(space & np.r_[False, word[:-1]]) if len(data) else np.zeros(0, np.int64)
    hashes = range_hashes(prefix_sums(data), starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(starts, bounds)])
    return hashes, counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; all its words as one if they are fewer than size."""
    words, counts = word_hashes(texts)
    factors = powers(size + 1)[1:]
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled += words[j : j + n] * factors[j]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(rolled[at : at + c - size + 1]))
        elif c:
            own = (words[at : at + c] * factors[:c]).sum(dtype=np.uint64)
            out.append(mix(np.array([own ^ np.uint64(0xA5A5A5A5 * (c + 1))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
