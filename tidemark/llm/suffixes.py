"""Suffix arrays of regions of text, with merge-scans for equal windows and geometric merging of levels.

A level holds regions (byte strings) and the starts of their distinct windows in lexicographic order of the window's
bytes. Windows are compared by their bytes alone; nothing here is hashed.
"""

from __future__ import annotations

import numpy as np

#: Windows compared at once, which bounds the bytes that a comparison copies.
CHUNK = 8192


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer that sorts as they do."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[at].astype(np.uint64)


def common_prefix(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many of the first bytes of the windows a[x:] and b[y:] agree, length at most."""
    out = np.full(len(x), length, np.int64)
    wide_a, wide_b = (np.lib.stride_tricks.as_strided(d, (len(d) - length + 1, length), (1, 1)) for d in (a, b))
    for lo in range(0, len(x), CHUNK):
        differ = wide_a[x[lo : lo + CHUNK]] != wide_b[y[lo : lo + CHUNK]]
        first = differ.argmax(1)
        some = differ[np.arange(len(first)), first]
        out[lo : lo + CHUNK][some] = first[some]
    return out


def sorted_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in order of their windows' bytes, whether each equals the one before); data has eight bytes to spare."""
    first = _word(data, starts)
    order = np.argsort(first, kind="stable")
    starts, first = starts[order], first[order]
    same = np.r_[False, first[1:] == first[:-1]]  # ties so far
    equal = np.zeros(len(starts), bool)
    open_ = np.flatnonzero(same | np.r_[same[1:], False])
    depth = 8
    while len(open_):
        group = np.cumsum(~same[open_]) - 1
        heads = np.flatnonzero(~same[open_])
        if depth < 24 <= length:  # plain words part most groups at once
            at = np.full(len(open_), depth)
            depth += 8
        else:
            agreed = common_prefix(data, starts[open_], data, starts[open_][heads][group], length)
            at = np.minimum.reduceat(agreed, heads)[group]
            done = at >= length
            equal[open_[done & same[open_]]] = True
            open_, group, at = open_[~done], group[~done], at[~done]
            if not len(open_):
                break
        own = starts[open_]
        key = _word(data, own + at)
        beyond = np.maximum(0, at + 8 - length).astype(np.uint64)  # bytes after the window don't count
        key = (key >> (beyond * np.uint64(8))) << (beyond * np.uint64(8))
        by = np.lexsort((key, group))
        starts[open_] = own[by]
        key, group = key[by], group[by]
        same[open_] = np.r_[False, (key[1:] == key[:-1]) & (group[1:] == group[:-1])]
        tied = same[open_] | np.r_[same[open_][1:], False]
        open_ = open_[tied]
    return starts, equal


class Level:
    """Regions with the suffix array of their distinct windows; regions are known by rows of three integers."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, names: np.ndarray, order: np.ndarray, length: int):
        self.data, self.sizes, self.names, self.order, self.length = data, sizes, names, order, length

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def build(regions: list[bytes], names: np.ndarray, length: int) -> tuple[Level, np.ndarray]:
        """The level of new regions, and the starts of windows that occur twice or more in them."""
        data = np.frombuffer(b"".join([*regions, bytes(length + 8)]), np.uint8)
        sizes = np.array([len(r) for r in regions], np.int64)
        counts = np.maximum(sizes - length + 1, 0)
        base = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
        starts, equal = sorted_windows(data, base + np.arange(int(counts.sum())), length)
        twice = equal | np.r_[equal[1:], False]
        return Level(data, sizes, names, starts[~equal], length), starts[twice]

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of other's array, its place in this one's and whether an equal one stands there."""
        words, wanted = _word(self.data, self.order), _word(other.data, other.order)
        low, high = np.searchsorted(words, wanted, "left"), np.searchsorted(words, wanted, "right")
        equal = np.zeros(len(wanted), bool)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            x, y = self.order[middle], other.order[open_]
            at = common_prefix(self.data, x, other.data, y, self.length)
            found = at >= self.length
            equal[open_[found]] = True
            low[open_[found]] = high[open_[found]] = middle[found]
            at = np.where(found, 0, at)
            less = ~found & (self.data[x + at] < other.data[y + at])
            low[open_[less]] = middle[less] + 1
            more = ~found & ~less
            high[open_[more]] = middle[more]
            open_ = open_[low[open_] < high[open_]]
        return low, equal

    def merged(self, other: Level, low: np.ndarray, equal: np.ndarray) -> Level:
        """This level with other's regions and windows, by the places that a scan gave."""
        size = len(self.data) - self.length - 8
        order = np.insert(self.order, low[~equal], other.order[~equal] + size)
        return Level(np.concatenate([self.data[:size], other.data]), np.r_[self.sizes, other.sizes], np.concatenate([self.names, other.names]), order, self.length)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.data.tobytes(), self.sizes.astype("<i4").tobytes(), self.names.astype("<i8").tobytes(), self.order.astype("<u4").tobytes()

    @staticmethod
    def unpack(data: bytes, sizes: bytes, names: bytes, order: bytes, length: int) -> Level:
        return Level(np.frombuffer(data, np.uint8), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(names, "<i8").reshape(-1, 3), np.frombuffer(order, "<u4").astype(np.int64), length)

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names of regions, first and last start within each) for runs of neighbouring starts."""
        if not len(starts):
            return np.zeros((0, 3), np.int64), starts, starts
        starts = np.unique(starts)
        offsets = self.offsets
        of = np.searchsorted(offsets, starts, side="right") - 1
        begins = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(of) != 0)])
        ends = np.r_[begins[1:], len(starts)] - 1
        region = of[begins]
        return self.names[region], starts[begins] - offsets[region], starts[ends] - offsets[region]
