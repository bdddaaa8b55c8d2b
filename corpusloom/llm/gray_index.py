"""Hierarchical index over binary codes in Gray order, in numpy.

Codes are sorted by Gray rank, so that neighbours share most bits. Sixteen at a time get a parent that holds the bits in which
they all agree (mask and pattern); a child keeps only the bits its parents don't have. A search walks down from the top, adds
up the differences over the masks and drops a node, with all below it, once the sum passes the radius. One index can hold many
runs of codes, one after another, that are only compared among themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (rows of 64-bit words, most significant first) in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    odd = np.zeros(len(codes), bool)
    for k in range(codes.shape[1]):
        rank[odd, k] = ~rank[odd, k]
        odd ^= (np.bitwise_count(codes[:, k]) & 1).astype(bool)
    return rank


def gray_order(codes: np.ndarray) -> np.ndarray:
    return np.lexsort(gray_rank(codes).T[::-1])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    def __init__(self, codes: np.ndarray, runs: np.ndarray | None = None):
        """codes: (n, words); runs: a number for each, rising. Codes stand in Gray order within each run, and only codes of one run are
        neighbours: a node knows the last run below it, and is dropped for queries of a later one."""
        full = np.full_like(codes, ~np.uint64(0))
        runs = np.zeros(len(codes), np.int64) if runs is None else runs
        levels, last = [(codes, full)], [runs]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            starts = np.arange(0, len(pattern), FAN)
            alike = np.bitwise_and.reduceat(mask, starts) & ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
            levels.append((np.bitwise_and.reduceat(pattern, starts) & alike, alike))
            last.append(np.maximum.reduceat(last[-1], starts))
        self.runs, self.last = runs, last
        self.sizes = [len(p) for p, _ in levels]
        self.patterns = [p for p, _ in levels]
        self.masks = [m & ~np.repeat(levels[k + 1][1], FAN, axis=0)[: len(m)] if k + 1 < len(levels) else m for k, (_, m) in enumerate(levels)]

    def lower_neighbours(self, radius: int | np.ndarray, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of pairs (i, j), j < i, of all codes of one run at most radius apart (one for all, or one for each code), and their
        distances. A block of queries meets at most about room candidates a level, or is a single query."""
        codes, top, n = self.patterns[0], len(self.sizes) - 1, self.sizes[0]
        radius = np.broadcast_to(np.asarray(radius, np.int64), n)
        fresh = np.flatnonzero(np.diff(self.runs, prepend=self.runs[:1] - 1))
        ahead_of = np.arange(n) - np.repeat(fresh, np.diff(np.append(fresh, n)))
        met = np.cumsum(ahead_of + FAN * (top + 1))
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(met, (met[start - 1] if start else 0) + room, "right")))
            asked, start = np.arange(start, end), end
            q, node = np.repeat(asked, self.sizes[top]), np.tile(np.arange(self.sizes[top]), len(asked))
            sum_ = np.zeros(len(q), np.int64)
            for level in range(top, -1, -1):
                # Dropped: nodes whose codes stand at or after the query, or are all of runs before its own.
                there = (node * FAN**level < q) & (self.last[level][node] >= self.runs[q])
                q, node, sum_ = q[there], node[there], sum_[there]
                sum_ = sum_ + np.bitwise_count((codes[q] ^ self.patterns[level][node]) & self.masks[level][node]).sum(axis=1, dtype=np.int64)
                near = sum_ <= radius[q]
                q, node, sum_ = q[near], node[near], sum_[near]
                if level:
                    children = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, sum_ = np.repeat(q, FAN), np.repeat(sum_, FAN)
                    there = children < self.sizes[level - 1]
                    q, node, sum_ = q[there], children[there], sum_[there]
            yield q, node, sum_


class Forest:
    """Union-find over numpy arrays of pairs; roots are the least members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            high, low = np.maximum(a, b), np.minimum(a, b)
            apart = high != low
            a, b = high[apart], low[apart]
            np.minimum.at(p, a, b)
            while not np.array_equal(q := p[p], p):
                p = q
        self.parent = p
