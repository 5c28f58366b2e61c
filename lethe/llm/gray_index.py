"""Hierarchical Hamming index over fingerprints in Gray order, for many groups of fingerprints at once.

A group's fingerprints are sorted by their rank in the reflected Gray code, where neighbours share most bits.  FAN
neighbours make a node; it holds the bits in which all of them agree, as a mask and a pattern, and FAN nodes make a node
of the next level up to one root a group.  A node's own bits are those that its parent doesn't hold yet.  A search starts
at the root, adds up the differences in the nodes' own bits on the way down and leaves a node, with the whole group below
it, as soon as the sum exceeds the bound; at a leaf the sum is the Hamming distance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

FAN = 4
QUERIES = 1 << 15  # searched at once


class Level(NamedTuple):
    own: np.ndarray  # bits shared by all members that the parent doesn't hold
    pattern: np.ndarray  # their values (other bits are arbitrary)
    first: np.ndarray  # first child, in nodes of the level below; one more entry at the end
    last: np.ndarray  # last member, in places of the fingerprints


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit word in the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over codes sorted by group and, within it, by Gray rank; bounds: the groups' starts and the end."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes, bounds
        full = np.full(len(codes), ~np.uint64(0))
        masks, patterns, levels = [full], [codes], [Level(full, codes, np.arange(len(codes) + 1), np.arange(len(codes)))]
        sizes = np.diff(bounds)
        while (sizes > 1).any():
            above = -(-sizes // FAN)  # nodes of each group one level up
            node = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
            first = np.repeat(np.cumsum(sizes) - sizes, above) + node * FAN
            mask, pattern = masks[-1], patterns[-1]
            size = np.diff(np.append(first, len(mask)))
            lead = pattern[first]
            shared = mask & ~(pattern ^ np.repeat(lead, size))
            masks.append(np.bitwise_and.reduceat(shared, first))
            patterns.append(lead)
            levels.append(Level(masks[-1], lead, np.append(first, len(mask)), levels[-1].last[np.append(first[1:], len(mask)) - 1]))
            sizes = above
        for k in range(len(levels) - 1):
            parent = np.repeat(masks[k + 1], np.diff(levels[k + 1].first))
            levels[k] = levels[k]._replace(own=masks[k] & ~parent)
        self.levels = levels

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (a, b), a < b, of all codes of one group that differ in at most `most` bits."""
        found = [self._search(np.arange(lo, min(lo + QUERIES, len(self.codes))), most) for lo in range(0, len(self.codes), QUERIES)]
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _search(self, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        node = np.searchsorted(self.bounds, query, "right") - 1  # a group's root has the group's number
        apart = np.zeros(len(query), np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            apart = apart + np.bitwise_count((self.codes[query] ^ level.pattern[node]) & level.own[node])
            near = (apart <= most) & (level.last[node] > query)
            query, node, apart = query[near], node[near], apart[near]
            if k:
                count = level.first[node + 1] - level.first[node]
                child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                query, apart, node = np.repeat(query, count), np.repeat(apart, count), np.repeat(level.first[node], count) + child
        return query, node


def least_members(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n places the place of its component's member that comes first by `order`, over the links (a, b)."""
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    label = rank.copy()
    at = np.argsort(rank)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[at[label]])
        if (label == before).all():
            return at[label]
