"""Signature trees over token sets: OR-combined bitmaps and size ranges, and the dual traversal that links similar sets."""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Node:
    """A run of sets (in the tree's order) with the OR of their bitmaps, their range of sizes and the most tokens that share bits."""

    __slots__ = ("bits", "excess", "first", "high", "kids", "last", "low")

    def __init__(self, first: int, last: int, bits: np.ndarray, low: int, high: int, excess: int, kids: list[Node]) -> None:
        self.first, self.last, self.bits, self.low, self.high, self.excess, self.kids = first, last, bits, low, high, excess, kids


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Join:
    """Links sets with den * |x & y| >= num * |x | y|, up to connectivity: pairs already in one component are not examined again.

    ``resident`` sets have been joined with each other before; only pairs with another set are looked at.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int, resident: np.ndarray | None = None) -> None:
        self.num, self.den = num, den
        sizes = np.array([len(s) for s in sets], np.int64)
        lead = np.array([int(s[0]) >> 1 if len(s) else 0 for s in sets], np.int64)
        self.order = np.lexsort((lead, sizes))  # similar sets mostly share their least token, and so a leaf
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        self.resident = np.zeros(len(sets), bool) if resident is None else resident[self.order]
        self.label = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []
        self.examined = 0

    def similar(self, i: int, j: int) -> bool:
        a, b = int(self.sizes[i]), int(self.sizes[j])
        if not a or min(a, b) * self.den < self.num * max(a, b):
            return False
        self.examined += 1
        both = _common(self.sets[i], self.sets[j])
        return self.den * both >= self.num * (a + b - both)

    def link(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.links.append((int(self.order[i]), int(self.order[j])))

    def tree(self) -> Node:
        n = len(self.sets)
        bits = 256
        while bits < 4 * int(self.sizes.max(initial=0)) and bits < 1 << 16:
            bits *= 2
        maps = np.zeros((n, bits), bool)
        for i, s in enumerate(self.sets):
            maps[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        self.maps = np.packbits(maps, axis=1).view(np.uint64)
        ones = np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.excess = self.sizes - ones
        level = []
        for first in range(0, n, FANOUT):
            last = min(n, first + FANOUT)
            level.append(Node(first, last, np.bitwise_or.reduce(self.maps[first:last]), int(self.sizes[first]), int(self.sizes[last - 1]), int(self.excess[first:last].max()), []))
        while len(level) > 1:
            groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
            level = [Node(g[0].first, g[-1].last, np.bitwise_or.reduce([k.bits for k in g]), g[0].low, g[-1].high, max(k.excess for k in g), g) for g in groups]
        return level[0]

    def hopeless(self, a: Node, b: Node) -> bool:
        """Whether no set below a can link with one below b: sizes too far apart, or too few bits for the least overlap asked for.

        Common tokens fall on common bits; a bit holds one of a set's tokens, but for the set's excess of tokens over bits.
        """
        if a.high * self.den < self.num * b.low or b.high * self.den < self.num * a.low:
            return True
        most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
        return most * (self.num + self.den) < self.num * (a.low + b.low)

    def settled(self, a: Node, b: Node) -> bool:
        """Whether all sets below both nodes are in one component already, or were joined before."""
        if self.resident[a.first : a.last].all() and self.resident[b.first : b.last].all():
            return True
        own = self.label[a.first]
        return bool((self.label[a.first : a.last] == own).all() and (self.label[b.first : b.last] == own).all())

    def leaves(self, a: Node, b: Node) -> None:
        for i in range(a.first, a.last):
            for j in range(max(b.first, i + 1) if a is b else b.first, b.last):
                if self.label[i] == self.label[j] or self.resident[i] and self.resident[j]:
                    continue
                lost = int(np.bitwise_count(self.maps[i] & ~self.maps[j]).sum())
                if (int(self.sizes[i]) - lost) * (self.num + self.den) >= self.num * int(self.sizes[i] + self.sizes[j]) and self.similar(i, j):
                    self.link(i, j)

    def run(self) -> list[tuple[int, int]]:
        """Pairs of positions that link, as a spanning forest of the components."""
        n = len(self.sets)
        if n == 2:
            if not self.resident.all() and self.similar(0, 1):
                self.link(0, 1)
            return self.links
        for i in range(1, n):  # neighbours first, so that the traversal meets few open pairs
            for j in {i - 1, 0}:
                if not (self.resident[i] and self.resident[j]) and self.label[i] != self.label[j] and self.similar(i, j):
                    self.link(i, j)
        root = self.tree()
        todo = [(root, root)]
        while todo:
            a, b = todo.pop()
            if self.settled(a, b) or self.hopeless(a, b):
                continue
            if a is b:
                if a.kids:
                    todo += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
                else:
                    self.leaves(a, a)
            elif a.kids and (not b.kids or a.last - a.first >= b.last - b.first):
                todo += [(x, b) for x in a.kids]
            elif b.kids:
                todo += [(a, y) for y in b.kids]
            else:
                self.leaves(a, b)
        return self.links
