"""Depth-first numbers of a taxonomy as arrays: lowest common ancestors, ancestor tests and path scores.

A node's *entry* is its place in depth-first order, its *last* the largest entry below it.  A node is above
another where the other's entry lies between its entry and its last.  The lowest common ancestor of any set
is that of its least and its largest entry ``a < b``, and it is the least parent among the entries in
``a + 1 .. b``: a range minimum, answered by a sparse table over blocks.  Entry 0 is no node.

The arrays take at most 24 bytes a node and are broadcast up to :data:`TREE_NODES` nodes, which is counted
first.
"""

from __future__ import annotations

import numpy as np

#: Nodes whose arrays are broadcast at most: some 300 MB.
TREE_NODES = 12_000_000
BLOCK = 32


class Tree:
    """``entry`` by node number; ``above``, ``last`` and ``ext`` (external id) by entry."""

    def __init__(self, entry: np.ndarray, above: np.ndarray, last: np.ndarray, ext: np.ndarray):
        self.entry, self.above, self.last, self.ext = entry, above, last, ext
        self._derive()

    @classmethod
    def of(cls, node, parent, entry, last, ext) -> Tree:
        """From columns of the nodes, in any order."""
        n = len(node)
        entry_of = np.zeros(n + 1, np.int32)
        entry_of[node] = entry
        above, last_at, ext_at = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
        above[entry], last_at[entry], ext_at[entry] = entry_of[parent], last, ext
        return cls(entry_of, above, last_at, ext_at if n and ext_at.max() >= 1 << 32 else ext_at.astype(np.uint32))

    def _derive(self) -> None:
        n = len(self.above)
        self.node = np.zeros(n, np.int32)
        self.node[self.entry[1:]] = np.arange(1, n)
        padded = np.full(-(-n // BLOCK) * BLOCK, n, np.int32)
        padded[:n] = self.above
        grid = padded.reshape(-1, BLOCK)
        self.to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_start = np.minimum.accumulate(grid, axis=1).ravel()
        self.tables = [grid.min(axis=1)]
        while 2 << (len(self.tables) - 1) <= len(grid):
            half, t = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(t[:-half], t[half:]))

    def __getstate__(self):
        return self.entry, self.above, self.last, self.ext

    def __setstate__(self, state):
        self.entry, self.above, self.last, self.ext = state
        self._derive()

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self.__getstate__())

    def _least_above(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of ``above`` over ``lo .. hi``."""
        out = np.empty(len(lo), np.int64)
        left, right = lo // BLOCK, hi // BLOCK
        far = left < right
        out[far] = np.minimum(self.to_end[lo[far]], self.from_start[hi[far]])
        wide = np.flatnonzero(right - left > 1)
        level = np.frexp((right[wide] - left[wide] - 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = wide[level == k]
            t = self.tables[k]
            out[at] = np.minimum(out[at], np.minimum(t[left[at] + 1], t[right[at] - (1 << int(k))]))
        near = np.flatnonzero(~far)
        if len(near):
            out[near] = self.above[lo[near]]
            for step in range(1, int((hi[near] - lo[near]).max()) + 1):
                at = near[lo[near] + step <= hi[near]]
                out[at] = np.minimum(out[at], self.above[lo[at] + step])
        return out

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of the lowest common ancestors of pairs of entries; 0 is neutral."""
        lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        out = hi.copy()
        two = np.flatnonzero((lo > 0) & (lo < hi))
        out[two] = self._least_above(lo[two] + 1, hi[two])
        return out

    def resolve(self, group: np.ndarray, entry: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The call (an entry) of every group ``0 .. len(need) - 1`` from its hits ``(group, entry, n)``, all different.

        Of the entries with the heaviest path from the root, ties by their common ancestor, the call is the
        first one upwards whose clade has ``need`` hits, or 0; groups without hits have 0.
        """
        out = np.zeros(len(need), np.int64)
        if not len(entry):
            return out
        order = np.lexsort((entry, group))
        group, entry, n = group[order].astype(np.int64), entry[order].astype(np.int64), n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        rank = np.repeat(np.arange(len(first)), size)
        width = len(self.above) + 1
        key = rank * width + entry
        sums = np.concatenate(([0], np.cumsum(n)))
        ends = rank * width + self.last[entry]
        by_end = np.argsort(ends, kind="stable")
        ends, end_sums = ends[by_end], np.concatenate(([0], np.cumsum(n[by_end])))
        # hits up to an entry, without those whose clade ends before it, are the hits on its path
        start = np.repeat(first, size)
        score = sums[np.arange(len(n)) + 1] - sums[start] - (end_sums[np.searchsorted(ends, key, "left")] - end_sums[start])
        tied = score == np.repeat(np.maximum.reduceat(score, first), size)
        lo = np.minimum.reduceat(np.where(tied, entry, width), first)
        call = self.lca(lo, np.maximum.reduceat(np.where(tied, entry, 0), first))
        wanted = need[group[first]]
        todo = np.flatnonzero(wanted > 0)
        while len(todo):
            at, base = call[todo], todo * width
            below = sums[np.searchsorted(key, base + self.last[at], "right")] - sums[np.searchsorted(key, base + at, "left")]
            todo = todo[below < wanted[todo]]
            call[todo] = self.above[call[todo]]
            todo = todo[call[todo] > 0]
        out[group[first]] = call
        return out
