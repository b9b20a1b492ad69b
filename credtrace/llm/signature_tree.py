"""Signature trees over shingle sets, and the dual traversal that finds the links between two of them."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 32, 8


def signature(members: np.ndarray, bits: int) -> np.ndarray:
    """How many of the hashes fall on each bit of a bitmap; the low bits of a hash choose."""
    return np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)


class Tree:
    """Levels of nodes from leaves of up to LEAF sets to a single root.

    A node holds the OR of its sets' bitmaps, their smallest and largest size, the most hashes that share a bit, and the
    component of its sets, or -1 where they differ.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, bits: int):
        sizes = np.array([len(s) for s in sets])
        self.order = np.lexsort(([int(s[0]) for s in sets], sizes))
        counts = [signature(sets[k], bits) for k in self.order]
        bitmaps = np.array([np.packbits(c > 0).view(np.uint64) for c in counts])
        load = np.array([c.max() for c in counts], dtype=np.int64)
        sizes, labels = sizes[self.order], labels[self.order]
        level = self._merged(LEAF, bitmaps, sizes, sizes, load, labels)
        self.levels = [level]
        while len(level[0]) > 1:
            level = self._merged(FAN, *level)
            self.levels.append(level)

    @staticmethod
    def _merged(fan, bitmaps, low, high, load, labels):
        at = np.arange(0, len(bitmaps), fan)
        least, most = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
        return (np.bitwise_or.reduceat(bitmaps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(load, at), np.where(least == most, least, -1))

    def leaf(self, node: int) -> np.ndarray:
        return self.order[node * LEAF:(node + 1) * LEAF]


def promising(one, a, two, b, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: enough overlap is possible and not all sets are of one component."""
    shared = np.bitwise_count(one[0][a] & two[0][b]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(one[2][a], two[2][b]), shared * np.minimum(one[3][a], two[3][b]))
    least = one[1][a] + two[1][b]
    return (most * (100 + percent) >= percent * least) & ((one[4][a] != two[4][b]) | (one[4][a] < 0))


def leaf_pairs(left: Tree, right: Tree, percent: int, same: bool):
    """Pairs of leaves that survive the traversal from both roots down, in blocks of node pairs."""
    depth = max(len(left.levels), len(right.levels))
    stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        one, two = left.levels[min(level, len(left.levels) - 1)], right.levels[min(level, len(right.levels) - 1)]
        keep = promising(one, a, two, b, percent) & ((a <= b) | (not same))
        a, b = a[keep], b[keep]
        if level == 0:
            yield from zip(a.tolist(), b.tolist())
            continue
        grow_a, grow_b = level < len(left.levels), level < len(right.levels)
        for k in range(0, len(a), 4096):
            x, y = a[k:k + 4096], b[k:k + 4096]
            steps = np.arange(FAN)
            i = x[:, None, None] * FAN + steps[None, :, None] if grow_a else np.repeat(x[:, None, None], 1, 1)
            j = y[:, None, None] * FAN + steps[None, None, :] if grow_b else np.repeat(y[:, None, None], 1, 2)
            i, j = np.broadcast_arrays(i, j)
            i, j = i.ravel(), j.ravel()
            inside = (i < len(left.levels[min(level - 1, len(left.levels) - 1)][0])) & (
                j < len(right.levels[min(level - 1, len(right.levels) - 1)][0]))
            stack.append((level - 1, i[inside], j[inside]))


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of one sorted set with each of the others."""
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    starts = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat(one[at] == flat, starts, dtype=np.int64)


def links(sets: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, percent: int):
    """Links that join different components: between side 0 and side 1, and among sets of side 2.

    Pairs that earlier links join already are passed over: what comes out spans the components, and has fewer links than
    there are sets.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for label, member in zip(labels.tolist(), ids.tolist()):
        parent[root(member)] = root(label)
    groups = [np.flatnonzero(sides == s) for s in range(3)]
    bits = 1 << max(10, int(4 * max(map(len, sets))).bit_length())
    trees = [Tree([sets[k] for k in g], labels[g], bits) if len(g) else None for g in groups]
    for left, right in ((0, 1), (2, 2)):
        if trees[left] is None or trees[right] is None:
            continue
        same = left == right
        for x, y in leaf_pairs(trees[left], trees[right], percent, same):
            mine, theirs = groups[left][trees[left].leaf(x)], groups[right][trees[right].leaf(y)]
            for n, k in enumerate(mine):
                rest = theirs[n + 1:] if same and x == y else theirs
                own = root(int(ids[k]))
                rest = [r for r in rest if root(int(ids[r])) != own and
                        100 * min(len(sets[r]), len(sets[k])) >= percent * max(len(sets[r]), len(sets[k]))]
                if not rest:
                    continue
                common = overlaps(sets[k], [sets[r] for r in rest])
                for r, c in zip(rest, common.tolist()):
                    if 100 * c >= percent * (len(sets[k]) + len(sets[r]) - c) and root(int(ids[r])) != root(int(ids[k])):
                        parent[root(int(ids[r]))] = root(int(ids[k]))
                        yield int(ids[k]), int(ids[r])
