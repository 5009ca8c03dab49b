"""Trees of many sentences at once, in numpy: linking, enumeration, query matching, identity of trees.

The tokens that hang on a root are numbered in preorder, sentence after sentence, dependents in surface order. A subtree is
then a run of numbers, and a match a row of a matrix whose columns rise: its head, then its other nodes, each after its own
head. All matches of one size are one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Heads whose partial trees or query matches are built at once.
HEADS = 20_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count c, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def linked(sent: np.ndarray, ids: np.ndarray, heads: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each token's head as a token, -1 for a root; from a sentence's first token without a head on, and where the head isn't in the sentence, -2."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    key = (sent.astype(np.int64) << 32) + ids
    order = np.argsort(key, kind="stable")
    asked = (sent.astype(np.int64) << 32) + heads
    at = np.searchsorted(key[order], asked, "right") - 1
    there = (at >= 0) & (key[order][at] == asked)
    out = np.where(there, order[at], -2)
    out[heads == 0] = -1
    lost = np.cumsum(~known)
    start = np.searchsorted(sent, sent)  # of its sentence
    out[lost - np.where(start > 0, lost[start - 1], 0) > 0] = -2
    return out


class Forest:
    """sent, parent: of each token (see linked()). All further arrays are by preorder number."""

    def __init__(self, sent: np.ndarray, parent: np.ndarray) -> None:
        n = len(parent)
        order = np.argsort(parent, kind="stable")
        order = order[np.searchsorted(parent[order], 0) :]
        first = np.searchsorted(parent[order], np.arange(n))
        count = np.searchsorted(parent[order], np.arange(n), "right") - first
        level, levels = np.flatnonzero(parent == -1), []
        while len(level):
            levels.append(level)
            c = count[level]
            level = order[np.repeat(first[level], c) + runs(c)]
        size, pre, depth = np.ones(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        for level in reversed(levels[1:]):
            size += np.bincount(parent[level], size[level], n).astype(np.int64)
        for d, level in enumerate(levels):
            own = size[level]
            before = np.cumsum(own) - own
            if d:  # less what lies before the first sibling
                c = count[levels[d - 1]]
                begin = (np.cumsum(c) - c)[c > 0]
                pre[level] = pre[parent[level]] + 1 + before - np.repeat(before[begin], c[c > 0])
                depth[level] = d
            else:
                pre[level] = before
        self.token = np.argsort(pre, kind="stable")[np.count_nonzero(pre < 0) :]
        t = self.token
        self.parent = np.where(parent[t] >= 0, pre[parent[t]], -1)
        self.size, self.depth, self.sent, self.n = size[t], depth[t], sent[t], len(t)
        self.count = count[t]
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids[np.searchsorted(self.parent[kids], 0) :]
        self.first = np.searchsorted(self.parent[self.kids], np.arange(self.n))
        begins = np.searchsorted(self.sent, self.sent)
        self.post = np.arange(self.n) - begins + self.size - 1 - self.depth

    def _children(self, nodes: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, child) of the nodes' children, or those with a number above after."""
        first, count = self.first[nodes], self.count[nodes]
        if after is not None and len(self.kids):
            # Kids are sorted by parent and number, so places in the list of both rise together.
            key = self.parent[self.kids] * (self.n + 1) + self.kids
            begin = np.searchsorted(key, nodes * (self.n + 1) + after, "right")
            first, count = begin, np.maximum(first + count - begin, 0)
        row = np.repeat(np.arange(len(nodes)), count)
        return row, self.kids[np.repeat(first, count) + runs(count)]

    def complete(self, heads: np.ndarray, low: int, high: int, allowed: np.ndarray | None) -> Iterator[np.ndarray]:
        """Of heads each with all that is below it, if it has low to high nodes and all edges below are allowed."""
        fine = (self.size[heads] >= low) & (self.size[heads] <= high)
        if allowed is not None:
            bad = np.concatenate([[0], np.cumsum(~allowed)])
            fine &= bad[heads + self.size[heads]] == bad[heads + 1]
        heads = heads[fine]
        for k in np.unique(self.size[heads]).tolist():
            v = heads[self.size[heads] == k]
            for i in range(0, len(v), step := max(1, 2_000_000 // k)):
                yield v[i : i + step, None] + np.arange(k)

    def partial(self, heads: np.ndarray, low: int, high: int, allowed: np.ndarray | None) -> Iterator[np.ndarray]:
        """Of heads each with every connected set of low to high nodes under it.

        A set grows by a child of one of its nodes that comes after all of them, so that each is made once.
        """
        for i in range(0, len(heads), HEADS):
            sets = heads[i : i + HEADS, None]
            for k in range(1, high + 1):
                if k >= low and len(sets):
                    yield sets
                if k == high or not len(sets):
                    break
                more = []
                for j in range(k):
                    row, child = self._children(sets[:, j], None if j == k - 1 else sets[:, -1])
                    if allowed is not None:
                        row, child = row[allowed[child]], child[allowed[child]]
                    more.append(np.concatenate([sets[row], child[:, None]], 1))
                sets = np.concatenate(more)

    def matches(self, heads: np.ndarray, parents: list[int], fits: list[np.ndarray], exact: bool, allowed: np.ndarray | None) -> Iterator[np.ndarray]:
        """Every set of nodes that a query covers with distinct nodes for distinct query nodes.

        Query nodes are in preorder: parents their heads' places, fits what they admit. exact: a node has no other dependents than the query's.
        """
        kids = np.bincount([p for p in parents if p >= 0], minlength=len(parents))
        enough = [f & (self.count == k if exact else self.count >= k) for f, k in zip(fits, kids.tolist())]
        heads = heads[enough[0][heads]]
        for i in range(0, len(heads), HEADS):
            rows = heads[i : i + HEADS, None]
            for q in range(1, len(parents)):
                row, child = self._children(rows[:, parents[q]])
                fine = enough[q][child]
                if allowed is not None:
                    fine &= allowed[child]
                for s in range(1, q):
                    if parents[s] == parents[q]:
                        fine &= rows[row, s] != child
                rows = np.concatenate([rows[row[fine]], child[fine, None]], 1)
            if len(rows):
                yield np.unique(np.sort(rows, 1), axis=0)

    def links(self, nodes: np.ndarray) -> np.ndarray:
        """For each node of each match the column of its head; 0 for the match's head."""
        m, k = nodes.shape
        out = np.zeros((m, k), np.int64)
        if k > 1 and (nodes[:, -1] - nodes[:, 0] == k - 1).all():
            out[:, 1:] = self.parent[nodes[:, 1:]] - nodes[:, :1]
            return out
        for j in range(1, k):
            above = self.parent[nodes[:, j]]
            for c in range(j):
                out[:, j] += np.where(nodes[:, c] == above, c, 0)
        return out

    def without(self, nodes: np.ndarray, ignored: np.ndarray) -> np.ndarray:
        """Which nodes stay if dependents of ignored labels go, with what hangs on them."""
        above = self.links(nodes)
        kept = np.ones(nodes.shape, bool)
        rows = np.arange(len(nodes))
        for j in range(1, nodes.shape[1]):
            kept[:, j] = kept[rows, above[:, j]] & ~ignored[nodes[:, j]]
        return kept


def packed(name: np.ndarray, rel: np.ndarray, above: np.ndarray, place: np.ndarray, names: int, rels: int) -> np.ndarray:
    """A number for each match that holds all of its ordered tree, of so many names and labels. See packs()."""
    m, k = name.shape
    n, r, c = (max(0, x - 1).bit_length() for x in (names, rels, k))
    out = np.full(m, k, np.uint64)
    for j in range(k):
        rank = sum(((place[:, i] < place[:, j]).astype(np.uint64) for i in range(k) if i != j), np.zeros(m, np.uint64))
        for x, bits in ((name[:, j], n), (rank, c), *(((rel[:, j], r), (above[:, j], c)) if j else ())):
            out <<= np.uint64(bits)
            out |= x.astype(np.uint64)
    return out


def packs(k: int, names: int, rels: int) -> bool:
    """Whether ordered trees of k nodes fit into 64 bits."""
    n, r, c = (max(0, x - 1).bit_length() for x in (names, rels, k))
    return k <= 6 and 3 + k * (n + c) + (k - 1) * (r + c) <= 64


def identity(name: np.ndarray, rel: np.ndarray, above: np.ndarray, place: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each match, equal for equal trees; ordered: with the order of the words.

    name, rel, above (column of the head) and place (in the text) are matrices of the matches' shape.
    """
    m, k = name.shape
    if not ordered:
        a, b = branches(name, rel, above)
        return mix(a[:, 0] + np.uint64(k)), mix(b[:, 0] + np.uint64(k))
    out = []
    for seed in _SEEDS:
        c = _factors(seed)
        total = np.full(m, k, np.uint64)
        rank = np.argsort(np.argsort(place, 1), 1) if k > 6 else sum((place[:, [i]] < place).astype(np.int64) for i in range(k))
        for j in range(k):
            x = name[:, j].astype(np.uint64) * c[0] + above[:, j].astype(np.uint64) * c[2] + rank[:, j].astype(np.uint64) * c[3] + np.uint64(j)
            if j:
                x += rel[:, j].astype(np.uint64) * c[1]
            total = mix(total + mix(x))
        out.append(total)
    return out[0], out[1]


_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def _factors(seed: int) -> list[np.uint64]:
    return [np.uint64(int(x)) for x in mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)]


def branches(name: np.ndarray, rel: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each node of each match, equal for equal branches whatever their order."""
    rows, out = np.arange(len(name)), []
    for seed in _SEEDS:
        c = _factors(seed)
        sums = mix(name.astype(np.uint64) * c[0] + c[3])
        for j in range(name.shape[1] - 1, 0, -1):
            sums[rows, above[:, j]] += mix(mix(sums[:, j]) + rel[:, j].astype(np.uint64) * c[1])
        out.append(sums)
    return out[0], out[1]


def first_of_each(a: np.ndarray, b: np.ndarray, *ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group in it, first): groups of equal (a, b) and the row of each that comes first by ranks."""
    order = np.argsort(a, kind="stable" if ranks else None)
    same = a[order][1:] == a[order][:-1]
    if (same & (b[order][1:] != b[order][:-1])).any():
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same])) if len(a) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(a))))
    best = np.ones(len(a), bool)
    for rank in ranks:
        r = np.where(best, rank[order], np.iinfo(np.int64).max)
        best &= r == np.minimum.reduceat(r, start)[group] if len(start) else best
    at = np.flatnonzero(best)
    first = order[at[np.searchsorted(group[at], np.arange(len(start)))]] if len(start) else start
    return order, start, first


def ties(nodes_places: list[np.ndarray], longest: int) -> np.ndarray:
    """A number for each match by which matches under one head are ordered: as the lists of their nodes' places are."""
    width = max((p.shape[1] for p in nodes_places), default=1)
    bits = max(1, int(longest + 1).bit_length())
    sorted_ = [np.sort(p, 1) for p in nodes_places]
    if bits * width <= 62:
        return np.concatenate([sum(((p[:, j] + 1) << (bits * (width - 1 - j)) for j in range(p.shape[1])), np.zeros(len(p), np.int64)) for p in sorted_])
    whole = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=-1) for p in sorted_])
    order = np.lexsort(whole.T[::-1])
    out = np.empty(len(whole), np.int64)
    out[order] = np.arange(len(whole))
    return out


Test = Callable[[object], np.ndarray]
