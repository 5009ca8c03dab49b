"""Rendering of many trees of one size at once: texts are made of numbered pieces that are laid out in numpy and joined in Arrow.

Trees are rows of matrices as in forest: columns are nodes, each after its head, dependents of one head in surface order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .trees import LETTERS, label


def joined(texts: pa.Array, codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts of so many pieces each, one after the other in codes."""
    flat = texts.take(pa.array(codes))
    return pc.cast(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat), pa.scalar("", pa.large_string())), pa.string())


def lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of int."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]).astype(np.int32)), pa.array(matrix.ravel().astype(np.int32)))


def layout(above: np.ndarray, left: np.ndarray | None, turn: np.ndarray | None, brackets: bool, outer: bool = True) -> tuple[np.ndarray, ...]:
    """(place of each node, of the edge to its head, of its brackets, whether it has any, and pieces of each tree).

    left: whose text comes before its head's; turn: columns without the first in the order in which dependents follow each
    other. Without brackets there are no edges either: places are those of the nodes in the text. outer: brackets of the head.
    """
    m, k = above.shape
    rows, edge = np.arange(m), int(brackets)
    heads = [above[:, j] for j in range(k)]
    opens = np.zeros((m, k), np.int64)
    if brackets:
        for j in range(1, k):
            opens[rows, heads[j]] = 1
        if not outer:
            opens[:, 0] = 0
    width = 1 + 2 * opens
    before = np.zeros((m, k), np.int64)
    for j in range(k - 1, 0, -1):
        width[rows, heads[j]] += width[:, j] + edge
        if left is not None:
            before[rows, heads[j]] += np.where(left[:, j], width[:, j] + edge, 0)
    own = opens + before
    lefts, rights = opens.copy(), own + 1
    start, edges = np.zeros((m, k), np.int64), np.zeros((m, k), np.int64)
    for t in range(1, k):
        j = t if turn is None else turn[:, t - 1]
        p, w = (heads[t], width[:, t]) if turn is None else (above[rows, j], width[rows, j])
        at = rights[rows, p]
        if left is None:
            start[rows, j], edges[rows, j] = at + edge, at
            rights[rows, p] = at + w + edge
        else:
            side = left[:, t] if turn is None else left[rows, j]
            at = np.where(side, lefts[rows, p], at)
            start[rows, j], edges[rows, j] = np.where(side, at, at + edge), np.where(side, at + w, at)
            lefts[rows, p] += np.where(side, w + edge, 0)
            rights[rows, p] += np.where(side, 0, w + edge)
    for j in range(1, k):
        base = start[rows, heads[j]]
        start[:, j] += base
        edges[:, j] += base
    return start + own, edges, start, opens.astype(bool), width


class Names:
    """Pieces of the texts of trees with some names and labels."""

    def __init__(self, names: Sequence[str], labels: Sequence[str], labeled: bool) -> None:
        self.names = list(names)
        shown = list(labels) if labeled else [""] * len(labels)
        self.left = len(self.names)
        self.right = self.left + len(shown)
        self.open = self.right + len(shown)
        self.letters = self.open + 2
        texts = [*self.names, *[f" <{x} " for x in shown], *[f" >{x} " for x in shown], "(", ")", *LETTERS, "\t"]
        self.texts = pa.array(texts, pa.large_string())
        self.tab = len(texts) - 1
        self.length = np.array([len(x) for x in texts], np.int64)

    def _fill(self, name: np.ndarray, rel: np.ndarray, above: np.ndarray, left: np.ndarray | None, turn: np.ndarray | None, outer: bool, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, edges, start, opens, width = layout(above, left, turn, True, outer)
        total = width[:, 0] + more
        begin = (np.cumsum(total) - total)[:, None]
        out = np.empty(int(total.sum()), np.int64)
        out[begin + place] = name
        out[(begin + edges)[:, 1:]] = rel[:, 1:] + (self.right if left is None else np.where(left, self.left, self.right)[:, 1:])
        out[(begin + start)[opens]] = self.open
        out[(begin + start + width - 1)[opens]] = self.open + 1
        return out, total, place

    def fixed(self, name: np.ndarray, rel: np.ndarray, above: np.ndarray, place: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(keys with letters of the order, under, where the head's name stands): under has each node's place in the key. The last is begin << 32 | characters."""
        m, k = name.shape
        left = place < np.take_along_axis(place, above, 1)
        under = layout(above, left, None, False)[0]
        out, total, at = self._fill(name, rel, above, left, None, True, k)
        begin = np.cumsum(total) - total
        rank = np.argsort(np.argsort(place, 1), 1)
        out[(begin + total - k)[:, None] + under] = self.letters + rank % 26
        run = np.concatenate([[0], np.cumsum(self.length[out])])
        head = (run[begin + at[:, 0]] - run[begin]) << 32 | self.length[name[:, 0]]
        return joined(self.texts, out, total), under, head

    def heads_first(self, name: np.ndarray, rel: np.ndarray, above: np.ndarray) -> pa.Array:
        """As trees.heads_first: dependents sorted by name, the earlier word first."""
        rank = np.empty(len(self.names), np.int64)
        known = {x: i for i, x in enumerate(sorted(set(self.names)))}
        rank[:] = [known[x] for x in self.names]
        turn = np.argsort(rank[name[:, 1:]], 1, kind="stable") + 1
        out, total, _ = self._fill(name, rel, above, None, turn, False, 0)
        return joined(self.texts, out, total)

    def words(self, name: np.ndarray, under: np.ndarray, texts: pa.Array) -> pa.Array:
        """texts of the nodes by their names in the key's order, with tabs between them."""
        m, k = name.shape
        out = np.full((m, 2 * k - 1), len(texts), np.int64)
        np.put_along_axis(out, 2 * under, name, 1)
        return joined(pa.concat_arrays([texts, pa.array(["\t"], pa.large_string())]), out.ravel(), np.full(m, 2 * k - 1))


def patterns(name: np.ndarray, rel: np.ndarray, above: np.ndarray, place: np.ndarray, under: np.ndarray, tests: Sequence[str], labels: Sequence[str], labeled: bool, complete: bool) -> pa.Array:
    """Grew patterns of trees of fixed order, as sinks.grew writes them. tests: what a node of each name must be; under: each node's place in the key."""
    m, k = name.shape
    called = [label(i) for i in range(k)]
    texts: list[str] = []

    def add(more: list[str]) -> int:
        texts.extend(more)
        return len(texts) - len(more)

    nodes, ends = add([f"{c} [" for c in called]), add([f"{t}]; " for t in tests])
    tips, links = add([f"{c}; " for c in called]), add([f"{c} -[{x}]-> " if labeled else f"{c} -> " for c in called for x in labels])
    before, after = add([f"{c} << " for c in called]), add([f"{c} >> " for c in called])
    first, last, one = add(["pattern {"]), add([f"{c}}}" for c in called]), add([f"{t}]}}" for t in tests])
    without = add([f" without {{{c} -> X" for c in called])
    out = [np.full((m, 1), first)]
    for j in range(k):
        out.append(np.stack([nodes + under[:, j], (ends if k > 1 else one) + name[:, j]], 1))
    sort = np.argsort(above[:, 1:], 1, kind="stable") + 1  # links are listed by head
    heads = np.take_along_axis(above, sort, 1)
    head, foot = np.take_along_axis(under, heads, 1), np.take_along_axis(under, sort, 1)
    which = np.take_along_axis(rel, sort, 1)
    back = np.take_along_axis(place, sort, 1) < np.take_along_axis(place, heads, 1)
    for j in range(k - 1):
        out.append(np.stack([links + head[:, j] * len(labels) + which[:, j], tips + foot[:, j]], 1))
    for j in range(k - 1):
        out.append(np.stack([np.where(back[:, j], after, before) + head[:, j], (tips if j < k - 2 else last) + foot[:, j]], 1))
    if complete:
        numbers = add([f"{j}}}" for j in range(k)])
        for j in range(k):
            out.append(np.stack([without + under[:, j], np.full(m, numbers + j)], 1))
    whole = np.concatenate(out, 1)
    return joined(pa.array(texts, pa.large_string()), whole.ravel(), np.full(m, whole.shape[1]))


def free_keys(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], names: Sequence[str], labels: Sequence[str], labeled: bool) -> list[list[str]]:
    """For each matrix of trees their keys without order, as trees.render writes them. A tree is (two 64-bit identities of each node's branch, name, rel, above). Equal branches are written once."""
    sizes = [x[0].size for x in trees]
    base = np.cumsum([0, *sizes])
    a, b, name = (np.concatenate([t[i].ravel() for t in trees]) for i in range(3))
    kid, parent, rel = [], [], []
    amount = np.ones(base[-1], np.int64)
    for (x, _, _, r, above), at in zip(trees, base):
        m, k = x.shape
        flat = at + np.arange(m * k).reshape(m, k)
        own = amount[at : at + m * k].reshape(m, k)
        for j in range(k - 1, 0, -1):
            own[np.arange(m), above[:, j]] += own[:, j]
            kid.append(flat[:, j])
            parent.append(flat[np.arange(m), above[:, j]])
            rel.append(r[:, j])
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    kind = np.empty(len(a), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]  # of each kind
    rank = np.empty(len(one), np.int64)  # kinds by size, so that branches come before what they hang on
    by = np.argsort(amount[one], kind="stable")
    rank[by] = np.arange(len(one))
    kind, one = rank[kind], one[by]
    edges = [np.zeros(0, np.int64)] * 3
    if kid:
        kid_, parent_, rel_ = np.concatenate(kid), np.concatenate(parent), np.concatenate(rel)
        fine = one[kind[parent_]] == parent_
        edges = [kind[parent_[fine]], kind[kid_[fine]], rel_[fine]]
        sort = np.argsort(edges[0], kind="stable")
        edges = [x[sort] for x in edges]
    begin = np.searchsorted(edges[0], np.arange(len(one) + 1)).tolist()
    kids, rels, own = edges[1].tolist(), edges[2].tolist(), name[one].tolist()
    shown = list(labels) if labeled else [""] * len(labels)
    texts: list[str] = []
    for i, word in enumerate(own):
        x, y = begin[i], begin[i + 1]
        if x == y:
            texts.append(names[word])
        elif y - x == 1:
            texts.append(f"({names[word]} >{shown[rels[x]]} {texts[kids[x]]})")
        else:
            below = sorted((texts[kids[e]], labels[rels[e]], shown[rels[e]]) for e in range(x, y))
            texts.append("(" + names[word] + "".join(f" >{r} {t}" for t, _, r in below) + ")")
    return [[texts[x] for x in kind[at : at + s].reshape(t[0].shape)[:, 0].tolist()] for t, at, s in zip(trees, base, sizes)]
