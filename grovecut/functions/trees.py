"""Rendering of one tree: its key, its heads-first key and its links. Nodes are columns, each after its head (see forest)."""

from __future__ import annotations

from collections.abc import Sequence

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dependents(above: Sequence[int]) -> list[list[int]]:
    """Each node's dependents; above has the head of each node, for the first one anything."""
    out: list[list[int]] = [[] for _ in above]
    for j in range(1, len(above)):
        out[above[j]].append(j)
    return out


def render(names: Sequence[str], rels: Sequence[str], kids: list[list[int]], places: Sequence[int], fixed: bool, labeled: bool) -> tuple[str, list[int]]:
    """The key of a tree and its nodes in the key's order. Without fixed order dependents are sorted by key, then label."""
    key, under = list(names), [[j] for j in range(len(names))]
    for j in range(len(names) - 1, -1, -1):
        if not kids[j]:
            continue
        left, right, a, b = [], [], [], []
        for i in kids[j] if fixed else sorted(kids[j], key=lambda i: (key[i], rels[i], i)):
            rel = rels[i] if labeled else ""
            if fixed and places[i] < places[j]:
                left.append(f"{key[i]} <{rel} ")
                a += under[i]
            else:
                right.append(f" >{rel} {key[i]}")
                b += under[i]
        key[j] = "(" + "".join(left) + names[j] + "".join(right) + ")"
        under[j] = [*a, j, *b]
    return key[0], under[0]


def heads_first(names: Sequence[str], rels: Sequence[str], kids: list[list[int]], labeled: bool) -> str:
    """The key with heads before their dependents, which are sorted by name; of equal names the earlier word comes first."""
    out = list(names)
    for j in range(len(names) - 1, -1, -1):
        if kids[j]:
            out[j] = "(" + names[j] + "".join(f" >{rels[i] if labeled else ''} {out[i]}" for i in sorted(kids[j], key=lambda i: names[i])) + ")"
    return out[0][1:-1] if len(names) > 1 else out[0]


def links(kids: list[list[int]]) -> list[tuple[int, int]]:
    return [(j, i) for j, own in enumerate(kids) for i in own]


def letters(places: Sequence[int]) -> str:
    """A for the first of the places in the text, B for the next, in the given order."""
    rank = {p: i for i, p in enumerate(sorted(places))}
    return "".join(LETTERS[rank[p] % 26] for p in places)


def label(k: int) -> str:
    """A .. Z, A1 .. Z1, ..."""
    return LETTERS[k % 26] + (str(k // 26) if k >= 26 else "")
