"""Enumeration and rendering by brute force, one sentence at a time."""

from itertools import combinations, permutations


class Slow:
    """head[i]: index of i's head, -1 for a root, -2 for a token that isn't attached."""

    def __init__(self, head, deprel, token):
        self.head, self.deprel, self.token = head, deprel, token
        self.kids = [[k for k, h in enumerate(head) if h == v] for v in range(len(head))]
        self.order = []  # heads after their dependents

        def visit(v):
            for k in self.kids[v]:
                visit(k)
            self.order.append(v)

        for v, h in enumerate(head):
            if h == -1:
                visit(v)

    def below(self, v):
        return {v}.union(*(self.below(k) for k in self.kids[v]))

    def top(self, nodes):
        tops = [v for v in nodes if self.head[v] not in nodes]
        return tops[0] if len(tops) == 1 else None


def complete(s, low, high, allowed=None):
    out = [(v, frozenset(s.below(v))) for v in s.order]
    return [(v, n) for v, n in out if low <= len(n) <= high and (allowed is None or all(s.deprel[k] in allowed for k in n - {v}))]


def partial(s, low, high, allowed=None):
    out = []
    for k in range(low, high + 1):
        for nodes in combinations(sorted(s.order), k):
            top = s.top(set(nodes))
            if top is not None and (allowed is None or all(s.deprel[x] in allowed for x in nodes if x != top)):
                out.append((top, frozenset(nodes)))
    return out


def holds(test, token, deprel):
    if test.field == "deprel":
        have = deprel
    elif test.field.startswith("feats."):
        have = token["feats"].get(test.field[6:])
    else:
        have = token[test.field]
    return (have == test.value) != test.negated


def matches(s, q, exact=False, allowed=None):
    """Sets of nodes that a query covers, by trying all assignments."""

    def covers(v, q, nodes):
        kids = [k for k in s.kids[v] if k in nodes]
        if len(kids) != len(q.kids) or (exact and len(kids) != len(s.kids[v])):
            return False
        if not any(all(holds(t, s.token[v], s.deprel[v]) for t in tests) for tests in q.any_of):
            return False
        return any(all(covers(k, c, nodes) for k, c in zip(p, q.kids)) for p in permutations(kids))

    return [(v, n) for v, n in partial(s, q.size(), q.size(), allowed) if covers(v, q, n)]


def without(s, head, nodes, ignored):
    out = {head}
    for k in s.kids[head]:
        if k in nodes and s.deprel[k] not in ignored:
            out |= without(s, k, nodes, ignored)
    return frozenset(out)


def key(s, v, nodes, name, fixed, labeled):
    """(key without order, nodes in its order)."""
    parts = [(key(s, k, nodes, name, fixed, labeled), s.deprel[k], k) for k in s.kids[v] if k in nodes]
    if not fixed:
        parts.sort(key=lambda p: (p[0][0], p[1], p[2]))
    left = [p for p in parts if fixed and p[2] < v]
    right = [p for p in parts if not (fixed and p[2] < v)]
    text = "".join(f"{p[0][0]} <{p[1] if labeled else ''} " for p in left) + name(v) + "".join(f" >{p[1] if labeled else ''} {p[0][0]}" for p in right)
    return f"({text})" if parts else text, [x for p in left for x in p[0][1]] + [v] + [x for p in right for x in p[0][1]]


def letters(places):
    return "".join(chr(65 + sorted(places).index(p) % 26) for p in places)
