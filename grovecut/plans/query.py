"""The tree query language: text -> QueryNode.

    upos=NOUN&Case=Nom > _          a noun in the nominative that governs anything
    A > B > C                       A governs B and C
    A > (B > C)                     A governs B, which governs C
    B < A                           A governs B;  A >amod B, A >amod|>nmod B, A >!case B
Atoms: _ for any node; form=, L= or lemma=, upos=, xpos=, feats= and features such as Case=; a bare word is a form. & is and,
| is or, a leading ! is not. < and > say what governs, never the order in the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FEATURES = frozenset("Abbr AdpType Animacy AdvType Aspect Case Clusivity ConjType Definite Degree Deixis DeixisRef Evident ExtPos Foreign Gender Mood NameType NounClass NounType NumForm Number NumType PartType Person Polarity Polite Poss PronType PunctType Reflex Style Tense Typo VerbForm VerbType Voice".split())
FIELDS = {"L": "lemma", "lemma": "lemma", "upos": "upos", "xpos": "xpos", "form": "form", "feats": "feats_raw"}


@dataclass(frozen=True)
class Test:
    """One comparison; field is a token's or, for features, feats.X."""

    field: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class QueryNode:
    """any_of: alternatives, each of tests that must all hold; an empty one holds for every node."""

    any_of: tuple[tuple[Test, ...], ...] = ((),)
    kids: tuple["QueryNode", ...] = field(default=())

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def _split(text: str) -> list[str]:
    """Parts between blanks; a bracketed part is one, its brackets kept."""
    out, now, depth = [], "", 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError(f"unbalanced brackets in query: {text}")
        if c.isspace() and not depth:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    if depth:
        raise ValueError(f"unbalanced brackets in query: {text}")
    return out + [now] if now else out


def _atom(text: str) -> tuple[tuple[Test, ...], ...]:
    alternatives = []
    for alternative in text.split("|"):
        tests = []
        for part in alternative.split("&"):
            part = part.strip()
            negated = part.startswith("!")
            part = part[negated:]
            if part == "_":
                continue
            if "=" not in part:
                tests.append(Test("form", part, negated))
                continue
            name, value = part.split("=", 1)
            if name in FIELDS:
                tests.append(Test(FIELDS[name], value, negated))
            elif name in FEATURES:
                tests.append(Test(f"feats.{name}", value, negated))
            else:
                raise ValueError(f"unknown attribute in query: {name}")
        alternatives.append(tuple(tests))
    return tuple(alternatives)


def _edge(text: str) -> tuple[tuple[Test, ...], ...]:
    """The label tests of an operator such as >amod|>nmod."""
    out = []
    for one in text.split("|"):
        name = one.strip().lstrip("<>")
        negated = name.startswith("!")
        name = name[negated:]
        out.append((Test("deprel", name, negated),) if name else ())
    return tuple(out)


def parse(text: str) -> QueryNode:
    """The tree of a query; raises ValueError on what isn't one."""
    parts = _split(text.strip())
    if not parts or len(parts) % 2 == 0:
        raise ValueError(f"a query alternates nodes and operators: {text}")
    nodes, edges = parts[::2], parts[1::2]
    for e in edges:
        if e[0] not in "<>":
            raise ValueError(f"expected < or > in query, not {e}")
    at = next((i for i, e in enumerate(edges) if e[0] == ">"), len(edges))
    if any(e[0] == "<" for e in edges[at:]):
        raise ValueError(f"< after > in query; use brackets: {text}")

    def node(part: str) -> QueryNode:
        if part.startswith("(") and part.endswith(")"):
            return parse(part[1:-1])
        return QueryNode(_atom(part))

    head, kids = node(nodes[at]), []
    for i, part in enumerate(nodes):
        if i != at:
            kid, edge = node(part), _edge(edges[i] if i < at else edges[i - 1])
            kids.append(QueryNode(tuple((*b, *a) for b in edge for a in kid.any_of), kid.kids))
    return QueryNode(head.any_of, head.kids + tuple(kids))
