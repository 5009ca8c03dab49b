import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import slow_trees as slow

from grovecut.functions.trees import dependents, heads_first, label, letters, links, render
from grovecut.operators import mine as M
from grovecut.plans.query import parse
from grovecut.plans.spec import MineSpec, from_settings

TOKEN = pa.struct([("form", pa.string())])


def sentence(rng, n):
    """Heads (0 for a root, None for none, 99 for one that isn't there), labels and tags of n tokens."""
    head = [0 if i == 0 else rng.randrange(i) + 1 for i in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    place = {v: k for k, v in enumerate(order)}
    out = [0] * n
    for v, h in enumerate(head):
        out[place[v]] = 0 if h == 0 or rng.random() < 0.1 else place[h - 1] + 1
    if rng.random() < 0.3:
        out[rng.randrange(n)] = rng.choice([None, 99])
    return out, [rng.choice(["a", "b:x", "c"]) for _ in range(n)], [rng.choice("NV") for _ in range(n)], [rng.choice("xyz") for _ in range(n)]


def batch(rows):
    return pa.table({
        "sent_key": pa.array([10 * k for k in range(len(rows))], pa.int64()),
        "id": pa.array([list(range(1, len(r[0]) + 1)) for r in rows], pa.list_(pa.int32())),
        "head": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
        "deprel_full": pa.array([r[1] for r in rows], pa.list_(pa.string())),
        "upos": pa.array([r[2] for r in rows], pa.list_(pa.string())),
        "form": pa.array([r[3] for r in rows], pa.list_(pa.string())),
    })


def slow_of(row, subtypes=False):
    broken, head = False, []
    for h in row[0]:
        broken = broken or h is None
        head.append(-2 if broken or h > len(row[0]) else h - 1)
    return slow.Slow(head, [r if subtypes else r.split(":")[0] for r in row[1]], [{"upos": u, "form": f, "feats": {}} for u, f in zip(row[2], row[3])])


SPECS = [
    {"size": (2, 3)},
    {"size": (1, 9), "fixed": False},
    {"size": (2, 4), "labeled": False, "label_subtypes": True},
    {"size": (2, 5), "ignored_labels": ("a",)},
    {"size": (1, 9), "allowed_labels": ("b", "c")},
    {"size": (1, 9), "node_type": "upos+form", "head": "upos=N&!deprel=a|upos=V&form=x"},
    {"size": (1, 9), "node_type": None},
    {"size": (2, 4), "complete": False, "processing_size": (1, 3)},
    {"size": (1, 4), "complete": False, "processing_size": (2, 4), "fixed": False, "ignored_labels": ("a",)},
    {"size": (1, 3), "complete": False, "processing_size": (1, 3), "allowed_labels": ("a",), "head": "upos=N"},
    {"query": "_ > _", "complete": False},
    {"query": "_ > _"},
    {"query": "upos=N > _ > upos=V", "complete": False},
    {"query": "_ > (upos=V > _)", "complete": False, "fixed": False},
    {"query": "_ > (_ > _ > _) > x", "complete": False},
    {"query": "upos=N|upos=V >a|>b _ > _", "complete": False, "ignored_labels": ("c",)},
    {"query": "_ <!c upos=V", "complete": False},
    {"query": "upos=N > _ > _"},
]


def wanted(rows, spec):
    out, at = Counter(), {}
    for i, row in enumerate(rows):
        s = slow_of(row, spec.label_subtypes)
        allowed = set(spec.allowed_labels) or None
        if spec.query:
            found = slow.matches(s, spec.query_tree, spec.complete, allowed)
        else:
            low, high = max(1, spec.bounds[0], spec.size[0]), min(spec.bounds[1], spec.size[1])
            found = (slow.complete if spec.complete else slow.partial)(s, low, min(high, len(row[0])), allowed)
        for v, nodes in found:
            if spec.head and not any(all(slow.holds(t, s.token[v], s.deprel[v]) for t in tests) for tests in spec.head_any_of):
                continue
            kept = slow.without(s, v, nodes, set(spec.ignored_labels))
            if spec.ignored_labels and spec.size[0] and not spec.size[0] <= len(kept) <= spec.size[1]:
                continue
            name = lambda x: "&".join(s.token[x][t] for t in spec.node_types) or "_"  # noqa: B023, E731
            text, places = slow.key(s, v, kept, name, spec.fixed, spec.labeled)
            text += slow.letters(places) if spec.fixed else ""
            out[text] += 1
            rank = (0 if len(row[0]) < 15 else len(row[0]), 10 * i, s.order.index(v), sorted(nodes))
            at[text] = min(at.get(text, (rank, places)), (rank, places))
    return out, at


@pytest.mark.parametrize("settings", SPECS, ids=str)
def test_counts_and_exemplars_are_those_of_brute_force(settings, monkeypatch):
    monkeypatch.setattr("grovecut.functions.forest.HEADS", 7)
    monkeypatch.setattr(M, "MATCHES", 10**9)
    rng = random.Random(repr(settings))
    rows = [sentence(rng, rng.randint(1, 8)) for _ in range(40)] + [([0], ["a"], ["N"], ["x"])]
    spec = MineSpec(**settings)
    parts = frozenset(M.PARTS)
    got = [r for b in M._key_rows(M.Sentences(batch(rows), spec), spec, parts, M._schema(parts)) for r in b.to_pylist()]
    number, at = wanted(rows, spec)
    assert {r["key"]: r["number"] for r in got} == dict(number) and len(got) == len(number)
    for r in got:
        e = r["exemplar"]
        rank, places = at[r["key"]]
        assert (e["sent_key"], e["ord"], e["locs"]) == (rank[1], [rank[2], *rank[3]], places)


def test_ties_of_wide_matches():
    from grovecut.functions.forest import ties

    rng = np.random.default_rng(1)
    rows = [np.argsort(rng.random((30, 90)), 1)[:, :k] for k in (3, 7, 40)]
    t = ties(rows, 2000)
    whole = [sorted(r) for m in rows for r in m.tolist()]
    assert [whole[i] for i in np.argsort(t, kind="stable")] == sorted(whole)


def test_no_root_and_empty():
    spec = MineSpec(size=(1, 3))
    s = M.Sentences(batch([([2, 1], ["a", "b"], ["N", "V"], ["x", "y"])]), spec)
    assert s.forest.n == 0 and list(M._key_rows(s, spec, frozenset(), M._schema(()))) == [] and M._names(s) == ([], [])


def test_a_very_long_sentence(monkeypatch):
    n = 3000
    rows = [([k for k in range(n)], ["a"] * n, ["N"] * n, ["x"] * n)]
    for settings in ({"size": (1, n)}, {"size": (2, 3), "complete": False, "processing_size": (2, 3)}, {"query": "_ > (_ > _)", "complete": False}):
        spec = MineSpec(**settings)
        got = sum(r["number"] for b in M._key_rows(M.Sentences(batch(rows), spec), spec, frozenset(M.PARTS), M._schema(M.PARTS)) for r in b.to_pylist()) if not settings.get("size") == (1, n) else sum(len(x) for x, _ in M.Sentences(batch(rows), spec).found())
        assert got == {"(1, 3000)": n, "(2, 3)": n - 1 + n - 2}.get(str(settings.get("size")), n - 2)
    deep = render(["N"] * 1500, ["a"] * 1500, dependents([0, *range(1499)]), list(range(1500)), True, True)
    assert deep[0].count("(") == 1499 and deep[1] == list(range(1500))


def test_query_language():
    assert parse("A > B > C").size() == 3 and len(parse("A > B > C").kids) == 2
    chain = parse("A > (B > C)")
    assert len(chain.kids) == 1 and len(chain.kids[0].kids) == 1
    assert parse("A < B").any_of[0][0].value == "B"
    assert parse("(form=x)").any_of == parse("x").any_of
    assert parse("_").any_of == ((),)
    edge = parse("_ >amod|>nmod upos=X|upos=Y").kids[0].any_of
    assert [[t.value for t in a] for a in edge] == [["amod", "X"], ["amod", "Y"], ["nmod", "X"], ["nmod", "Y"]]
    assert parse("L=a&!lemma=b").any_of[0][1].negated
    for bad in ("", "A >", "colour=red", "(A > B", "A B C", "A > B < C"):
        with pytest.raises(ValueError):
            parse(bad)


def test_rendering():
    names, rels = ["VERB", "NOUN", "ADJ", "ADV", "PUNCT"], ["root", "nsubj", "amod", "advmod", "punct"]
    kids, places = dependents([0, 0, 1, 0, 0]), [2, 1, 0, 3, 4]
    assert render(names, rels, kids, places, True, True) == ("((ADJ <amod NOUN) <nsubj VERB >advmod ADV >punct PUNCT)", [2, 1, 0, 3, 4])
    assert render(names, rels, kids, places, False, True)[0] == "(VERB >nsubj (NOUN >amod ADJ) >advmod ADV >punct PUNCT)"
    assert render(["NOUN", "ADJ"], ["nsubj", "amod"], [[1], []], [1, 0], True, False)[0] == "(ADJ < NOUN)"
    assert heads_first(["NOUN"], ["x"], [[]], True) == "NOUN" and heads_first(names, rels, kids, True) == "VERB >advmod ADV >nsubj (NOUN >amod ADJ) >punct PUNCT"
    # dependents of one name keep their order in the text, whatever their labels
    assert heads_first(["V", "N", "N"], ["root", "obj", "nsubj"], [[1, 2], [], []], True) == "V >obj N >nsubj N"
    assert links(kids) == [(0, 1), (0, 3), (0, 4), (1, 2)]
    assert letters([4, 0, 2]) == "CAB" and label(0) == "A" and label(27) == "B1"


def test_settings():
    s = from_settings({"size": "2-3", "query": "_ > _", "labeled": "no", "node_type": "upos+form", "ignored_labels": "punct|case"})
    assert s.size == (0, 0) and s.node_types == ("upos", "form") and not s.labeled and s.bounds == (2, 2) and s.ignored_labels == ("punct", "case")
    assert MineSpec(size=(2, 3)).bounds == (1, 10_000_000)
    for bad in ({}, {"processing_size": (1, 2)}, {"size": (2, 3), "complete": False}, {"size": (1, 2), "node_type": "colour"}):
        with pytest.raises(ValueError):
            MineSpec(**bad)
