"""What keeps the treebank queries in proportion to their input: where sentences are read, rows are counted, and what is never joined."""

import random

import pytest
from conftest import SF
from test_trees import batch, sentence

from grovecut.operators import mine as M
from grovecut.plans import queries as Q
from grovecut.plans.spec import MineSpec
from grovecut.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_are_written_where_the_sentence_is_read(spark):
    text = plan(Q.exemplar(spark, SF))
    assert "Join" not in text


@pytest.mark.parametrize("name", ["sentence_counts", "detailed_results"])
def test_results_by_sentence_need_no_join_and_no_count(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "Join" not in text and "Aggregate" not in text and text.count("MapInArrow") == 1


COUNTED = [*Q._COMPLETE, *Q._QUERIES, *Q._PARTIAL, "order_letters", "closure_stats", "unigrams_upos", "unigrams_composite", "subtree_hash"]


@pytest.mark.parametrize("name", COUNTED)
def test_tokens_stay_in_python_and_keys_are_hashed(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert text.count("MapInArrow") == 1 and "toks" not in text and "SortAggregate" not in text


def test_names_of_nodes_are_looked_up_and_not_joined(spark):
    for f in (Q.association, Q.association_wide):
        assert "Join" not in plan(f(spark, SF))


def test_many_names_are_joined_with_the_same_measures(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, Q.association(spark, SF).collect()))
    held = rows()
    monkeypatch.setattr(M, "HELD_NAMES", 2)
    assert rows() == held


def test_result_rows_carry_their_words_once():
    columns = M._columns(M._schema(["words"]))
    assert not {"key_raw", "head_name"} & set(columns) and "words string" in M._schema(["words"])


def test_heads_first_keys_come_without_links():
    assert not any("grew" in c for c in M._columns(M._schema(["sorted"])))


@pytest.mark.parametrize("settings", [{"size": (1, 5)}, {"size": (1, 4), "complete": False, "processing_size": (1, 4), "node_type": "upos+form"}, {"size": (2, 3), "labeled": False}, {"size": (2, 3), "node_type": None}], ids=str)
def test_patterns_are_those_of_the_result_file(settings):
    rng = random.Random(repr(settings))
    spec = MineSpec(grew_match=True, **settings)
    s = M.Sentences(batch([sentence(rng, rng.randint(1, 9)) for _ in range(50)]), spec)
    parts = [frozenset(M.PARTS), frozenset(["pattern"])]
    rows, short = ([r for b in M._key_rows(s, spec, p, M._schema(p)) for r in b.to_pylist()] for p in parts)
    width = max(1, len(spec.node_types))
    want = {}
    for r in rows:
        flat = r["words"].split("\t")
        want[r["key"]] = sinks.grew(r | {"words": [flat[i : i + width] for i in range(0, len(flat), width)]}, spec)
    assert {r["key"]: r["pattern"] for r in short} == want and len(want) > 20


def test_wide_patterns_count_every_connected_set(spark):
    """All sets of two to four nodes of all sentences, counted here from the leaves up."""
    total = 0
    for row in Q.bank(spark, SF).frame().select("toks.head").collect():
        head = row["head"]
        for i, h in enumerate(head):
            if h is None:  # from here on nothing is attached
                head[i:] = [None] * (len(head) - i)
        kids = {}
        for i, h in enumerate(head):
            if h:
                kids.setdefault(h, []).append(i + 1)

        def ways(v):
            """Sets under v that have v, by their number of nodes up to 4."""
            out = [0, 1, 0, 0, 0]
            for below in map(ways, kids.get(v, ())):  # noqa: B023
                out = [out[n] + sum(out[n - k] * below[k] for k in range(1, n)) for n in range(5)]
            nonlocal total
            total += sum(out[2:])
            return out

        for i, h in enumerate(head):
            if h == 0:
                ways(i + 1)
    assert Q.grew_patterns_wide(spark, SF).agg({"number": "sum"}).head()[0] == total


def test_free_keys_of_equal_branches_are_written_once(monkeypatch):
    calls = []
    monkeypatch.setattr(M, "render", lambda *a: calls.append(a))
    rng = random.Random(4)
    spec = MineSpec(size=(1, 9), fixed=False)
    s = M.Sentences(batch([sentence(rng, 8) for _ in range(30)]), spec)
    assert sum(b.num_rows for b in M._key_rows(s, spec, frozenset(), M._schema(()))) > 50 and not calls
