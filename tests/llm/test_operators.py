"""Operators on Spark: against SQL on the small tables, against brute force, and on awkward tables."""

import random
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from grovecut.llm import bloom, components, exact, fingerprints, mixing, ngramjoin, packing, pii, registry, suffixes, toxicity, urls, wrappers

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
SCHEMA = "doc_id long, text string, source string, suspect int, row int, near_id int, near_keep int, toxic_score int, mix_source int, mix_at int, level int, id int, h int, label string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null texts, ids and sources, empty and very long texts, ties, repeated rows, names that clash with inner ones."""
    rng = random.Random(5)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "you", "eps"]) + str(rng.randrange(40)) for _ in range(80))
    near = base.replace("alpha", "omega", 1)
    rows = [(1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "b"), (5, "", "c"), (6, "", None), (None, base, "a"), (None, "only one", None), (7, LONG, "a"), (7, LONG, "a"), (8, "tiny", "b"), (9, "   \n", "b"), (10, "you are an idiot", "c"), (11, "mail ana@x.org", "c")]
    return spark.createDataFrame([(*r, *[0] * 10, "x") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", registry.SQL)
def test_equals_its_sql(spark, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, SF), registry.SQL[name])


def test_all_ten_are_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in e.queries() if q.startswith("op")} and "pipeline" in e.queries()


def test_exact(spark, awkward, empty):
    got = {(r["doc_id"], r["keep_id"], r["copies"]) for r in exact.duplicates(awkward).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (None, 1, 3), (5, 5, 2), (6, 5, 2), (7, 7, 2)}
    kept = exact.deduplicate(awkward)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, None, 7, 8, 9, 10, 11])
    assert exact.duplicates(empty).count() == exact.deduplicate(empty).count() == 0


def test_exact_on_long_texts_and_many_copies(spark):
    rows = [(k, "hot") for k in range(3000)] + [(5000, LONG), (5001, LONG + " x"), (5002, LONG), (None, LONG), (5003, None), (5004, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["keep_id"], r["copies"]) for r in exact.duplicates(docs).collect())
    assert got == Counter({(0, 3000): 3000, (5000, 3): 3})
    assert {r["doc_id"] for r in exact.deduplicate(docs).collect()} == {0, 5000, 5001, 5003, 5004}


def test_exact_with_short_hashes_still_compares_bytes(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 390).alias("text"))
    assert exact.duplicates(docs, spare_bits=0, owner_docs=50).count() == 20 and exact.deduplicate(docs, spare_bits=0, owner_docs=50).count() == 390


def jaccard_pairs(rows, n=3, least=0.5):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").split()
        if w:
            sets[k, i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    out = set()
    for a in sets:
        for b in sets:
            if a[0] < b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                out.add((a[1], b[1]))
    return out


def test_near_pairs_against_brute_force(spark, monkeypatch):
    rng, rows = random.Random(9), []
    for g in range(12):
        base = [f"{rng.choice('abcdefg')}{rng.randrange(300)}" for _ in range(rng.randint(2, 120))]
        for _ in range(rng.randint(1, 60 if g == 0 else 5)):
            w = [x if rng.random() > 0.05 else f"z{rng.randrange(300)}" for x in base]
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = jaccard_pairs(rows)
    links = Counter(i for pair in want for i in pair)
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(want):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    for how in ({}, {"owner_grams": 200, "block_sets": 3, "broadcast_rows": 0}):
        got = {(r["doc_id"], r["class_id"], r["links"]) for r in ngramjoin.near_duplicates(docs, **how).collect()}
        assert got == {(i, top(i), n) for i, n in links.items()}
    kept = {r["doc_id"] for r in ngramjoin.one_of_each(docs).collect()}
    assert kept == {top(i) for i, _ in rows}


def test_near_on_awkward_tables(awkward, empty):
    got = Counter((r["doc_id"], r["class_id"], r["links"]) for r in ngramjoin.near_duplicates(awkward).collect())
    assert got == Counter([(1, 1, 3), (2, 1, 3), (None, 1, 3), (3, 1, 3), (7, 7, 1), (7, 7, 1)])
    kept = ngramjoin.one_of_each(awkward)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, None, None, 7, 7, 8, 9, 10, 11])
    assert ngramjoin.near_duplicates(empty).count() == ngramjoin.one_of_each(empty).count() == 0


def test_grams_that_collide_in_32_bits_keep_their_number():
    """Two documents that share three grams, two of which are alike in the bits that are sent."""
    import numpy as np
    import pyarrow as pa

    grams_ = lambda *x: np.array(x, np.uint32).tobytes()
    row = lambda name: (grams_(5, 5, 9), ngramjoin.packed(np.array([3])), np.array([name], np.int64).tobytes(), ngramjoin.packed(np.array([4])), np.array([1], np.uint8).tobytes())
    columns = zip(*[row(11), row(22), row(11)])  # the last is a copy of the first document
    group = pa.table([pa.array(c, pa.binary()) for c in columns], ["grams", "each", "name", "size", "l"])
    for long in (24, 0):
        ngramjoin.LONG_LIST, before = long, ngramjoin.LONG_LIST
        found = ngramjoin._pairs(0.5)(ngramjoin._lists(1)(group)).to_pylist()
        ngramjoin.LONG_LIST = before
        assert [(r["a"], r["b"]) for r in found] == [(11, 22)] and found[0]["n"] >= 3


def test_clusters_of_near_copies_make_no_row_a_pair(spark, monkeypatch):
    """Large groups of near copies, in several squares, beside small groups and copies; nothing that a task returns is as long as their pairs."""
    rng, rows = random.Random(4), []
    for g, many in enumerate([260, 90, 3, 2, 1, 1]):
        base = [f"{rng.choice('abcdefg')}{rng.randrange(3000)}" for _ in range(90)]
        for _ in range(many):
            w = [x if rng.random() > 0.06 else f"z{rng.randrange(3000)}" for x in base]
            rows += [(len(rows) + k, " ".join(w)) for k in range(2 if rng.random() < 0.05 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = jaccard_pairs(rows)
    assert len(want) > 20_000
    links, class_ = Counter(i for pair in want for i in pair), {i: i for i, _ in rows}
    while True:
        before = dict(class_)
        for a, b in want:
            class_[a] = class_[b] = min(class_[a], class_[b])
        if before == class_:
            break
    monkeypatch.setattr(ngramjoin, "SQUARE_SETS", 50)
    for how in ({"cluster_sets": 40}, {"cluster_sets": 40, "broadcast_rows": 0, "owner_grams": 2000}, {"cluster_sets": 10**6}):
        got = {(r["doc_id"], r["class_id"], r["links"]) for r in ngramjoin.near_duplicates(docs, **how).collect()}
        assert got == {(i, class_[i], n) for i, n in links.items()}, how
    kept = {r["doc_id"] for r in ngramjoin.one_of_each(docs, cluster_sets=40).collect()}
    assert kept == {class_[i] for i, _ in rows}
    assert ngramjoin.set_pairs(docs, cluster_sets=40)[2].count() < len(want) / 5


def test_near_stage_of_the_pipeline_connects_clusters_without_their_pairs(spark, monkeypatch):
    """One row of a cluster stays, and what is connected is far shorter than the pairs."""
    import corpus_pipeline

    rng, counted = random.Random(8), []
    base = [f"{rng.choice('abcdefg')}{rng.randrange(3000)}" for _ in range(120)]
    rows = [(k, " ".join(x if rng.random() > 0.04 else f"z{rng.randrange(3000)}" for x in base)) for k in range(150)]
    rows += [(500 + k, " ".join(f"y{rng.randrange(3000)}" for _ in range(50))) for k in range(5)]
    want = jaccard_pairs(rows)
    assert len(want) > 5_000

    def watched(edges, *names):
        counted.append(edges.count())
        return components.components(edges, *names)

    monkeypatch.setattr(ngramjoin, "components", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, *range(500, 505)} and max(counted) < len(want) / 2


def test_counts_come_in_parts_of_bounded_size(monkeypatch):
    """A task with more pairs than it may hold passes them on in parts; the parts add up."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ngramjoin, "HELD_PAIRS", 300)
    rng = np.random.default_rng(3)
    rows, sets_ = [], {}
    for name in range(1, 61):
        g = np.unique(rng.integers(0, 25, 8)).astype(np.uint32)
        sets_[name] = set(g.tolist())
        rows.append((g.tobytes(), ngramjoin.packed(np.array([len(g)])), np.array([name], np.int64).tobytes(), ngramjoin.packed(np.array([10])), np.array([1], np.uint8).tobytes()))
    group = pa.table([pa.array(c, pa.binary()) for c in zip(*rows)], ["grams", "each", "name", "size", "l"])
    for long in (24, 3):
        monkeypatch.setattr(ngramjoin, "LONG_LIST", long)
        parts = list(ngramjoin._counted(0.5)(ngramjoin._lists(1)(group)))
        got = Counter()
        for part in parts:
            for r in part.to_pylist():
                got[r["a"], r["b"]] += r["n"]
        assert got == Counter({(a, b): n for a in sets_ for b in sets_ if a < b and (n := len(sets_[a] & sets_[b]))})
        assert len(parts) > 1 and max(len(p) for p in parts) < 1770


def test_shared_grams_of_two_sides(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    side = lambda many: [np.unique(np.concatenate([rng.integers(0, 9, 6), rng.integers(0, 4000, rng.integers(0, 40))])).astype(np.uint64) for _ in range(many)]
    flat = lambda s: (np.concatenate([*s, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int64))
    for p, q in ((side(700), side(600)), (side(3), side(5)), ([], side(2)), (side(2), [])):
        got = ngramjoin.shared_grams(*flat(p), *flat(q))
        assert got.shape == (len(p), len(q))
        for i in range(0, len(p), 37):
            assert got[i].tolist() == [len(np.intersect1d(p[i], y)) for y in q]


def test_filter_lets_all_wanted_through(spark):
    import numpy as np

    names = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    bits = bloom.build(spark.createDataFrame([(int(x),) for x in names], "name long"))
    assert bloom.passes(bits, names).all() and bloom.passes(bits, names + 1).mean() < 0.01


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root: dict = {}

    def top(x):
        root.setdefault(x, x)
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in list(root)}


def slow_passages(rows, length):
    """Runs of windows that occur at two places, from all windows; equal texts of one id are one document."""
    docs = {(i, t) for i, t in rows if i is not None and t is not None}
    at = {}
    for k, (i, t) in enumerate(sorted(docs, key=str)):
        w = t.split()
        for p in range(len(w) - length + 1):
            at.setdefault(tuple(w[p : p + length]), []).append((i, p))
    starts = sorted({place for places in at.values() if len(places) > 1 for place in places})
    out, before = [], None
    for i, p in starts:
        if before is not None and before[0] == i and p <= before[2] - length + 1:
            before[2] = p + length
        else:
            before = [i, p, p + length]
            out.append(before)
    return {tuple(x) for x in out}


def test_passages_against_brute_force(spark, awkward):
    rng, rows = random.Random(6), []
    shared = [[f"p{g}x{k}" for k in range(rng.randint(5, 40))] for g in range(6)]
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 6)):
            w += rng.choice(shared) if rng.random() < 0.4 else [rng.choice("abc") + str(rng.randrange(20)) for _ in range(rng.randint(1, 20))]
        rows.append((i, " ".join(w)))
    rows += [(100, "a b " * 40), (101, None), (102, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for how in ({}, {"bucket_segments": 3, "splitter_sample": 20}):
        assert {tuple(r) for r in suffixes.passages(docs, length=9, **how).collect()} == slow_passages(rows, 9)
    assert {tuple(r) for r in suffixes.passages(awkward).collect()} == slow_passages([(r["doc_id"], r["text"]) for r in awkward.collect()], 50)


def test_passages(spark, awkward, empty):
    shared = " ".join(f"s{i}" for i in range(55))
    rows = [(1, f"a b {shared} c"), (2, f"{shared} d"), (3, " ".join(f"s{i}" for i in range(49))), (4, None), (5, ""), (6, "x " * 120), (6, "x " * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in suffixes.passages(docs).collect()}
    assert got == {(1, 2, 57), (2, 0, 55), (6, 0, 120)}
    for how in ({"bucket_segments": 1}, {"splitter_sample": 1, "bucket_segments": 2}):
        assert {tuple(r) for r in suffixes.passages(docs, **how).collect()} == got
    assert {r["doc_id"] for r in suffixes.passages(awkward).collect()} >= {1, 2, 7} and suffixes.passages(empty).count() == 0
    with pytest.raises(ValueError):
        suffixes.passages(docs, length=2)


def test_pii(awkward, empty, spark):
    got = pii.pseudonymize(awkward).collect()
    assert [(r["doc_id"], r["replaced"]) for r in got] == [(11, 1)]
    assert pii.pseudonymize(spark.createDataFrame([(11, got[0]["text"])], "doc_id long, text string"), restore=True).head()["text"] == "mail ana@x.org"
    assert pii.pseudonymize(empty).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(awkward, key="")
    rows = [(None, "a@b.org"), (1, "a@b.org"), (1, "a@b.org"), (2, None), (3, ""), (4, LONG + " a@b.org"), (5, "x::y::z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, replaced int")
    new = pii.replace("a@b.org")[0]
    got = sorted(((r["doc_id"], r["text"][-7:], r["replaced"]) for r in pii.pseudonymize(docs).collect()), key=str)
    assert got == sorted([(None, new, 1), (1, new, 1), (1, new, 1), (4, new, 1)], key=str)


def slow_spans(rows, span):
    """The same from all spans of all texts: seeds, leaders and extensions word by word; only a span's fingerprint is the operator's."""
    import numpy as np

    from grovecut.llm.text import mix, words

    import pyarrow as pa

    texts, keys = [], []
    for i, t in rows:
        w = (t or "").split()
        if i is None or not w:
            continue
        hashed = words(pa.array([t], pa.large_string()))[3]
        assert len(hashed) == len(w)
        p = fingerprints.PrefixHashes(hashed)
        if len(w) < span:
            seeds = {0: ("short", tuple(w))}
        else:
            prints = [int(x) for x in mix(p.prints(np.arange(len(w) - span + 1), np.arange(span, len(w) + 1)))]
            prints = [x >> fingerprints._PLACE for x in prints]
            seeds = {}
            for k in range(max(1, len(prints) - span + 1)):
                least = min(prints[k : k + span])
                at = k + prints[k : k + span].index(least)
                seeds[at] = tuple(w[at : at + span])
        once: dict = {}
        for at in sorted(seeds):
            once.setdefault(seeds[at], at)
        texts.append((i, w))
        keys.append({at: seed for seed, at in once.items()})
    leaders: dict = {}
    for k in sorted(range(len(texts)), key=lambda k: texts[k][0]):
        for at, seed in sorted(keys[k].items()):
            leaders.setdefault(seed, (k, at))
    out = set()
    for k, (i, w) in enumerate(texts):
        for at, seed in keys[k].items():
            m, spot = leaders[seed]
            if texts[m][0] == i:
                continue
            v = texts[m][1]
            early = min(at, spot)
            x, y, run = at - early, spot - early, 0
            both = min(len(w) - x, len(v) - y)
            if len(w) < span:
                out.add((i, texts[m][0], 0, 0, len(w)))
                continue
            for j in range(both + 1):
                if j < both and w[x + j] == v[y + j]:
                    run += 1
                else:
                    if run >= span:
                        out.add((i, texts[m][0], x + j - run, y + j - run, run))
                    run = 0
    return out


def test_shared_spans_against_brute_force(spark, awkward, empty, monkeypatch):
    rng, rows = random.Random(12), []
    phrases = [[f"p{g}x{k}" for k in range(rng.randint(3, 90))] for g in range(8)]
    for i in range(120):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice("abcde") + str(rng.randrange(30)) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(w)))
    rows += [(200, "tiny text"), (201, "tiny  text"), (202, "tiny"), (203, ""), (204, None), (205, "a " * 100), (206, "a " * 90), (None, "tiny text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for portion in (512, 2):
        monkeypatch.setattr(fingerprints, "PORTION", portion)
        got = [tuple(r) for r in fingerprints.shared_spans(docs, span=8).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_spans(rows, 8)
    # whatever 2 * 8 - 1 words in a row two documents share, the later one shares 8 of them with a leader
    spans, found = {}, {}
    words = {i: (t or "").split() for i, t in rows}
    for i, _, start, _, n in got:
        found.setdefault(i, set()).update(tuple(words[i][k : k + 8]) for k in range(start, start + n - 7))
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 14):
            spans.setdefault(tuple(w[k : k + 15]), []).append((-1 if i is None else i, k))
    for places in spans.values():
        for i, k in places:
            if i > min(places)[0] >= 0:
                assert any(tuple(words[i][j : j + 8]) in found.get(i, ()) for j in range(k, k + 8))
    got = {tuple(r) for r in fingerprints.shared_spans(awkward).collect()}
    assert (2, 1, 0, 0, 80) in got and {(r[0], r[1]) for r in got} == {(2, 1), (3, 1)}
    assert fingerprints.shared_spans(empty).count() == fingerprints.fingerprints(empty).count() == 0
    prints = {r["doc_id"]: (r["whole"], r["words"]) for r in fingerprints.fingerprints(docs).collect()}
    assert prints[200] == prints[201] != prints[202] and prints[203] == (0, 0) and 204 not in prints


def test_op3_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.QUERIES["op3_fingerprints"](spark, SF).collect()]
    assert set(got) == slow_spans(rows, fingerprints.SPAN_WORDS) and len(got) == len(set(got)) and got


def brute_pack(rows, capacity, most, merges):
    """Windows as lists of (doc_id, start, length) from (doc_id, tokens) in order, group by group, with plain lists."""
    out, left = [], []
    for g, group in rows.items():
        open_, number = [], 0

        def emit(w):
            out.append(w["items"])

        for doc, n in group:
            start = 0
            while n - start >= capacity:
                out.append([(doc, start, capacity)])
                start += capacity
            if n and start == n:
                continue
            rest = n - start
            fits = [w for w in open_ if w["room"] >= rest]
            if fits:
                w = min(fits, key=lambda w: (w["room"], w["number"]))
            else:
                if len(open_) >= most:
                    fullest = min(open_, key=lambda w: (w["room"], w["number"]))
                    open_.remove(fullest)
                    emit(fullest)
                w = {"room": capacity, "number": number, "items": []}
                number += 1
                open_.append(w)
            w["items"].append((doc, start, rest))
            w["room"] -= rest
            if not w["room"]:
                open_.remove(w)
                emit(w)
        left += [(f"g{g}-{w['number']}", w["items"]) for w in open_]
    for group in merges(left):
        open_ = []
        for size, name, items in sorted(((sum(i[2] for i in items), name, items) for name, items in group), key=lambda x: (-x[0], x[1])):
            fits = [w for w in open_ if w[0] >= size]
            w = min(fits, key=lambda w: (w[0], w[1])) if fits else [capacity, len(open_), []]
            if not fits:
                open_.append(w)
            w[0] -= size
            w[2] += items
        out += [w[2] for w in open_]
    return Counter(tuple(w) for w in out)


def test_packing_against_brute_force(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table, capacity, most, per in ((docs, 2048, 64, 10**6), (docs, 300, 3, 40), (awkward, 100, 2, 5)):
        groups = max(1, -(-table.count() // per))
        keyed = table.select("doc_id", F.length("text").alias("chars"), "text", F.xxhash64("doc_id", "text").alias("h")).collect()
        rows = {}
        for r in sorted(keyed, key=lambda r: (r["h"], -1 if r["doc_id"] is None else r["doc_id"])):
            rows.setdefault(r["h"] % groups, []).append((r["doc_id"], len((r["text"] or "").split())))
        got = {}
        for packed in (packing.pack(table, capacity, most, group_docs=per), packing.pack(table.repartition(7), capacity, most, group_docs=per)):
            windows = {}
            for r in sorted(packed.collect(), key=lambda r: (r["window_id"], r["offset"], r["length"])):
                windows.setdefault(r["window_id"], []).append(r)
            for w in windows.values():
                at = 0
                for r in sorted(w, key=lambda r: (r["offset"], r["length"])):
                    assert r["offset"] == at and r["piece"] == r["start"] // capacity
                    at += r["length"]
                assert at <= capacity
            got = Counter(tuple(sorted(((r["doc_id"], r["start"], r["length"]) for r in w), key=str)) for w in windows.values())
            want = Counter(tuple(sorted(w, key=str)) for w in brute_pack(rows, capacity, most, lambda left: [left]).elements())
            assert got == want
    assert packing.pack(empty).count() == 0


def slow_mix(rows, weights, levels, keep=None):
    """(doc_id, source): level, by sorting each source's documents by hash."""
    import hashlib

    docs = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), i, s, len((t or "").split())) for i, t, s in rows]
    n = Counter()
    for _, _, s, k in docs:
        n[s] += k
    w = {s: (k**0.5 if weights is None else weights.get(s, 0)) for s, k in n.items() if k}
    w = {s: x for s, x in w.items() if x > 0}
    if not w:
        return Counter()
    if keep is None:
        scale = min(n[s] / w[s] for s in w)
        budget = {s: [int(scale * w[s] * x + 1e-6) for x in levels] for s in w}
    else:
        low, high = 0.0, max(n[s] / w[s] for s in w)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(n[s], mid * w[s]) for s in w) <= keep * sum(n[s] for s in w) else (low, mid)
        budget = {s: [int(min(n[s], high * w[s]) + 1e-6)] for s in w}
    out = Counter()
    for s in w:
        used = Counter()
        for p, _, t, k in docs:
            if t == s:
                used[p] += k
        upto, total = {}, 0
        for p in sorted(used):
            total += used[p]
            upto[p] = total
        for p, i, t, _ in docs:
            if t == s and (level := next((k for k, b in enumerate(budget[s]) if upto[p] <= b), None)) is not None:
                out[i, s, level] += 1
    return out


@pytest.mark.parametrize("weights,keep", [(None, None), ({"a": 1.0, "b": 1.0, None: 1.0}, None), ({"a": 3.0, "zz": 2.0}, None), (None, 0.9), (None, 0.4), ({"a": 1.0, "b": 5.0}, 0.7), (None, 1.0), ({}, None)])
def test_mixing_against_brute_force(spark, awkward, empty, weights, keep):
    rng = random.Random(3)
    rows = [(k % 390, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "b", "b", None, "stray"][: 6 if k else 7])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for table, of in ((docs, rows), (awkward, [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()])):
        levels = (0.5, 1.0)
        out = mixing.mix(table, weights, levels, keep=keep)
        got = Counter((r["doc_id"], r["source"], r[out.columns[-1]]) for r in out.collect())
        assert out.columns[:-1] == table.columns and got == slow_mix(of, weights, levels, keep)
    assert mixing.mix(empty, weights, keep=keep).count() == 0
    assert mixing.mixed(awkward, 1.0).columns == awkward.columns


def test_a_stray_source_does_not_empty_a_mixture(spark):
    rows = [(k, "w " * 50, "ab"[k % 2]) for k in range(400)] + [(1000, "w", "stray")]
    kept = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.9)
    by = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    assert by["stray"] == 1 and min(by["a"], by["b"]) >= 175


def test_urls(spark, empty):
    pages = [(1, "http://www.spam-farm.example.org/x.html?utm_source=a#t", ""), (2, "https://clean.org/a", '<link href="https://spam-farm.example.org/x" rel="canonical">'), (3, "http://clean.org/b/", None), (4, None, "x"), (5, "", ""), (6, "https://free-bets.example.net/en/1", ""), (7, "https://free-bets.example.net/de/1", ""), (8, "http://r.org/1", '<meta http-equiv="refresh" content="0; url=/go">'), (9, "http://r.org/go", ""), (10, "http://sub.casino-win.example.net", ""), (3, "http://clean.org/b/", None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, node string")
    got = sorted(((r["page_id"], r["decision"]) for r in urls.decide(df, redirects=spark.createDataFrame([("http://r.org/go", "https://ads-track.example.com/z")], "source string, target string")).collect()))
    assert got == [(1, "block"), (2, "block"), (3, "none"), (3, "none"), (4, "none"), (5, "none"), (6, "allow"), (7, "block"), (8, "block"), (9, "block"), (10, "block")]
    assert urls.decide(df.limit(0)).count() == 0


def linked_pages(rng):
    """Pages whose links are of every kind and form connected groups of several hosts."""
    hosts = ["a.org", "www.b.net", "m.c.com", "Casino-Win.example.net", "free-bets.example.net", "d.org:8080", "sub.cheap-pills.example.com"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/x.html', '/p/', '/p/index.html', '/P', '/en'])}{rng.choice(['', '?a=1&utm_x=2', '?b=2&a=1', '#t'])}"
    rows = []
    for k in range(150):
        to = rng.choice([url(), "/en/y", "z.html", "?q=1", "//a.org/p", url().replace("&", "&amp;"), "/P?x=1&#38;y=2"])
        q = rng.choice(["'", '"', ""])
        html = rng.choice([
            "", "<p>nothing</p>", "<link rel=stylesheet href=/x.css>",
            f"<html><LINK href={q}{to}{q} rel={q}canonical{q}>", f"<link rel=icon href=/i><link rel='canonical' data-x=1 href={q}{to}{q}/>", f"<meta http-equiv={q}refresh{q} content='0; url={to}'>",
        ])
        rows.append((k, rng.choice([None, "", "no host", "mailto:x@y"]) if rng.random() < 0.1 else url(), html if rng.random() < 0.9 else None))
    return rows + rows[:3], [(url(), url()) for _ in range(12)] + [(None, url()), (url(), None)]


@pytest.mark.parametrize("seed", range(3))
def test_url_decisions_equal_their_sql_on_linked_pages(spark, seed):
    import duckdb
    import pandas as pd
    from conftest import rows

    pages, redirects = linked_pages(random.Random(seed))
    con = duckdb.connect()
    frames = [pd.DataFrame(pages, columns=["page_id", "url", "html"]), pd.DataFrame(redirects, columns=["source", "target"])]
    con.register("pages", frames[0])
    con.register("redirects", frames[1])
    got = urls.decide(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), redirects=spark.createDataFrame(redirects, "source string, target string"))
    want = con.execute(urls.sql("SELECT source, target FROM redirects WHERE source IS NOT NULL AND target IS NOT NULL")).df()
    assert rows(got.toPandas()) == rows(want) and len(set(want.decision)) == 3 and want.resource.nunique() < want.url.nunique()


def test_url_rules_and_links(spark):
    pages = [(1, "https://a.org/Path/x", ""), (2, "https://a.org/path/x", ""), (3, "https://b.org/1", '<link rel=canonical href="//A.org/Path/y">'), (4, "https://b.org/d/2", '<link rel=canonical href="3?x=1&amp;y=2">'), (5, "https://b.org/d/3?y=2&x=1", '<meta http-equiv=refresh content="0;url=//a.org/Path">'), (None, "https://a.org/Path", ""), (6, "https://b.org/" + "z" * 50_000, '<link rel=canonical href="https://a.org/Path/' + "q" * 50_000 + '">')]
    got = urls.decide(spark.createDataFrame(pages, "page_id long, url string, html string"), block=["A.org/Path"], allow=[]).collect()
    assert {r["page_id"]: r["decision"] for r in got} == {1: "block", 2: "none", 3: "block", 4: "block", 5: "block", None: "block", 6: "block"}


def test_wrappers(spark):
    page = lambda t, items: f"<h1>{t}</h1><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul><p>Imprint</p>"
    pages = [(1, "http://h/1", page("One", "ab")), (2, "http://h/2", page("Two", "cd")), (2, "http://h/2", page("Two", "cd")), (3, "http://i/", page("Three", "e")), (4, None, None), (5, "http://h/3", ""), (6, "http://h/4", page("Big", ["word"] * 30_000))]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, form int")
    got = [(r["page_id"], r["slots"]) for r in wrappers.extract(df).orderBy("page_id").collect()]
    assert [(i, s[:5]) for i, s in got] == [(1, ["One", "a", "b"]), (2, ["Two", "c", "d"]), (2, ["Two", "c", "d"]), (3, ["Three", "e", "Imprint"]), (4, []), (5, []), (6, ["Big", "word", "word", "word", "word"])]
    assert len(got[-1][1]) == 30_001 and wrappers.extract(df.limit(0)).count() == 0


def site(rng, number, n):
    """Pages of one host from a made template, and the texts of each that aren't its template's."""
    parts = []
    for k in range(rng.randint(4, 9)):
        parts.append((rng.choice(["fixed", "slot", "maybe", "list", "cards"]), k))
    pages = []
    for page in range(n):
        out, slots = [f"<html><body id={page}>"], []

        def slot(tag):
            slots.append(f"s{len(slots)} {page} {rng.random()}")
            return f"<{tag}>{slots[-1]}</{tag}>"

        for kind, k in parts:
            if kind == "fixed":
                out.append(f"<h{k}>Menu {k}</h{k}>")
            elif kind == "slot":
                out.append(slot(f"p{k}"))
            elif kind == "maybe" and rng.random() < 0.6:
                out.append(f"<div{k}><em{k}>Ad {k}</em{k}>{slot(f'q{k}')}</div{k}>")
            elif kind == "list":
                out.append(f"<ul{k}>" + "".join(slot(f"li{k}") for _ in range(rng.randint(1, 4))) + f"</ul{k}>")
            elif kind == "cards":  # a record of 31 tokens and texts with a text that never changes
                card = lambda: "".join(f"<c{k}x{j}></c{k}x{j}>" for j in range(12)) + slot(f"c{k}") + f"<b{k}>Read on</b{k}>"  # noqa: B023, E731
                out.append(f"<div{k}>" + "".join(card() for _ in range(rng.randint(1, 3))) + f"</div{k}>")
        out.append("<footer>Imprint</footer></body></html>")
        pages.append((1000 * number + page, f"https://h{number}.org/{page}", "".join(out), slots))
    return pages


def test_wrappers_find_the_slots_of_made_templates(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for number in range(12):
        rows += site(rng, number, rng.randint(5, 60))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5)
    want = {r[0]: r[3] for r in rows}
    for portion in (256, 3):  # wrappers of portions are merged
        monkeypatch.setattr(wrappers, "FORMS_PORTION", portion)
        got = {r["page_id"]: r["slots"] for r in wrappers.extract(df).collect()}
        texts = lambda of: [of[i] for i in sorted(want)]
        assert texts(got) == texts(want)


def test_wrappers_on_odd_pages(spark):
    """Null and repeated ids, names that clash, deeply nested groups, pages of one tag and of no host."""
    nested = "<a>x</a>"
    for k in range(12):
        nested = f"<t{k}>{nested}{nested}</t{k}>"
    pages = [(None, "http://h/1", "<p>same</p><b>1</b>"), (None, "http://H/2", "<p>same</p><b>2</b>"), (3, None, "<p>u</p>"), (4, "no host", "<p>v</p>"), (5, "http://deep/", nested), (5, "http://deep/", nested), (6, "http://one/", "<p>"), (7, "http://two/", "< & text"), (8, "http://h/3", None)]
    df = spark.createDataFrame([(*p, "n", 1, True) for p in pages], "page_id long, url string, html string, name string, leaf int, fixed boolean")
    got = sorted(((r["page_id"], r["slots"]) for r in wrappers.extract(df).collect()), key=str)
    assert got == sorted([(None, ["1"]), (None, ["2"]), (3, ["u"]), (4, ["v"]), (5, []), (5, []), (6, []), (7, ["< & text"]), (8, [])], key=str)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_a_common_part_of_pages_of_different_forms_is_template(spark):
    pages = [(i, f"http://h/{i}", f"<h1>T{i}</h1>" + "".join(f"<i{j}>x{i}{j}</i{j}>" for j in range(i)) + "<p>Imprint</p>") for i in range(4)]
    learned, _ = wrappers.wrappers(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert learned.count() == 1
    got = {r["page_id"]: r["slots"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: [f"T{i}"] + [f"x{i}{j}" for j in range(i)] for i in range(4)}


def test_toxicity_held_out(spark, awkward, empty):
    """All four languages, each with what was learned from the other half of the labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    found = {r["doc_id"] for r in toxicity.toxic(docs, model).select("doc_id").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    clean = [r["doc_id"] for r in held if not r["toxic"]]
    assert sum(i in found for i in clean) <= 0.01 * len(clean)
    for of, least in (("en", 0.9), ("de", 0.85), ("fr", 0.85), ("es", 0.7)):
        bad = [r["doc_id"] for r in held if r["toxic"] and lang[r["doc_id"]] == of]
        assert bad and sum(i in found for i in bad) >= least * len(bad), of
    kept = toxicity.without_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert [(r["doc_id"], r["quoted"]) for r in toxicity.toxic(awkward, model).collect()] == [(10, 0)]
    assert toxicity.toxic(empty, model).count() == 0 and toxicity.without_toxic(empty, model).count() == 0
    assert {t[0] for t in toxicity.fit(empty, labels).terms} == set(toxicity.SEED)
    assert {t[0] for t in toxicity.fit(docs, labels.limit(0)).terms} == set(toxicity.SEED)
    twice = toxicity.fit(docs.limit(50), labels.union(labels))
    assert twice.key() == toxicity.fit(docs.limit(50), labels).key()


def brute_score(text, model):
    """A document's score by edit distances, word by word."""
    import re

    from test_functions import best_term

    text = text.lower()
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    words = [text[a:b] for a, b in spans]
    rules = [(t, b, e) for t, b, _, _, e in model.terms]
    close = [t for t, *_ in rules]
    hits = []
    for k, w in enumerate(words):
        if any(abs(len(w) - len(t)) <= 2 or len(w) > len(t) for t in close) and (best := BEST.setdefault((model.key(), w), best_term(w, rules))):
            if best[0] == 0 or w not in model.not_these:
                hits.append((k, best[1], best[0]))
    marks = [i for i, c in enumerate(text) if c in toxicity.MARKS]
    inside = {}
    for k, _, _ in hits:
        before = [i for i in marks if i < spans[k][0]]
        after = [i for i in marks if i >= spans[k][0]]
        inside[k] = len(before) % 2 == 1 and bool(after) and after[0] >= spans[k][1] and sum(before[-1] <= a < after[0] for a, _ in spans) <= toxicity.QUOTE_WORDS
    worst = 0.0
    for k, t, e in hits:
        if model.terms[t][3] > max(1, sum(u == t and not inside[x] for x, u, _ in hits)):
            continue
        near = words[max(0, k - toxicity.WINDOW) : k] + words[k + 1 : k + toxicity.WINDOW + 1]
        others = sum(x != k and abs(x - k) <= toxicity.WINDOW and not inside[x] for x, _, _ in hits)
        s = model.terms[t][2] * (1.0, 0.8, 0.7)[e] * (1 + 0.15 * min(others, 4)) * (0.35 if inside[k] else 1)
        s *= 0.7 if toxicity.REPORTING & set(near) else 1
        s *= 1.3 if not inside[k] and toxicity.SECOND & set(near) else 1
        worst = max(worst, s)
    return min(1.0, worst)


BEST: dict = {}


def test_toxicity_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    want = {r["doc_id"]: s for r in docs.where("text IS NOT NULL").collect() if (s := brute_score(r["text"], model)) >= toxicity.THRESHOLD}
    got = {r["doc_id"]: r["score"] for r in registry.QUERIES["op9_toxicity"](spark, SF).collect()}
    assert want and got == pytest.approx(want)


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    flagged = {r["doc_id"] for r in toxicity.toxic(docs, model).collect()}
    now = {i: t for i, t in texts.items() if i not in flagged}
    first: dict = {}
    for i in sorted(now):
        first.setdefault(now[i], i)
    now = {i: t for t, i in first.items()}
    root = {i: i for i in now}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in jaccard_pairs(sorted(now.items())):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    now = {i: t for i, t in now.items() if top(i) == i}
    out = docs
    for name, stage in P.STAGES[:3]:
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(now)
    mixed = P.STAGES[3][1](spark, out, SF).cache()
    kept = {r["doc_id"] for r in mixed.collect()}
    assert kept == {i for i, _, _ in slow_mix([(r["doc_id"], r["text"], r["source"]) for r in out.collect()], None, (1.0,), P.KEEP_TOKENS)}
    packed = P.STAGES[4][1](spark, mixed, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert mixed.columns == docs.columns and {r["doc_id"]: r["n"] for r in packed} == {i: len(now[i].split()) for i in kept} and kept
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]


def test_pipeline_run_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    import corpus_pipeline as P

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = P.run(spark, folder)
        assert out.columns == ["window_id", "doc_id", "piece", "start", "length", "offset"]
        by = Counter()
        for r in out.collect():
            by[r["doc_id"]] += r["length"]
        if name == "empty":
            assert not by
            continue
        # 10 is toxic, 2 and the third copy of 1 go, 6 is as empty as 5, 7 comes once, 3 is nearly 1
        now = [(1, 80, "a"), (4, 0, "b"), (5, 0, "c"), (None, 2, None), (7, 60_000, "a"), (8, 1, "b"), (9, 0, "b"), (11, 2, "c")]
        mixed = slow_mix([(i, "w " * n, s) for i, n, s in now], None, (1.0,), P.KEEP_TOKENS)
        sizes = {i: n for i, n, _ in now}
        assert by == Counter({i: sizes[i] for i, _, _ in mixed}) and set(by) == {i for i, _, _ in mixed}
        shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        import glob

        assert all(len(glob.glob(f"{f}/*")) == 1 for f in glob.glob(shared.removeprefix("file:") + "/pipeline-*"))
