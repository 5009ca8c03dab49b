"""Parts that need no Spark, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grovecut.llm import exact, fingerprints, ngramjoin, packing, pii, suffixes, text, toxicity, wrappers


def large(texts):
    return pa.array(texts, pa.large_string())


def test_words_and_grams_depend_on_words_only():
    texts = ["a b  c", None, "", " \n\t", "x a b c", "ä b\r\nc", "a b c"]
    start, end, bounds, h = text.words(large(texts))
    assert np.diff(bounds).tolist() == [3, 0, 0, 0, 4, 3, 3]
    assert h[0:3].tolist() == h[4:7].tolist() == h[10:13].tolist() and h[7] != h[0]
    g, gb = text.grams(h, bounds, 2)
    assert np.diff(gb).tolist() == [2, 0, 0, 0, 3, 2, 2] and g[:2].tolist() == g[3:5].tolist() == g[7:9].tolist()
    assert text.count_words(large(texts)).tolist() == text.count_words(pa.array(texts)).tolist() == [3, 0, 0, 0, 4, 3, 3] and len(text.count_words(pa.array([], pa.string()))) == 0
    assert [len(p) for _, p in text.chunks(large(texts), 1)] == [1, 3, 1, 1, 1] or sum(len(p) for _, p in text.chunks(large(texts), 1)) == 7


@pytest.mark.parametrize("seed", range(10))
def test_golomb_round_trip(seed):
    rng = np.random.default_rng(seed)
    for bits in (8, 20, 48):
        v = np.sort(rng.integers(0, 2**bits, rng.integers(0, 500), dtype=np.uint64))
        assert (exact.ungolomb(exact.golomb(v, exact.rice(bits, len(v))), len(v), exact.rice(bits, len(v))) == v).all()


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("small", [3, 8192])
def test_quicksort_groups_equal_windows(seed, small, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_GROUP", small)
    rng = np.random.default_rng(seed)
    n, length = int(rng.integers(20, 1500)), int(rng.integers(2, 9))
    words = rng.integers(0, rng.integers(2, 6), n).astype(np.uint32)
    at = np.arange(n - length + 1)
    names, _ = text.grams(text.mix(words.astype(np.uint64)), np.array([0, n]), length)
    want, got = {}, {}
    for i in at.tolist():
        want.setdefault(tuple(words[i : i + length]), []).append(i)
    for x, g in suffixes.quicksort(words, at, length, names).tolist():
        got.setdefault(g, []).append(x)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(10))
def test_equal_windows_have_equal_anchors(seed):
    rng = random.Random(seed)
    words = " ".join(rng.choice("abc") for _ in range(300))
    _, _, bounds, h = text.words(large([words, words[40:], "a " * 100, "a b"]))
    at, start, runs = suffixes.anchors(h, bounds, 12)
    assert runs.sum() == np.maximum(np.diff(bounds) - 11, 0).sum()
    seen = {}
    for a, s, n in zip(at, start, runs):
        for p in range(s, s + n):
            assert p <= a <= p + 12 - suffixes.ANCHOR_WORDS
            key = tuple(h[p : p + 12])
            assert seen.setdefault(key, a - p) == a - p


@pytest.mark.parametrize("seed", range(5))
def test_longest_extensions(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 2, 400).astype(np.uint64) * np.uint64(0x123456789ABCDEF1) + np.uint64(7)
    p = fingerprints.PrefixHashes(w)
    a, b = rng.integers(0, 400, 50), rng.integers(0, 400, 50)
    most = np.minimum(400 - a, 400 - b)
    brute = [next((k for k in range(m) if w[x + k] != w[y + k]), m) for x, y, m in zip(a, b, most)]
    assert p.extension(a, b, most).tolist() == brute
    most = np.minimum(a, b)
    brute = [next((k for k in range(m) if w[x - 1 - k] != w[y - 1 - k]), m) for x, y, m in zip(a, b, most)]
    assert p.extension(a, b, most, back=True).tolist() == brute
    s, e = np.minimum(a, b), np.maximum(a, b)
    f = p.spans(s, e)
    assert all((f[i] == f[j]) == (w[s[i] : e[i]].tolist() == w[s[j] : e[j]].tolist()) for i in range(20) for j in range(20))


def test_packer_keeps_its_bounds():
    rng, p, out = random.Random(1), packing.Packer(100, 4), []
    sizes = [rng.randint(0, 100) for _ in range(500)]
    for i, n in enumerate(sizes):
        if (full := p.add(i, n)) is not None:
            out.append(full)
        out += p.done()
        assert len(p.open) <= 4
    out += p.rest()
    assert sorted(i for _, items in out for i in items) == list(range(500)) and len({n for n, _ in out}) == len(out)
    assert all(sum(sizes[i] for i in items) <= 100 for _, items in out)


def distance(a, b):
    """Edits from a to b, a swap of neighbours being one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def best_term(word, terms):
    """(edits, term) of the best of terms (text, is a beginning, edits allowed) for a word, or None."""
    found = []
    for k, (t, beginning, most) in enumerate(terms):
        e = min(distance(word[:n], t) for n in (range(len(word) + 1) if beginning else [len(word)]))
        if e <= most:
            found.append((e, k))
    return min(found, default=None)


def test_automaton_is_the_edit_distance():
    terms = [("moron", False, 1), ("morose", False, 1), ("worthless", False, 2), ("abc", False, 0), ("stem", True, 0), ("begin", True, 1), ("worst", True, 1)]
    rng, words = random.Random(3), ["oron", "stemming", "ste", "wrthles", "morons", "", "abc", "abd", "xmoron", "1oron", "moro", "omron", "mroon", "mrono", "wrothless", "worhtlses", "wosrt", "ebgin", "beging", "bgins", "ebegin", "worstless", "wort"]
    for t, *_ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcdemorstwhlx")
                w[k : k + rng.randint(0, 1)] = c if rng.random() < 0.7 else ""
                if rng.random() < 0.3:
                    w[k : k + 2] = w[k : k + 2][::-1]
            words.append("".join(w))
    words = [w for w in words if w]
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    found = {w: (e, t) for w, t, e in toxicity.Automaton(terms).run(codes, end - [len(w) for w in words], end)}
    for i, w in enumerate(words):
        assert found.get(i) == best_term(w, terms), w


def test_quotation_is_not_abuse():
    m = toxicity.Model([("idiot", False, 1.0, 1)])
    score = lambda t: next((s for _, s, *_ in m.scores(pa.array([t]), toxicity._automaton(m))), 0.0)
    assert score("you are an idiot") >= toxicity.THRESHOLD and score("what an idoit idi0t") >= toxicity.THRESHOLD
    assert 0 < score('he said "that idiot" and left') < toxicity.THRESHOLD and score("all is fine") == 0.0
    long = "fine words " * 40_000
    assert score(long) == 0.0 and score(long + "you idiot " + long) >= toxicity.THRESHOLD


@pytest.mark.parametrize("word", ["1diot", "xdiot", "diot", "idoit", "diiot", "5tupid", "stupd", "worthles", "orthless", "disgustng", "widerlch", "estupido"])
def test_misspelled_anywhere(word):
    m = toxicity.Model(toxicity.with_seed([("idiot", False, 0.83, 1)], toxicity.SEED))
    assert [s >= toxicity.THRESHOLD for _, s, *_ in m.scores(pa.array([f"what a {word} here"]), toxicity._automaton(m))] == [True]


def test_a_learned_beginning_leaves_the_seed_its_edits():
    learned = [("idiot", True, 0.97, 1), ("moron", False, 0.9, 3), ("pathetic", False, 0.9, 1)]
    m = toxicity.Model(toxicity.with_seed(learned, toxicity.SEED))
    score = lambda t: next((s for _, s, *_ in m.scores(pa.array([t]), toxicity._automaton(m))), 0.0)
    for word in ("idiot", "idiots", "idi0t", "idiiot", "moron", "morron", "pathetic", "patetic"):
        assert score(f"what a {word} here") >= toxicity.THRESHOLD, word
    assert score("all is fine") == 0.0


VALUES = {
    "card": ["4111 1111 1111 1111", "4785380592391139", "3782 822463 10005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ip": ["10.0.200.7"],
    "ip6": ["2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "fe80::aabb:1"],
    "date": ["2024-02-29", "2024-02-29T10:00:00Z", "31.12.1999", "12/31/1999", "05/06/1999", "1899-05-01", "0732-01-31", "March 12, 2021", "3 March 2021", "12 de mayo de 2020", "05. September 1999", "1er janvier 2000", "4. Mai 1905"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "555-123-4567", "(555) 123-4567", "5551234567", "+15551234567", "+49 30 1234567"],
    "email": ["Ana.Lo-99@mail.example.com", "李明@x.org", "jürgen@mail.de", "ÀB_c@ä.fr"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
@pytest.mark.parametrize("around", ["{}", "call {}, now", "({})", "1 {} 12/25", "No 7: {} 2024 x", "{}\n{}"])
def test_pseudonyms_are_valid_and_can_be_undone(kind, value, around):
    if kind == "phone" and value.startswith("+49") and "2024" in around or value == "5551234567" and around.startswith("1 "):
        return  # whether the year belongs to the number can't be told
    whole = around.replace("{}", value)
    new, n = pii.replace(whole)
    assert n == around.count("{}") and value not in new and pii.replace(new, back=True) == (whole, n)
    assert pii.replace(new)[0] != new and pii.replace(value, key="other")[0] != pii.replace(value)[0]
    alone = pii.replace(value)[0]
    assert new == around.replace("{}", alone) and pii.replace(alone)[1] == 1
    shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s))
    assert kind in ("ip", "ip6", "date") or shape(alone) == shape(value)
    if kind == "ip6":
        import ipaddress

        assert ipaddress.ip_address(alone) and alone.count(":") == value.count(":") and (alone.upper() == alone) == (value.upper() == value)


def test_one_day_has_one_pseudonym():
    assert {pii.replace(x)[0] for x in ("31.12.1999", "31.12.1999 and", "(31.12.1999)")} == {f"{x}" for x in (pii.replace("31.12.1999")[0], pii.replace("31.12.1999")[0] + " and", "(" + pii.replace("31.12.1999")[0] + ")")}
    y, m, d = pii.replace("1999-12-31")[0].split("-")
    assert pii.replace("31.12.1999")[0] == f"{d}.{m}.{y}" and pii.replace("1999/12/31")[0] == f"{y}/{m}/{d}" and y.startswith("19")


def test_the_whole_key_counts():
    long = "k" * 64
    assert pii.replace("2024-02-29", key=long + "a")[0] != pii.replace("2024-02-29", key=long + "b")[0]
    for bad in (lambda: pii.replace("x", key=""), lambda: pii.permute(1, 9, "", "t"), lambda: pii._replaced("", False)):
        with pytest.raises(ValueError):
            bad()


def test_what_is_not_valid_stays():
    for t in ("", "4111 1111 1111 1112", "2024-02-30", "999.1.1.1", "000-12-3456", "version 1.2.3", "DE00 3704 0044 0532 0130 00", "a@b", "12:30:45", "31 June 2020", "13/13/1999", "x4111111111111111", "1234567", "1:2:3:4:5:6:7:8:9", "::1"):
        assert pii.replace(t) == (t, 0), t
    for n in (2, 7, 100, 73049):
        assert sorted(pii.permute(i, n, "k", "t") for i in range(min(n, 2000)) if n <= 2000) == (list(range(n)) if n <= 2000 else [])
    long = "word 12 and 3.5 " * 20_000
    new, n = pii.replace(long + "4111 1111 1111 1111 " + long)
    assert n == 1 and new.startswith(long) and new.endswith(long)


def slow_values(text):
    """Values by trying every start and end between blanks and brackets, independently of the operator's patterns."""
    import datetime
    import ipaddress

    out = []
    for m in re.finditer(r"[^\s,;()<>\"']+@[^\s,;()<>\"']+", text):
        out.append(m[0].rstrip(".:"))
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    for k, (a, _) in enumerate(words):
        for _, e in words[k : k + 9]:
            t = text[a:e].strip(".,;:!?\"'")
            d = re.sub(r"\D", "", t)
            if not d or re.search(r"[A-Za-z]", t) and not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,36}", t):
                continue
            if re.fullmatch(r"[\d -]+", t) and 13 <= len(d) <= 16 and pii.luhn(d) and len(set(d)) > 1 and re.fullmatch(r"\d{13,16}|(\d{4}[ -]){3}\d{4}", t):
                out.append(t)
            if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]+", t) and 15 <= len(t.replace(" ", "")) <= 34 and pii.mod97(t.replace(" ", "")) == 1:
                out.append(t)
            if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", t):
                try:
                    out.append(str(ipaddress.IPv4Address(t)))
                except ValueError:
                    pass
            if re.fullmatch(r"\d{3}-\d\d-\d{4}", t) and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000":
                out.append(t)
            for shape in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
                try:
                    if len(t) == 10:
                        datetime.datetime.strptime(t, shape)
                        out.append(t)
                except ValueError:
                    pass
            if re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", t):
                out.append(t)
    return set(out)


def test_no_value_that_a_slow_finder_knows_is_left():
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna().tolist()
    found = 0
    for t in texts:
        if not re.search(r"\d|@", t):
            continue
        new, n = pii.replace(t)
        here = slow_values(t)
        found += len(here)
        assert len(here) <= n and not [v for v in here if re.search(r"(?<!\w)" + re.escape(v) + r"(?!\w)", new)], here
        assert pii.replace(new, back=True)[0] == t
        if not n:
            assert new == t
    assert found > 50


def covers(wrapper, stream):
    return re.fullmatch(wrappers.pattern(wrapper), "".join(t + " " for t in stream)) is not None


def required(stream):
    return [[x, 0] for x in wrappers.form(wrappers.fold(stream))]


def test_wrapper_of_a_template():
    page = lambda title, items, ad: f"<html><script>x</script><h1>{title}</h1><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>{'<div>' + ad + '</div>' if ad else ''}<p>All rights reserved</p></html>"
    pages = [page("One", "ab", ""), page("Two", "cde", "buy"), page("Three", "f", ""), page("Four", "gh", "now")]
    streams = [[t for t, _ in wrappers.tokens(p)] for p in pages]
    w = wrappers._merged(map(required, streams))
    assert all(covers(w, s) for s in streams) and "+" in wrappers.pattern(w) and "?" in wrappers.pattern(w)
    assert not covers(w, streams[0][1:])
    spots = [wrappers.places(w, wrappers.form(wrappers.fold(s))) for s in streams]
    assert len({x[0] for x in spots}) == len({x[-1] for x in spots}) == 1 and min(min(x) for x in spots) == 0
    assert wrappers.tokens(None) == wrappers.tokens("") == [] and wrappers.tokens("a < b")[0][0] == "#"


@pytest.mark.parametrize("length", [1, 7, 8, 9, 24, 26, 63, 65, 700])
def test_records_of_any_length_fold(length):
    part = [f"<t{i}>" if i % 3 else f"#<t{i - 1}>" for i in range(length)]
    folded = wrappers.fold(["<a>", *part * 6, "<b>"])
    assert [i[0] for i in folded[::2]] == ["<a>", "<b>"] and len(folded) == 3 and len(folded[1][1]) == length
    assert all(len(x) == 6 for x in folded[1][2]) and len(folded[1][2]) == sum(x[0] == "#" for x in part)


@pytest.mark.parametrize("seed", range(60))
def test_alignment_covers_all(seed):
    rng = random.Random(seed)

    def stream():
        out = ["<a>"]
        for _ in range(rng.randint(1, 6)):
            out += rng.choice([["<p>", "#<p>", "</p>"], ["<b>", "</b>"], ["<li>", "#<li>", "</li>"] * rng.randint(1, 3), ["#<a>"], ["<x>", "<li>", "#<li>", "</li>", "</x>"] * rng.randint(1, 2)])
        return out + ["</a>"]

    streams = [stream() for _ in range(6)]
    for w in (wrappers._merged(map(required, streams)), wrappers.align(wrappers._merged(map(required, streams[:3])), wrappers._merged(map(required, streams[3:])))):
        for s in streams:
            folded = wrappers.fold(s)
            assert covers(w, s), (s, wrappers.pattern(w))
            assert sorted(k for i in folded for x in i[2] for k in x) == [k for k, x in enumerate(s) if x[0] == "#"]
            spots = wrappers.places(w, wrappers.form(folded))
            assert len(spots) == sum(len(i[2]) for i in folded) and spots.count(-1) <= 2


def test_common_subsequence_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = wrappers.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_sets_of_short_texts():
    _, bounds, g = next(ngramjoin.sets(pa.array(["a b c d", "a b", None, "b a"]), 3))
    assert np.diff(bounds).tolist() == [2, 1, 0, 1] and len(set(g.tolist())) == 4
