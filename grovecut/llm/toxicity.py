"""Toxic documents by Levenshtein automata over a lexicon trie, with context that tells quotation from abuse.

The lexicon is a seed and what is learned from labelled documents: word beginnings (3 to 9 letters) and words that occur
nearly only in toxic ones, each as long as its support allows. Every term, seed or learned, word or beginning, is matched
with as many edits as its length allows (see edits()), the first letter included, and a swap of neighbours is one edit; terms
of fewer than 5 letters are matched exactly, and so are learned terms whose near words are found in clean labelled documents (see fit()).
The Levenshtein automata of all terms are intersected with the trie into one deterministic automaton, whose states are
built as words reach them; it runs over all words of a batch at once, one character a step, in numpy. Words that look like
misspellings of a term but occur in clean labelled documents as often as in toxic ones are left alone.

A hit's score is its term's weight, less for edits, less within quotation marks (QUOTE_WORDS apart at most) or near a word
of reporting, more next to the second person or other hits. A document's score is that of its worst hit, so that a text may
quote much.

Null and empty texts have no hits and score 0. Very long texts are read whole. Repeated rows and rows without an id are
scored each; of several labels of one id the highest counts. Of several terms a word matches the one with the fewest edits,
then the first in the alphabet. Without labels the lexicon is the seed. An empty table gives an empty result. Other columns
may have any names.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, table, tidy_batches
from .text import CHUNK_BYTES, chunks

#: Labelled rows that the lexicon is learned from at most, chosen by hash of the id.
MAX_LABELLED = 6000
#: A term's least share of toxic documents, its least number of them, and the support that a longer term keeps.
PURITY, SUPPORT, KEEP = 0.85, 4, 0.9
#: The chance that a term which says nothing gets in; divided by the number of features it is the level of the test.
CHANCE = 0.01
#: Occurrences in a document that count as a sign of their own: some beginnings are toxic only where they pile up.
PILE = 3
#: Documents from this score on are toxic.
THRESHOLD = 0.5
#: Words on either side of a hit that count as its context.
WINDOW = 8
#: Words between two quotation marks up to which they are a pair.
QUOTE_WORDS = 40

SEED = tuple(
    "idiot moron stupid loser scum worthless pathetic disgusting imbecile "
    "trottel arschloch abschaum versager wertlos erbärmlich widerlich schwachkopf "
    "idiota estúpido estúpida imbécil escoria patético asqueroso "
    "crétin imbécile pathétique dégoûtant abruti".split()
)
REPORTING = frozenset("said says say called calls call calling quoted quote quotes wrote writes word words term insult insulted slur sagte sagt nannte schrieb wort dit disait appelé écrit mot dijo dice llamó escribió palabra".split())
SECOND = frozenset("you your yours u du dich dir dein deine ihr euch tu toi vous votre ton tú te usted tus".split())
MARKS = frozenset('"“”„«»')

_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000) if not 0xD800 <= i < 0xE000] , np.uint32)
_LOWER = np.concatenate([_LOWER[:0xD800], np.arange(0xD800, 0xE000, dtype=np.uint32), _LOWER[0xD800:]])
_ALNUM = np.array([chr(i).isalnum() for i in range(0x10000)])


def edits(term: str) -> int:
    """Edits within which a word counts as a misspelling of term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of the terms intersected with their trie, determinised on demand.

    terms: (text, is a beginning, edits allowed). State 0 is dead, 1 the start. accept[state] is (term number, edits) or None.
    A state is the nodes that may have been reached, with their edits, and the best beginning (edits, term) so far. ~node
    stands for a node that is reached if the next letter is the one before it, as in a swap.
    """

    def __init__(self, terms: Iterable[tuple[str, bool, int]]) -> None:
        self.terms = list(terms)
        self.children: list[dict[int, int]] = [{}]
        self.before = [-1]  # the letter before a node's own
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]
        for number, (term, _, most) in enumerate(self.terms):
            node, last = 0, -1
            self.most[0] = max(self.most[0], most)
            for c in map(ord, term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.before.append(last)
                    self.ends.append([])
                    self.most.append(0)
                node, last = self.children[node][c], c
                self.most[node] = max(self.most[node], most)
            self.ends[node].append(number)
        symbols = sorted({ord(c) for t, *_ in self.terms for c in t})
        self.symbol = np.zeros(0x10000, np.int32)
        for k, c in enumerate(symbols):
            if c < 0x10000:
                self.symbol[c] = k + 1
        self.chars = [-1, *symbols]
        self.number: dict = {(frozenset(), None): 0}
        self.sets: list = [(frozenset(), None)]
        self.accept: list = [None]
        self.table = np.zeros((64, len(self.chars)), np.int32) - 1
        self.table[0] = 0
        self._state(self._closed({0: 0}), None)

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        """With the characters that the word may lack."""
        todo = [node for node in states if node >= 0]
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = states[node] + 1
                if e <= self.most[child] and e < states.get(child, 99):
                    states[child] = e
                    todo.append(child)
        return states

    def _step(self, state: int, symbol: int) -> int:
        kept, begun = self.sets[state]
        char, out = self.chars[symbol], {}
        for node, e in kept:
            if node < 0:
                if char == self.before[~node] and e < out.get(~node, 99):
                    out[~node] = e
                continue
            for c, child in self.children[node].items():
                cost = e + (c != char)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
                swapped = self.children[child].get(char) if c != char else None
                if swapped is not None and e < self.most[swapped] and e + 1 < out.get(~swapped, 99):
                    out[~swapped] = e + 1
            if e < self.most[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
        return self._state(self._closed(out), begun)

    def _state(self, out: dict[int, int], begun: tuple[int, int] | None) -> int:
        met = [(e, t) for node, e in out.items() if node >= 0 for t in self.ends[node] if e <= self.terms[t][2]]
        begun = min([m for m in met if self.terms[m[1]][1]] + [begun] * (begun is not None), default=None)
        if begun is not None:  # what can't be better any more is left out
            out = {node: e for node, e in out.items() if e <= begun[0]}
        key = frozenset(out.items()), begun
        if key not in self.number:
            best = min([m for m in met if not self.terms[m[1]][1]] + [begun] * (begun is not None), default=None)
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.accept.append(best and (best[1], best[0]))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table) - 1])
        return self.number[key]

    def run(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
        """(word, term, edits) of each matching word; codes: lower-cased code points."""
        symbols = np.where(codes < 0x10000, self.symbol[np.minimum(codes, 0xFFFF)], 0)
        live, state, at, hits = np.arange(len(start)), np.ones(len(start), np.int64), start.copy(), []
        while len(live):
            symbol = symbols[at]
            after = self.table[state, symbol]
            if (after < 0).any():
                width = len(self.chars)
                for pair in np.unique(state[after < 0] * width + symbol[after < 0]).tolist():
                    to = self._step(pair // width, pair % width)
                    self.table[pair // width, pair % width] = to
                after = self.table[state, symbol]
            at = at + 1
            over = (at >= end[live]) & (after > 0)
            for w, s in zip(live[over].tolist(), after[over].tolist()):
                if self.accept[s]:
                    hits.append((w, *self.accept[s]))
            on = (after > 0) & ~over
            live, state, at = live[on], after[on].astype(np.int64), at[on]
        return sorted(hits)


class Model:
    """A lexicon with weights, words that look like misspellings but aren't, and the scoring of documents."""

    def __init__(self, terms: Iterable[tuple], not_these: Iterable[str] = ()) -> None:
        """terms: (text, is a beginning, weight, least occurrences) and, unless as edits() says, the edits allowed."""
        self.terms = sorted((*t[:4], t[4] if len(t) > 4 else edits(t[0])) for t in terms)
        self.not_these = frozenset(not_these)

    def key(self) -> tuple:
        return tuple(self.terms), self.not_these

    def hits(self, column: pa.Array, automaton: Automaton) -> Iterable[tuple]:
        """(row, its text, where it begins, its first and last word, all words' starts and ends, hits, words by number) of rows with hits, before any are left out."""
        for first, part in chunks(column, CHUNK_BYTES):
            texts = [t or "" for t in part.to_pylist()]
            codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
            if not len(codes):
                continue
            bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
            low = np.minimum(codes, 0xFFFF)
            word = np.where(codes < 0x10000, _ALNUM[low], True)
            codes = np.where(codes < 0x10000, _LOWER[low], codes)
            edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            rows: dict[int, list] = {}
            hits = automaton.run(codes, start, end)
            owner = np.searchsorted(bounds, start[[w for w, _, _ in hits]], "right") - 1 if hits else ()
            for (w, term, e), row in zip(hits, owner):
                rows.setdefault(int(row), []).append((w, term, e))
            say = lambda w: codes[start[w] : end[w]].tobytes().decode("utf-32-le")  # noqa: B023, E731
            for row, found in rows.items():
                a, b = np.searchsorted(start, bounds[row : row + 2])
                yield first + row, texts[row], int(bounds[row]), int(a), int(b), start, end, found, say

    def scores(self, column: pa.Array, automaton: Automaton) -> list[tuple[int, float, int, int, list[str]]]:
        """(row, score, hits, quoted hits, words) of rows with hits."""
        out = []
        for row, text, begin, a, b, start, end, found, say in self.hits(column, automaton):
            if left := [h for h in found if h[2] == 0 or say(h[0]) not in self.not_these]:
                out.append((row, *self._document(text, begin, a, b, start, end, left, say)))
        return out

    def _document(self, text, begin, a, b, start, end, found, say) -> tuple[float, int, int, list[str]]:
        marks = [i for i, c in enumerate(text) if c in MARKS] if not MARKS.isdisjoint(text) else []
        quoted = []
        for w, _, _ in found:
            i, j = int(start[w]) - begin, int(end[w]) - begin
            k = bisect.bisect_left(marks, i)
            inside = k % 2 == 1 and k < len(marks)  # an opened mark that closes
            inside = inside and j <= marks[k] and np.searchsorted(start, begin + marks[k]) - np.searchsorted(start, begin + marks[k - 1]) <= QUOTE_WORDS
            quoted.append(bool(inside))
        score, often = 0.0, Counter(t for (_, t, _), q in zip(found, quoted) if not q)
        for (w, term, e), q in zip(found, quoted):
            if self.terms[term][3] > max(often[term], 1):
                continue
            near = [say(x) for x in range(max(a, w - WINDOW), min(b, w + WINDOW + 1)) if x != w]
            others = sum(1 for (x, _, _), y in zip(found, quoted) if x != w and abs(x - w) <= WINDOW and not y)
            s = self.terms[term][2] * (1.0, 0.8, 0.7)[e] * (1 + 0.15 * min(others, 4))
            if q:
                s *= 0.35
            if not REPORTING.isdisjoint(near):
                s *= 0.7
            if not q and not SECOND.isdisjoint(near):
                s *= 1.3
            score = max(score, s)
        return min(1.0, score), len(found), sum(quoted), sorted({say(w) for w, _, _ in found})


_KEPT: dict = {}


def _automaton(model: Model) -> Automaton:
    """One a worker and lexicon."""
    if model.key() not in _KEPT:
        _KEPT.clear()
        _KEPT[model.key()] = Automaton((t, b, e) for t, b, _, _, e in model.terms)
    return _KEPT[model.key()]


def _features(batches):
    """Documents, toxic and not, that hold each word (ends with $) or beginning of 3 to 9 letters, at all and PILE times (ends with #)."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = Counter("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
            here = Counter()
            for w, n in words.items():
                if len(w) > 2:
                    for k in range(3, min(len(w), 9) + 1):
                        here[w[:k]] += n
                    here[w + "$"] += n
            counts[bool(toxic)].update([*here, *(f + "#" for f, n in here.items() if n >= PILE)])
    keys = [k for k in counts[1]] + [k for k in counts[0] if k not in counts[1]]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["feature", "a", "b"])


def tail(a: int, n: int, p: float) -> float:
    """The probability of a or more of n at chance p."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(a, n + 1))


def choose(counts: dict[str, tuple[int, int]], share: float, purity: float = PURITY, support: int = SUPPORT, keep: float = KEEP, chance: float = CHANCE) -> list[tuple[str, bool, float, int]]:
    """(text, is a beginning, weight, least occurrences) from feature counts.

    A term is a beginning or word that is pure and by its number of toxic documents no accident, given their share of all; each is made longer while a longer one keeps nearly all its documents.
    """
    level, terms = chance / max(1, len(counts)), []
    good: dict[str, bool] = {}

    def pure(f: str) -> bool:
        if f not in good:
            a, b = counts.get(f, (0, 0))
            good[f] = a >= support and a / (a + b) >= purity and tail(a, a + b, share) < level
        return good[f]

    for pile in ("", "#"):
        longer: dict[str, list[str]] = {}
        for f in counts:
            if f.endswith("#") == bool(pile):
                longer.setdefault(f.rstrip("#")[:-1], []).append(f.rstrip("#"))
        todo = [f for head in longer if len(head) == 2 for f in longer[head]]
        while todo:
            f = todo.pop()
            if pile and len(f.rstrip("$")) < 4:
                todo += [g for g in longer.get(f, ()) if counts[g + pile][0] >= support]
                continue
            if any(f.startswith(t) if b else f.rstrip("$") == t for t, b, _, _ in terms):
                continue
            if not pure(f + pile):
                todo += [g for g in longer.get(f, ()) if counts[g + pile][0] >= support]
                continue
            while next_ := max((g for g in longer.get(f, ()) if counts[g + pile][0] >= keep * counts[f + pile][0] and pure(g + pile)), key=lambda g: (counts[g + pile][0], g), default=None):
                f = next_
            a, b = counts[f + pile]
            if not any(t == f.rstrip("$") for t, *_ in terms):
                terms.append((f.rstrip("$"), not f.endswith("$"), a / (a + b + 1), PILE if pile else 1))
    return terms


def with_seed(terms: list[tuple[str, bool, float, int]], seed: Iterable[str]) -> list[tuple[str, bool, float, int]]:
    """terms and every seed as a whole word that counts at once, whatever was learned of it: a learned beginning has no edits."""
    seed = list(dict.fromkeys(seed))
    return [x for x in terms if x[1] or x[0] not in seed] + [(s, False, 1.0, 1) for s in seed]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", seed: Iterable[str] = SEED) -> Model:
    """A model from at most max_labelled labelled rows, whose ids have the least hashes. Rows without a label or an id don't count.

    A learned term that is met with edits in a clean labelled document is matched exactly from then on; as its words may then be near another term, this is done until no term is left to change.
    """
    seed = list(dict.fromkeys(seed))
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")))
    sums = known.mapInArrow(tidy_batches(_features), "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= SUPPORT)
    share = known.agg(F.avg("toxic")).head()[0] or 0.0
    terms = choose({r["feature"]: (r["a"], r["b"]) for r in sums.toLocalIterator()}, min(max(share, 1e-6), 1 - 1e-6))
    model, given = Model(with_seed(terms, seed)), set(seed)
    while True:
        near = known.mapInArrow(_near(model), "w string, t int, a long, b long").groupBy("w", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("b > 0").collect()
        strict = {r["t"] for r in near if r["w"] is None and model.terms[r["t"]][0] not in given}
        if not strict:
            return Model(model.terms, [r["w"] for r in near if r["w"] is not None and r["b"] >= r["a"]])
        model = Model((*t[:4], 0 if k in strict else t[4]) for k, t in enumerate(model.terms))


def _near(model: Model):
    """Documents, toxic and not, that hold a word with edits (w) of a term (t), and one of the term's words (w null)."""

    def run(batches):
        automaton = _automaton(model)
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for row, *_, hits, say in model.hits(batch.column("text"), automaton):
                found[toxic[row]].update({(say(w), t) for w, t, e in hits if e} | {(None, t) for _, t, e in hits if e})
        keys = sorted({*found[0], *found[1]}, key=str)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], ["w", "t", "a", "b"])

    return run


def _score(model: Model):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score, hits, quoted, terms = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32), [[] for _ in range(n)]
            for row, s, h, q, words in model.scores(batch.column("text"), _automaton(model)):
                score[row], hits[row], quoted[row], terms[row] = s, h, q, words
            at = pa.array(np.flatnonzero(hits > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *(pa.array(x).take(at) for x in (score, hits, quoted)), pa.array(terms, pa.list_(pa.string())).take(at)], ["doc_id", "score", "hits", "quoted", "terms"])

    return run


def toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits, quoted, terms) of the documents whose score reaches threshold."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy_batches(_score(model)), "doc_id long, score double, hits int, quoted int, terms array<string>").where(F.col("score") >= threshold)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, less the rows whose score reaches threshold. Columns and other rows stay as they are."""
    columns, name = docs.columns, fresh(docs, "toxic_score")

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                out = np.zeros(len(texts))
                for row, s, *_ in model.scores(texts, _automaton(model)):
                    out[row] = s
                yield pa.array(out)
        finally:
            give_back()

    return docs.withColumn(name, scored(F.col(text_col).cast("string"))).where(F.col(name) < threshold).select(*columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, by a lexicon learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxic(docs, fit(docs, table(spark, sf_dir, "labels")))
