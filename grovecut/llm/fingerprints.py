"""Document fingerprints: prefix polynomial hashes of words.

A text's words w0 w1 ... give, for two bases B and the modulus 2**31 - 1, the prefix array S[i] = sum of w_j * B**j over j < i.
Any two spans of equal length are compared in constant time by S[e] - S[s], each multiplied by the other's power of B;
the longest common extension of two places is found by binary search over such comparisons, for many pairs at once.

The query finds what documents share, wherever it stands in them. Of every SPAN_WORDS consecutive spans of SPAN_WORDS words the
one whose fingerprint scrambles to the least number is a seed (the leftmost of equal ones); texts with fewer words have one
seed, the whole text. So two documents that share 2 * SPAN_WORDS - 1 words in a row have a seed in common. Documents with a
seed in common are a group led by the least id; every other member is laid beside the leader so that the seeds meet, and
wherever spans of SPAN_WORDS words are equal they are extended to the longest that the two share there. Only fingerprints and places are grouped; texts are sent to where they are compared,
the leaders of large groups to several portions.

Null texts, texts without words and rows without an id are in no group. Repeated rows don't match themselves: documents
are told apart by id, and each text of an id counts. Very long texts are taken whole. Of several places of a seed in one
text the first counts. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table, tidy_batches, tidy_group
from .text import chunks, mix, words

PRIME = np.uint64(2**31 - 1)
BASES = (1_103_515_249, 805_459_861)
SPAN_WORDS = 16
#: Members that one portion of a group, and about one task, holds.
PORTION, TASK_MEMBERS = 512, 2048
#: Places that are compared at once.
PLACES = 1_000_000
#: Bits of a place within a piece of input.
_PLACE = 28
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, by doubling, kept between calls."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), int(PRIME)))
        have = np.concatenate([have, have * step % PRIME])
    _POWERS[base] = have
    return have[:n]


class PrefixHashes:
    """Prefix arrays over a sequence of 64-bit word hashes."""

    def __init__(self, hashed: np.ndarray) -> None:
        self.n = len(hashed)
        halves = (hashed % PRIME, (hashed >> np.uint64(31)) % PRIME)
        self.sums = []
        for base, w in zip(BASES, halves):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(w * powers(base, self.n) % PRIME, out=s[1:])
            self.sums.append(s % PRIME)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of spans, equal for equal spans wherever they are: two 31-bit residues in one number."""
        out = np.zeros(len(start), np.uint64)
        for base, s in zip(BASES, self.sums):
            shift = powers(base, self.n + 1)[self.n - start]  # to a common power
            out = (out << np.uint64(31)) | ((s[end] + PRIME - s[start]) % PRIME * shift % PRIME)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of length from a and from b are equal, for arrays of places."""
        same = np.ones(len(a), bool)
        for base, s in zip(BASES, self.sums):
            p = powers(base, self.n + 1)
            x, y = (s[a + length] + PRIME - s[a]) % PRIME, (s[b + length] + PRIME - s[b]) % PRIME
            same &= x * p[b] % PRIME == y * p[a] % PRIME
        return same

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The longest l <= most with equal spans from a and b on, or with back, equal spans that end at a and b."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def prints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of spans that are equal for equal spans of any text: divided by the power of their place."""
        out = np.zeros(len(start), np.uint64)
        for base, s in zip(BASES, self.sums):
            inverse = powers(pow(base, -1, int(PRIME)), self.n + 1)[start]
            out = (out << np.uint64(31)) | ((s[end] + PRIME - s[start]) % PRIME * inverse % PRIME)
        return out


def winnow(prints: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Places of the least scrambled print in each run of width prints of a row, or in all prints of a shorter row."""
    if not len(prints):
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << _PLACE) - 1)
    code = (mix(prints) & ~mask) | np.arange(len(prints), dtype=np.uint64)
    best, size = code.copy(), 1
    while size < width:  # a running minimum
        step = min(size, width - size)
        best[: len(best) - step] = np.minimum(best[: len(best) - step], best[step:])
        size += step
    count = np.diff(bounds)
    runs = np.maximum(count - width + 1, 0)
    at = np.repeat(bounds[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    picked = [best[at]]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        cuts = np.stack([bounds[short], bounds[short + 1]], 1).ravel()
        picked.append(np.minimum.reduceat(np.append(code, np.uint64(2**64 - 1)), cuts)[::2])
    return np.unique(np.concatenate(picked) & mask).astype(np.int64)


def seeds(column: pa.Array, span: int):
    """(first row, row, place in it, print, words) of the seeds of pieces of a text column."""
    for first, part in chunks(column):
        _, _, bounds, hashed = words(part)
        n = np.diff(bounds)
        sums = PrefixHashes(hashed)
        count = np.maximum(n - span + 1, 0)
        spans = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(n)), count)
        start = bounds[:-1][row] + np.arange(len(row)) - spans[:-1][row]
        prints = sums.prints(start, start + span)
        at = winnow(prints, spans, span)
        short = np.flatnonzero((n > 0) & (n < span))
        whole = mix(sums.prints(bounds[:-1][short], bounds[1:][short]) ^ mix(n[short].astype(np.uint64)))
        rows = np.concatenate([row[at], short])
        places = np.concatenate([start[at] - bounds[:-1][row[at]], np.zeros(len(short), np.int64)])
        key = np.concatenate([prints[at], whole])
        # a row's seed counts where it stands first
        order = np.lexsort((places, key, rows))
        new = np.ones(len(order), bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]) | (key[order][1:] != key[order][:-1])
        keep = order[new]
        yield first, rows[keep], places[keep], key[keep]


def _seeds(span: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for first, row, place, key in seeds(batch.column("text"), span):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(first + row)), pa.array(place)], ["seed", "doc_id", "place"])

    return run


def _prints(batches):
    for batch in batches:
        for first, part in chunks(batch.column("text")):
            _, _, bounds, hashed = words(part)
            whole = PrefixHashes(hashed).prints(bounds[:-1], bounds[1:])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(part)), pa.array(whole.view(np.int64)), pa.array(np.diff(bounds))], ["doc_id", "whole", "words"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, whole, words): the fingerprint of each document, equal for equal sequences of words."""
    return _rows(docs, id_col, text_col).mapInArrow(tidy_batches(_prints), "doc_id long, whole long, words long")


def _compare(span: int):
    def run(group: pa.Table) -> pa.Table:
        is_text = group["text"].is_valid().to_numpy(zero_copy_only=False)
        held, pairs = group.filter(pa.array(is_text)), group.filter(pa.array(~is_text))
        hashes, bounds, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for _, part in chunks(held["text"]):
            _, _, b, h = words(part)
            hashes.append(h)
            bounds.append(b[1:] + at)
            at += len(h)
        sums, bounds = PrefixHashes(np.concatenate(hashes)), np.concatenate(bounds)
        where: dict[int, list[int]] = {}
        for i, x in enumerate(held["doc_id"].to_pylist()):
            where.setdefault(x, []).append(i)
        asked = [(i, j, k) for k, (x, y) in enumerate(zip(pairs["doc_id"].to_pylist(), pairs["leader_id"].to_pylist())) for i in where.get(x, ()) for j in where.get(y, ())]
        row, mate, of = np.array(asked, np.int64).reshape(-1, 3).T
        place, other = pairs["place"].to_numpy()[of], pairs["leader_place"].to_numpy()[of]
        n = np.diff(bounds)
        there = (place < n[row]) & (other < n[mate])  # of several texts of an id one may be shorter
        row, mate, of, place, other = (x[there] for x in (row, mate, of, place, other))
        early = np.minimum(place, other)
        a, b = bounds[row] + place - early, bounds[mate] + other - early  # where the two lie side by side
        both = np.minimum(n[row] - place, n[mate] - other) + early
        short = np.flatnonzero((n[row] == n[mate]) & (n[row] < span))
        short = short[sums.equal(a[short], b[short], both[short])]
        found = [np.stack([short, np.zeros(len(short), np.int64), both[short]], 1)]
        count = np.maximum(both - span + 1, 0)
        upto = np.cumsum(count)
        for part in np.split(np.arange(len(count)), np.flatnonzero(np.diff(upto // PLACES)) + 1) if len(count) else ():
            k = np.repeat(part, count[part])
            at = np.arange(len(k)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            same = sums.equal(a[k] + at, b[k] + at, np.full(len(k), span))
            first = np.flatnonzero(same & ~(np.concatenate([[False], same[:-1]]) & (at > 0)))
            k, at = k[first], at[first]
            found.append(np.stack([k, at, sums.extension(a[k] + at, b[k] + at, both[k] - at)], 1))
        k, at, length = np.concatenate(found).T
        columns = [pairs["doc_id"].to_numpy()[of[k]], pairs["leader_id"].to_numpy()[of[k]], place[k] - early[k] + at, other[k] - early[k] + at, length]
        rows = np.unique(np.stack(columns, 1), axis=0)
        return pa.table({c: rows[:, j] for j, c in enumerate(("doc_id", "leader_id", "start", "leader_start", "words"))})

    return run


def shared_spans(docs: DataFrame, span: int = SPAN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leader_id, start, leader_start, words): the longest common spans of each document with the leaders of its seeds, for each way that a seed lays the two side by side."""
    rows = _rows(docs, id_col, text_col)
    found = rows.mapInArrow(tidy_batches(_seeds(span)), "seed long, doc_id long, place long")
    groups = found.groupBy("seed").agg(F.min("doc_id").alias("leader_id"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("leader_place")).where("leader_id < last").drop("last")
    met = found.join(small(cut(groups)), "seed").where("doc_id <> leader_id")
    pairs = cut(met.groupBy("doc_id", "leader_id", (F.col("place") - F.col("leader_place")).alias("apart")).agg(F.min("place").alias("place")))
    size = pairs.groupBy("leader_id").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    tasks = max(4, pairs.count() // TASK_MEMBERS)
    portion = F.pmod(F.xxhash64("doc_id"), F.col("portions"))
    placed = cut(pairs.join(size, "leader_id").select("doc_id", "leader_id", "place", (F.col("place") - F.col("apart")).alias("leader_place"), F.pmod(F.xxhash64("leader_id", portion), F.lit(tasks)).alias("task")))
    asked = small(cut(placed.select("task", "doc_id").union(placed.select("task", "leader_id")).distinct()))
    texts = rows.withColumnRenamed("id", "doc_id").join(asked, "doc_id")
    none = F.lit(None).cast("long")
    both = texts.select("task", "doc_id", none.alias("leader_id"), none.alias("place"), none.alias("leader_place"), "text").union(placed.select("task", "doc_id", "leader_id", "place", "leader_place", F.lit(None).cast("string")))
    return both.groupBy("task").applyInArrow(tidy_group(_compare(span)), "doc_id long, leader_id long, start long, leader_start long, words long")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with documents of lesser ids, wherever it stands, in all documents."""
    return shared_spans(table(spark, sf_dir, "documents"))
