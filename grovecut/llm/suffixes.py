"""Repeated passages by a distributed suffix array over anchored suffixes.

Asked for: all runs of at least L words that occur more than once in the corpus, within a document or across them.

Anchors. Of the ANCHOR_WORDS-word runs in each window of L words the one with the least hash is the window's anchor.
Equal windows have equal anchors, so two equal windows are found if the suffixes of one anchor's windows are compared.
1. All anchors of all documents are counted by their words; only anchors that occur twice can hold a repeat. A Bloom
   filter of fixed size tells them to the scan; what it lets through in vain is sorted in vain.
2. Splitters sampled from the anchors, weighted by their counts, range-partition them by leading words. An anchor
   that is heavier than a bucket is spread over several by a hash of its place.
3. Each document sends an anchor's bucket the words that its windows span. A bucket sorts the suffixes that start there by
   multikey quicksort (three-way partition on two words at a time) down to L words, and compares neighbours.
4. Suffixes of an anchor that lies across a boundary of buckets are compared across it: buckets give the hashes of the
   windows of such anchors, and those met in two buckets are repeats too.
Neighbouring windows that repeat are joined into passages.

Only words and their order count: blanks (space, tab, CR, LF) separate words. Words are compared by 32-bit and windows
by 64-bit hashes of their bytes. Null texts and texts of fewer than L words have no passages. Repeated rows are copies of
each other; rows with the same id are numbered as one document only if their text is the same, and are then reported once.
Very long texts are taken whole. Ties don't matter: all of equal windows are reported. Rows without an id are left out. An
empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, table, tidy_batches, tidy_group
from .text import chunks, grams, mix, words

PASSAGE_WORDS, ANCHOR_WORDS = 50, 4
#: Anchored suffixes' segments that one bucket gets, about.
BUCKET_SEGMENTS = 30_000
#: Anchors from which splitters are chosen, about; those that are heavier than a bucket come on top.
SPLITTER_SAMPLE = 500_000
#: A group is split around a pivot as long as it has more suffixes than this.
SMALL_GROUP = 8192


def _keys(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading four words from each word on, as two numbers that compare as the words' 32-bit names do."""
    name = hashed >> np.uint64(32)
    padded = np.concatenate([name, np.zeros(4, np.uint64)])
    two = (padded[:-1] << np.uint64(32)) | padded[1:]
    return two[: len(name)], two[2 : len(name) + 2]


def anchors(hashed: np.ndarray, bounds: np.ndarray, length: int, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows): the word at which each anchor starts and the run of windows that it holds for."""
    none = np.zeros(0, np.int64)
    if not len(hashed) or np.diff(bounds).max(initial=0) < length:
        return none, none, none
    k0, k1 = _keys(hashed)
    order = mix(k0 ^ mix(k1 + np.uint64(0x1234567)))
    span = length - k + 1  # candidates in a window
    best, size = order.copy(), 1  # running minimum over size candidates
    while size < span:
        step = min(size, span - size)
        best[: len(best) - step] = np.minimum(best[: len(best) - step], best[step:])
        size += step
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]
    least = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(window)))
    start = window[first]
    at = np.empty(len(first), np.int64)
    for begin in range(0, len(first), 65536):
        s = start[begin : begin + 65536]
        look = order[s[:, None] + np.arange(span)[None, :]] == least[first[begin : begin + 65536], None]
        at[begin : begin + 65536] = s + look.argmax(1)
    # Where the anchor's words come again in the stretch, each window takes the leftmost it holds.
    again = np.flatnonzero(start + runs - 1 > at)
    if len(again):
        more: list[np.ndarray] = []
        for i in again.tolist():
            s, n = int(start[i]), int(runs[i])
            places = np.flatnonzero(order[s : s + n - 1 + span] == least[first[i]]) + s
            places = places[: np.searchsorted(places, s + n - 1) + 1]
            begins = np.concatenate([[s], places[:-1] + 1])
            more.append(np.stack([places, begins, np.append(begins[1:], s + n) - begins], 1))
        split = np.concatenate(more)
        one = np.setdiff1d(np.arange(len(at)), again)
        at, start, runs = (np.concatenate([x[one], split[:, k]]) for k, x in enumerate((at, start, runs)))
        order_ = np.argsort(start)
        at, start, runs = at[order_], start[order_], runs[order_]
    return at, start, runs


def _anchor_counts(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for _, part in chunks(batch.column("text")):
                _, _, bounds, hashed = words(part)
                at, _, _ = anchors(hashed, bounds, length)
                k0, k1 = _keys(hashed)
                out.append(np.stack([k0[at], k1[at]], 1) if len(at) else np.zeros((0, 2), np.uint64))
            both = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["k0", "k1"])

    return run


def name_of(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """One number for the words of an anchor."""
    return mix(k0 ^ mix(k1 + np.uint64(0x51ED270B))).view(np.int64)


def _named(batches):
    for batch in batches:
        k0, k1 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("k0", "k1"))
        yield pa.RecordBatch.from_arrays([pa.array(name_of(k0, k1))], ["name"])


class Splitters:
    """Range partition of anchors by leading words: bounds, the buckets each range has, and heavy anchors over several."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray, weight: np.ndarray, segments: int, filter_: np.ndarray) -> None:
        """weight: the occurrences that an anchor stands for. filter_: a Bloom filter of the anchors that are sent."""
        order = np.lexsort((k1, k0))
        k0, k1, weight = k0[order], k1[order], weight[order]
        total = np.cumsum(weight)
        goals = np.arange(segments, total[-1] if len(total) else 0, segments)
        at = np.unique(np.searchsorted(total, goals))
        heavy = weight > segments  # an anchor of the sample that stands for many others may be a range of its own, too
        edge = np.zeros(len(k0) + 1, bool)
        edge[at] = True
        edge[:-1] |= heavy  # a heavy anchor is a range of its own
        edge[1:] |= heavy
        edge = np.flatnonzero(edge[: len(k0)])
        edge = edge[edge > 0]
        self.s0, self.s1 = k0[edge], k1[edge]
        ranges = len(edge) + 1
        parts = np.ones(ranges, np.int64)
        which = np.searchsorted(edge, np.flatnonzero(heavy), "right")
        parts[which] = np.ceil(weight[heavy] / segments).astype(np.int64)
        self.parts, self.base = parts, np.cumsum(parts) - parts
        self.buckets = int(parts.sum())
        self.filter = filter_

    def _rank(self, k0: np.ndarray, k1: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
        """How many (s0, s1) are at most (k0, k1)."""
        low, high = np.searchsorted(s0, k0, "left"), np.searchsorted(s0, k0, "right")
        out = low.copy()
        for i in np.flatnonzero(high > low):
            out[i] = low[i] + np.searchsorted(s1[low[i] : high[i]], k1[i], "right")
        return out

    def keep(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        return bloom.passes(self.filter, name_of(k0, k1))

    def bucket(self, k0: np.ndarray, k1: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, whether the anchor lies across buckets)."""
        r = self._rank(k0, k1, self.s0, self.s1)
        return self.base[r] + (salt % self.parts[r].astype(np.uint64)).astype(np.int64), self.parts[r] > 1


def _segments(length: int, splitters_of):
    """For each bucket of each piece of input one row: its windows' words and where they are."""

    def run(batches):
        splitters, held, size = splitters_of.value, [], 0

        def flush():
            bucket = np.concatenate([h[0] for h in held])
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            docs, start, runs, across = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4))
            text = [t for h in held for t in h[5]]
            rows = []
            for part in np.split(order, edges):
                rows.append((int(bucket[part[0]]), docs[part].tobytes(), start[part].tobytes(), runs[part].astype(np.int32).tobytes(), across[part].tobytes(), b"".join(text[i] for i in part)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], ["bucket", "doc", "start", "runs", "across", "words"])

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, part in chunks(batch.column("text")):
                _, _, bounds, hashed = words(part)
                at, start, runs = anchors(hashed, bounds, length)
                if not len(at):
                    continue
                k0, k1 = _keys(hashed)
                k0, k1 = k0[at], k1[at]
                keep = splitters.keep(k0, k1)
                at, start, runs, k0, k1 = at[keep], start[keep], runs[keep], k0[keep], k1[keep]
                if not len(at):
                    continue
                row = np.searchsorted(bounds, start, "right") - 1
                doc, local = ids[first + row], start - bounds[row]
                bucket, across = splitters.bucket(k0, k1, mix(doc.view(np.uint64) ^ mix(local.view(np.uint64))))
                name = (hashed >> np.uint64(32)).astype(np.uint32)
                held.append((bucket, doc, local, runs, across, [name[s : s + n].tobytes() for s, n in zip(start.tolist(), (runs + length - 1).tolist())]))
                size += len(at)
            if size > 200_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def quicksort(text: np.ndarray, suffixes: np.ndarray, length: int, names: np.ndarray) -> np.ndarray:
    """Groups of suffixes that are equal in their first length words: sorted suffixes' group numbers come with them, as (suffix, group) rows of groups of two and more.

    Multikey quicksort, two words a step: a large group is split in three around a pivot and only its middle goes on
    deeper; groups that got small are taken together, all at the same depth at once. names are hashes of the suffixes'
    first length words: a group whose members have one name is equal to its end and needs no more steps.
    """
    padded = np.concatenate([text, np.zeros(2, np.uint32)]).astype(np.uint64)

    def key(index: np.ndarray, depth: int) -> np.ndarray:
        at = suffixes[index] + depth
        second = padded[at + 1] if depth + 1 < length else np.zeros(len(at), np.uint64)
        return (padded[at] << np.uint64(32)) | second

    done: list[np.ndarray] = []
    small: dict[int, list[np.ndarray]] = {}
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        index, depth = todo.pop()
        if len(index) < 2:
            continue
        if depth >= length or (names[index] == names[index[0]]).all():
            done.append(index)
        elif len(index) <= SMALL_GROUP:
            small.setdefault(depth, []).append(index)
        else:
            k = key(index, depth)
            sample = np.sort(k[:: max(1, len(k) // 63)])
            pivot = sample[len(sample) // 2]
            todo += [(index[k < pivot], depth), (index[k == pivot], depth + 2), (index[k > pivot], depth)]
    out_index, out_group, number = [], [], 0
    for index in done:
        out_index.append(index)
        out_group.append(np.full(len(index), number))
        number += 1
    for depth in range(0, length + 2, 2):
        groups = small.pop(depth, [])
        if not groups:
            continue
        index = np.concatenate(groups)
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        if depth < length:
            k = key(index, depth)
            order = np.lexsort((k, group))
            index, group, k = index[order], group[order], k[order]
            edge = np.concatenate([[True], (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
        else:
            edge = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(index)))
        low, high = np.minimum.reduceat(names[index], begin), np.maximum.reduceat(names[index], begin)
        equal = (size > 1) & ((low == high) | (depth >= length))
        whole = np.repeat(equal, size)
        out_index.append(index[whole])
        out_group.append(number + np.repeat(np.arange(len(size)), size)[whole])
        number += len(size)
        more = np.repeat((size > 1) & ~equal, size)
        if more.any():
            rest, which = index[more], np.repeat(np.arange(len(size)), size)[more]
            small.setdefault(depth + 2, []).extend(np.split(rest, np.flatnonzero(np.diff(which)) + 1))
    if not out_index:
        return np.zeros((0, 2), np.int64)
    return np.stack([np.concatenate(out_index), np.concatenate(out_group)], 1)


def _sort(length: int):
    """A bucket's repeats: (doc, first, last) runs of windows, and for anchors across buckets (doc, first, last, hash) of what other buckets may hold."""

    def run(group: pa.Table) -> pa.Table:
        col = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        doc, start, runs = col("doc", np.int64), col("start", np.int64), col("runs", np.int32).astype(np.int64)
        across, text = col("across", np.bool_), col("words", np.uint32)
        size = runs + length - 1
        segment = np.repeat(np.arange(len(runs)), runs)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(runs) - runs, runs)
        suffixes = (np.cumsum(size) - size)[segment] + inner
        names, _ = grams(mix(text.astype(np.uint64)), np.array([0, len(text)]), length)
        names = names[suffixes] if len(suffixes) else np.zeros(0, np.uint64)
        found = quicksort(text, suffixes, length, names)
        repeat = np.zeros(len(suffixes), bool)
        repeat[found[:, 0]] = True
        d, p = doc[segment], start[segment] + inner
        if len(found):  # the same place twice (rows with one id) isn't a repeat
            f = found[np.lexsort((p[found[:, 0]], d[found[:, 0]], found[:, 1]))]
            x, g = f[:, 0], f[:, 1]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            last = np.append(begin[1:], len(g)) - 1
            same = (d[x[begin]] == d[x[last]]) & (p[x[begin]] == p[x[last]])
            repeat[x[np.repeat(same, last - begin + 1)]] = False
        rows = []
        edge = np.flatnonzero(repeat & ~np.concatenate([[False], repeat[:-1] & (segment[1:] == segment[:-1])]))
        stop = np.flatnonzero(repeat & ~np.concatenate([repeat[1:] & (segment[1:] == segment[:-1]), [False]])) if len(repeat) else edge
        rows.append((d[edge], p[edge], p[stop] + 1, np.zeros(len(edge), np.int64), np.ones(len(edge), bool)))
        open_ = np.flatnonzero(across[segment])
        if len(open_):
            once = ~repeat[open_]
            _, first = np.unique(names[open_[~once]], return_index=True)
            pick = np.concatenate([open_[once], open_[~once][first]])
            rows.append((d[pick], p[pick], p[pick] + 1, names[pick].view(np.int64), repeat[pick]))
        d, a, b, h, r = (np.concatenate(x) for x in zip(*rows))
        kind = np.concatenate([np.zeros(len(rows[0][0]), bool), np.ones(len(d) - len(rows[0][0]), bool)])
        return pa.table({"doc_id": d, "first": a, "last": b, "hash": h, "across": kind, "known": r})

    return run


def passages(docs: DataFrame, length: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", bucket_segments: int = BUCKET_SEGMENTS, splitter_sample: int = SPLITTER_SAMPLE) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal runs of windows of `length` words each of which occurs elsewhere too.

    end_word is exclusive. Rows without an id are left out.
    """
    if length < ANCHOR_WORDS:
        raise ValueError(f"a passage must have at least {ANCHOR_WORDS} words")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = cut(rows.select("text").mapInArrow(tidy_batches(_anchor_counts(length)), "k0 long, k1 long").groupBy("k0", "k1").agg(F.count("*").alias("c")).where("c > 1"))
    n = counts.count()
    scale = max(1, n // splitter_sample)
    heavy = F.col("c") > bucket_segments
    got = counts.where(heavy | (F.pmod(F.xxhash64("k0", "k1"), F.lit(scale)) == 0)).toArrow()
    k0, k1, c = (got[x].to_numpy() for x in ("k0", "k1", "c"))
    weight = np.where(c > bucket_segments, c, c * scale)
    splitters = Splitters(k0.view(np.uint64), k1.view(np.uint64), weight, bucket_segments, bloom.build(counts.mapInArrow(_named, "name long")))
    shared = spark.sparkContext.broadcast(splitters)
    sent = rows.mapInArrow(tidy_batches(_segments(length, shared)), "bucket int, doc binary, start binary, runs binary, across binary, words binary")
    found = sent.groupBy("bucket").applyInArrow(tidy_group(_sort(length)), "doc_id long, first long, last long, hash long, across boolean, known boolean")
    if (splitters.parts > 1).any():
        found = cut(found)
        cross = found.where("across")
        met = cross.groupBy("hash").agg(F.count_distinct("doc_id", "first").alias("n")).where("n > 1").select("hash")
        more = cross.where("not known").join(met, "hash", "left_semi").select("doc_id", "first", "last")
        found = found.where("not across").select("doc_id", "first", "last").union(more)
    else:
        found = found.select("doc_id", "first", "last")
    by = Window.partitionBy("doc_id").orderBy("first", "last")
    upto = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("first") <= upto, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc_id", "island").agg(F.min("first").alias("start_word"), (F.max("last") + (length - 1)).alias("end_word"))
    return joined.select("doc_id", "start_word", "end_word")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words and more that occur more than once, in all documents."""
    return passages(table(spark, sf_dir, "documents"))


#: The same from every window of 50 words of every document.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, unnest(list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(w[i + 1 : i + 50], ' ')))) AS h
      FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS n FROM p),
r AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM h WHERE n > 1)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 50 AS BIGINT) AS end_word FROM r GROUP BY doc_id, island"""
