"""Near duplicates: a Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

A set's grams are put in one order for all documents, frequent ones last (by a count sketch of all documents'
grams, whose size is fixed; it steers cost, not results). Two sets with Jaccard of at least t share at least l grams
within their first |x| - ceil(t|x|) + l. Each document takes the l that costs least by estimate: a longer prefix puts
it into more lists, but a pair must then share more before it is verified. A pair uses the smaller l of its two,
and the more its sizes ask for: with o shared grams needed, o - max(ceil(t|x|), ceil(t|y|)) + l of them are in the prefixes.

Prefix grams go to owners by gram, as compressed arrays (32 bits of a gram; grams of one document that are alike in these
are kept apart by their number, so a chance match can only add to a pair's count and so only add a candidate).
An owner sends each list of documents with a gram on to where the lists of the same least document go, so that what
pairs of a large group share is counted in few places; the counts are summed and pairs that share enough become
candidates. Candidates' whole sets are then brought together, once for
each group of documents that candidates connect, and compared exactly. There is no cap on lists or partners.

The pairs of a cluster, a large group of near copies, are never rows. Clusters are found before, from pairs of least hashes that many
different sets share; all pairs within a cluster are compared in squares of its sets, by products of incidence matrices, and
a square returns each set's sum of partners and a star for those it connects. Pairs within a cluster are left out of
the lists. What is taken for a cluster steers cost, not results; all other pairs take the way above.
Which documents have candidates is told to the scan by a Bloom filter of fixed size; what it lets through in vain the
join by name drops.

Sets are named by a 64-bit hash, so equal sets are one everywhere, whatever the number of copies. A text of fewer
words than n has one gram, all its words; texts without words, and null ones, have no grams and no partners. A very long
text is one set like any other. Repeated rows and ids are kept as they are; ids may be null. Ties don't matter: a pair
counts from Jaccard = threshold on. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import BROADCAST_ROWS, cut, fresh, small, table, tidy_batches, tidy_group, tidy_stream
from .components import components, stars
from .text import chunks, grams, mix, words

NGRAM, JACCARD, MOST_MATCHES = 3, 0.5, 16
#: Cells of the count sketch, 16 MB of counts whatever the corpus.
SKETCH_BITS = 22
#: Prefix grams that one owner gets, about, sets on a side of a block of pairs, and sets that one verifying task gets, about.
OWNER_GRAMS, BLOCK_SETS, TASK_SETS = 2_000_000, 1024, 1024
#: Different sets from which on a group that shares least hashes is a cluster, sets and grams on a side of its squares, sets of all clusters (the largest first; the rest go the other way).
CLUSTER_SETS, SQUARE_SETS, SQUARE_GRAMS, MOST_CLUSTERED = 64, 2048, 1_000_000, 1_000_000
#: Bins of a set's grams, each with its least hash; two bins side by side are a band.
BINS = 16
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 1_000_000


def sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, sorted distinct grams of the rows, row after row) for pieces of a text column."""
    for first, part in chunks(column):
        _, _, bounds, hashed = words(part)
        g, gb = grams(hashed, bounds, n)
        short = np.flatnonzero((np.diff(bounds) < n) & (np.diff(bounds) > 0))
        row = np.repeat(np.arange(len(part)), np.diff(gb))
        if len(short):
            extra = [mix(np.add.reduce(mix(hashed[bounds[i] : bounds[i + 1]] + np.arange(1, bounds[i + 1] - bounds[i] + 1).astype(np.uint64))).reshape(1))[0] for i in short]
            g, row = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([row, short])
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        yield first, np.searchsorted(row, np.arange(len(part) + 1)), g


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def names(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64."""
    return mix(_sums(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def bands(g: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """For each set a hash of the least hashes of two bins side by side, where both have grams; near copies share most."""
    h = mix(g ^ np.uint64(0x5DEECE66D5DEECE6))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least = np.full((len(bounds) - 1) * BINS, ~np.uint64(0))
    np.minimum.at(least, row * BINS + (h >> np.uint64(60)).astype(np.int64), h)
    least = least.reshape(-1, BINS // 2, 2)
    whole = (least != ~np.uint64(0)).all(2)
    key = mix(least[:, :, 0] + mix(least[:, :, 1]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole.sum(1))]).astype(np.int32)), pa.array(key[whole].view(np.int64)))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in 16 bits each if all fit, else in 32."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def unpacked(blobs: list[bytes], counts: list[int]) -> np.ndarray:
    """The numbers of packed() blobs of so many numbers each, one blob after the other."""
    return np.concatenate([np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32).astype(np.int64) for b, n in zip(blobs, counts)])


def _scan(n: int):
    """(name, size, id, bands) of each document's set, and this task's sketch (as rows with a slice)."""

    def run(batches):
        counts, cells, held = np.zeros(1 << SKETCH_BITS, np.int32), [], 0
        for batch in batches:
            ids = batch.column("id")
            for first, bounds, g in sets(batch.column("text"), n):
                cells.append((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(g)
                if held > 1_000_000:
                    counts += np.bincount(np.concatenate(cells), minlength=len(counts)).astype(np.int32)
                    cells, held = [], 0
                size = np.diff(bounds)
                has = np.flatnonzero(size > 0)
                m = len(has)
                yield pa.RecordBatch.from_arrays([pa.array(names(g, bounds)[has]), pa.array(size[has].astype(np.int32)), ids.slice(first, len(size)).take(pa.array(has)), bands(g, bounds).take(pa.array(has)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["name", "size", "id", "bands", "slice", "counts"])
        if cells:
            counts += np.bincount(np.concatenate(cells), minlength=len(counts)).astype(np.int32)
        if counts.any():
            for k, part in enumerate(np.split(counts, 16)):
                # bytes of equal weight lie together, which packs the small counts well
                packed = zlib.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["name", "size", "id", "bands", "slice", "counts"])

    return run


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // 16, np.int64)
    for c in group["counts"].to_pylist():
        total += np.frombuffer(zlib.decompress(c), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
    return pa.table({"slice": group["slice"][:1], "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def prefix_order(g: np.ndarray, bounds: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, frequency): the places of the grams in the common order within each set, and each gram's estimated documents beyond what a cell holds by chance."""
    seen = sketch[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    floor = sketch.mean() + 3 * np.sqrt(sketch.mean())
    extra = np.maximum(seen - floor, 0.0)
    level = np.ceil(np.log2(extra + 1)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.lexsort((mix(g), level, row)), extra


def chance_partners(sketch: np.ndarray) -> float:
    """Other documents that hold a gram, on average, frequent grams aside: what the cells vary beyond chance."""
    mean = sketch.mean()
    calm = sketch[sketch <= mean + 3 * np.sqrt(mean)]
    return float(max(0.0, calm.var() / max(calm.mean(), 1.0) - 1.0)) + 0.05 if len(calm) else 0.05


def choose_matches(size: np.ndarray, bounds: np.ndarray, extra: np.ndarray, jaccard: float, chance: float) -> np.ndarray:
    """The l of each document, by the cost of the lists its prefix joins and of the pairs left to verify.

    Partners in the lists of frequent grams share several (a part 1/l of the entries is left), chance partners of rare grams hardly ever do (a quarter is left each time). chance: those of one gram.
    """
    need = np.ceil(jaccard * size - 1e-9).astype(np.int64)
    total = np.zeros(len(extra) + 1)
    np.cumsum(extra + 1, out=total[1:])
    best, cost = np.ones(len(size), np.int64), np.full(len(size), np.inf)
    for l in range(1, MOST_MATCHES + 1):  # noqa: E741
        length = np.minimum(size, size - need + l)
        lists = total[bounds[:-1] + length] - total[bounds[:-1]]
        left = (lists - length) / l + chance * length * 0.25 ** (l - 1)
        this = np.where(l <= need, lists + chance * length + 2.0 * size * left, np.inf)
        better = this < cost
        best[better], cost[better] = l, this[better]
    return best


def _prefixes(n: int, jaccard: float, owners: int, sketch_of):
    """For each owner, from time to time, the documents' prefix grams in its range: 32 bits of each, document after document."""

    def run(batches):
        sketch = sketch_of.value
        chance = chance_partners(sketch)
        kept: list = []
        held = count = 0
        cuts = (np.arange(1, owners, dtype=np.float64) * (2.0**64 / owners)).astype(np.uint64)

        def flush():
            g, docs, names_, sizes, ls = (np.concatenate(x) for x in zip(*kept))
            owner = np.searchsorted(cuts, g, "right")
            order = np.lexsort((docs, owner))
            g, docs, owner = g[order], docs[order], owner[order]
            edges = np.searchsorted(owner, np.arange(owners + 1))
            rows = []
            for o, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                if j > i:
                    used, each = np.unique(docs[i:j], return_counts=True)
                    rows.append((o, (mix(g[i:j]) >> np.uint64(32)).astype(np.uint32).tobytes(), packed(each), names_[used].tobytes(), packed(sizes[used]), ls[used].astype(np.uint8).tobytes()))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], ["owner", "grams", "each", "name", "size", "l"])

        for batch in batches:
            for _, bounds, g in sets(batch.column("text"), n):
                size = np.diff(bounds)
                if not len(g):
                    continue
                name = names(g, bounds)
                order, extra = prefix_order(g, bounds, sketch)
                g, extra = g[order], extra[order]
                ls = choose_matches(size, bounds, extra, jaccard, chance)
                length = np.minimum(size, size - np.ceil(jaccard * size - 1e-9).astype(np.int64) + ls)
                doc = np.repeat(np.arange(len(size)), length)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                kept.append((g[bounds[doc] + rank], doc + count, name, size, ls))
                count += len(size)
                held += len(doc)
                if held > 600_000:
                    yield flush()
                    held = count = 0
        if held:
            yield flush()

    return run


def _read(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, name, size, l) from rows of grams, each, name, size, l; of equal names the first alone counts, with all its grams."""
    col = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)
    counts = [len(b) // 8 for b in group["name"].to_pylist()]
    key, name, ls = col("grams", np.uint32), col("name", np.int64), col("l", np.uint8)
    each, size = (unpacked(group[c].to_pylist(), counts) for c in ("each", "size"))
    name, at, inverse = np.unique(name, return_index=True, return_inverse=True)
    one = np.repeat(at[inverse] == np.arange(len(inverse)), each)
    return key[one], np.repeat(inverse.astype(np.int32), each)[one], name, size[at].astype(np.int64), ls[at].astype(np.int64)


def _cluster(clusters, name: np.ndarray) -> np.ndarray:
    """The number of the cluster of each name, -1 for none; clusters: a broadcast of sorted names and their numbers, or None."""
    out = np.full(len(name), -1, np.int64)
    if clusters is not None and len(clusters.value[0]):
        known, number = clusters.value
        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
        out = np.where(known[at] == name, number[at], out)
    return out


def _lists(tasks: int, clusters=None):
    """An owner's lists of documents that share a gram, sent where the lists of the same least document go; not those within one cluster."""

    def run(group: pa.Table) -> pa.Table:
        g, doc, name, size, ls = _read(group)
        code = np.sort((g.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64))
        g, doc = code >> np.uint64(32), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(g)))
        start, length = start[length > 1], length[length > 1]
        if clusters is not None and len(start):
            of = _cluster(clusters, name)[doc]
            ends = np.stack([start, start + length], 1).ravel()
            low, high = (f.reduceat(np.append(of, -1), ends)[::2] for f in (np.minimum, np.maximum))
            mixed = (low != high) | (low < 0)
            start, length = start[mixed], length[mixed]
        least = doc[start]  # names are sorted, so the first is the least
        task = (mix(name[least].view(np.uint64)) % np.uint64(tasks)).astype(np.int64)
        order = np.lexsort((start, least, task))
        start, length, task = start[order], length[order], task[order]
        edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, np.int64)
        rows = []
        for i, j in zip(edges, np.append(edges[1:], len(task))):
            inner = np.arange(length[i:j].sum()) - np.repeat(np.cumsum(length[i:j]) - length[i:j], length[i:j])
            used, local = np.unique(doc[np.repeat(start[i:j], length[i:j]) + inner], return_inverse=True)
            rows.append((int(task[i]), packed(local), packed(length[i:j]), int(j - i), name[used].tobytes(), packed(size[used]), ls[used].astype(np.uint8).tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 3))], ["task", "docs", "length", "lists", "name", "size", "l"])

    return run


#: Lists of more documents than this are counted by products of incidence matrices, label by label.
LONG_LIST = 24


def _counted(jaccard: float, clusters=None):
    """How many of the lists that came here each pair shares, for pairs whose sizes allow the threshold, not those within a cluster; a pair's count may come in parts."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, lengths, tables, base = [], [], [], 0
        for r in group.select(["docs", "length", "lists", "name", "size", "l"]).to_batches():
            for r in r.to_pylist():
                name = np.frombuffer(r["name"], np.int64)
                lengths.append(unpacked([r["length"]], [r["lists"]]))
                docs.append(unpacked([r["docs"]], [int(lengths[-1].sum())]).astype(np.int32) + np.int32(base))
                tables.append((name, unpacked([r["size"]], [len(name)]), np.frombuffer(r["l"], np.uint8).astype(np.int64)))
                base += len(name)
        if not tables:
            return
        name, size, ls = (np.concatenate(x) for x in zip(*tables))
        name, at, inverse = np.unique(name, return_index=True, return_inverse=True)
        size, ls, cluster = size[at], ls[at], _cluster(clusters, name)
        need = np.ceil(jaccard * size - 1e-9).astype(np.int64)
        doc, length = inverse[np.concatenate(docs)], np.concatenate(lengths)
        docs.clear()
        start = np.cumsum(length) - length
        keys, counts = [], []
        held = 0

        def merge():
            nonlocal held
            if keys:
                u, inv = np.unique(np.concatenate(keys), return_inverse=True)
                c = np.bincount(inv, np.concatenate(counts), len(u)).astype(np.int32)
                keys[:], counts[:], held = [u], [c], len(u)

        def parts():
            if not keys:
                return
            for i in range(0, len(keys[0]), 100_000):
                k, c = keys[0][i : i + 100_000], counts[0][i : i + 100_000]
                a, b = k // len(name), k % len(name)
                l = np.minimum(ls[a], ls[b])  # noqa: E741
                # What isn't within both prefixes lies behind the prefix of one of the two: that leaves need - l grams at most.
                least = np.ceil(jaccard / (1 + jaccard) * (size[a] + size[b]) - 1e-9).astype(np.int64) - np.maximum(need[a], need[b]) + l
                yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b]), pa.array(c), pa.array(np.maximum(l, least).astype(np.int32))], ["a", "b", "n", "l"])
            keys.clear()
            counts.clear()

        def add(a: np.ndarray, b: np.ndarray, c: np.ndarray):
            nonlocal held
            fine = (a != b) & (np.minimum(size[a], size[b]) >= jaccard * np.maximum(size[a], size[b]) - 1e-9) & ((cluster[a] < 0) | (cluster[a] != cluster[b]))
            a, b = a[fine], b[fine]
            keys.append(np.minimum(a, b) * len(name) + np.maximum(a, b))
            counts.append(c[fine])
            held += len(a)
            if held > HELD_PAIRS:
                merge()
                if held > HELD_PAIRS // 2:
                    yield from parts()
                    held = 0

        for m in np.unique(length[length <= LONG_LIST]).tolist():
            lists = start[length == m]
            x, y = np.triu_indices(m, 1)
            step = max(1, 250_000 // len(x))
            for i in range(0, len(lists), step):
                here = lists[i : i + step, None]
                p, q = doc[(here + x).ravel()], doc[(here + y).ravel()]
                yield from add(p, q, np.ones(len(p), np.int32))
        long = np.flatnonzero(length > LONG_LIST)
        label = np.minimum.reduceat(doc, start)[long] if len(long) else long
        order = np.argsort(label, kind="stable")
        for part in np.split(long[order], np.flatnonzero(np.diff(label[order])) + 1):
            if not len(part):
                continue
            entries = np.concatenate([doc[start[k] : start[k] + length[k]] for k in part])
            who, column = np.unique(entries, return_inverse=True)
            by = np.argsort(cluster[who], kind="stable")  # those of a cluster side by side: squares of its pairs alone are left out
            place = np.empty(len(who), np.int64)
            place[by] = np.arange(len(who))
            who, column, row = who[by], place[column], np.repeat(np.arange(len(part)), length[part])

            def shares(i: int, k: int):
                out = np.zeros((min(1024, len(who) - i), min(1024, len(part) - k)), np.float32)
                of = (column >= i) & (column < i + 1024) & (row >= k) & (row < k + 1024)
                np.add.at(out, (column[of] - i, row[of] - k), 1)
                return out

            for i in range(0, len(who), 1024):
                for j in range(i, len(who), 1024):
                    first, last = cluster[who[i]], cluster[who[min(j + 1024, len(who)) - 1]]
                    if first == last >= 0:
                        continue
                    shared = sum(shares(i, k) @ shares(j, k).T for k in range(0, len(part), 1024))
                    a, b = np.nonzero(shared)
                    up = a + i < b + j
                    a, b = a[up], b[up]
                    yield from add(who[a + i], who[b + j], shared[a, b].astype(np.int32))
        merge()
        yield from parts()

    return run


def _pairs(jaccard: float, clusters=None):
    """_counted as a function of tables."""
    counted = _counted(jaccard, clusters)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("l", pa.int32())])
    return lambda group: pa.Table.from_batches(counted(group), kind)


def _chosen(n: int, wanted):
    """(name, grams) of the documents whose set the filter lets through, each set once a task."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for _, bounds, g in sets(batch.column("text"), n):
                name, size = names(g, bounds), np.diff(bounds)
                take = size > 0
                take[take] = bloom.passes(wanted.value, name[take])
                rows = []
                for i in np.flatnonzero(take).tolist():
                    if (x := int(name[i])) not in done:
                        done.add(x)
                        rows.append((x, (g[bounds[i] : bounds[i + 1]]).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["name", "grams"])

    return run


def shared_grams(g: np.ndarray, bounds: np.ndarray, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many grams each set of one side shares with each of the other (grams set after set, and their bounds), as float32."""
    out = np.zeros((len(bounds) - 1, len(ends) - 1), np.float32)
    known, column = np.unique(g, return_inverse=True)
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    both = known[at] == h if len(known) else np.zeros(len(h), bool)
    column2, row2 = at[both], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[both]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n, n2 = np.bincount(column, minlength=len(known)), np.bincount(column2, minlength=len(known))
    heavy = n * n2 > 1 << 14
    # Grams of few sets: all their pairs, one after the other.
    order = np.argsort(column2, kind="stable")
    row2_by, first = row2[order], np.cumsum(n2) - n2
    light = ~heavy[column] & (n2[column] > 0)
    x, c = row[light], column[light]
    edges = np.cumsum(n2[c])
    flat, i = out.reshape(-1), 0
    while i < len(c):
        j = max(i + 1, int(np.searchsorted(edges, (edges[i - 1] if i else 0) + 500_000, "right")))
        each = n2[c[i:j]]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(flat, np.repeat(x[i:j], each) * out.shape[1] + row2_by[np.repeat(first[c[i:j]], each) + inner], np.float32(1))
        i = j
    # Grams of many: products of incidence matrices.
    number = np.cumsum(heavy) - 1
    of, of2 = heavy[column], heavy[column2]
    row, column, row2, column2 = row[of], number[column[of]], row2[of2], number[column2[of2]]
    for k in range(0, int(heavy.sum()), 512):
        left, right = np.zeros((out.shape[0], 512), np.float32), np.zeros((out.shape[1], 512), np.float32)
        here, here2 = (column >= k) & (column < k + 512), (column2 >= k) & (column2 < k + 512)
        left[row[here], column[here] - k] = 1
        right[row2[here2], column2[here2] - k] = 1
        for i in range(0, len(left), 512):
            out[i : i + 512] += left[i : i + 512] @ right.T
    return out


def _side(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, copies, grams, bounds) of the sets of one side of a square, each once."""
    name, at = np.unique(held["a"].to_numpy(), return_index=True)
    held = held.take(pa.array(at))
    blobs = held["grams"].to_pylist()
    return name, held["copies"].to_numpy().astype(np.float64), np.frombuffer(b"".join(blobs), np.uint64), np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])]).astype(np.int64)


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("others", pa.int64())])


def _square(jaccard: float, group: pa.Table) -> pa.Table:
    """All pairs of a square of a cluster: for each set in one the least it connects with and the documents of its partners here."""
    x, y = group["x"][0].as_py(), group["y"][0].as_py()
    side = group["side"].to_numpy()
    name, copies, g, bounds = _side(group.filter(pa.array(side == x)))
    name2, copies2, h, ends = (name, copies, g, bounds) if x == y else _side(group.filter(pa.array(side == y)))
    shared = shared_grams(g, bounds, h, ends)
    size, size2 = np.diff(bounds), np.diff(ends)
    others, others2 = np.zeros(len(name)), np.zeros(len(name2))
    u = v = np.zeros(0, np.int64)
    for i in range(0, len(name), 256):
        same = shared[i : i + 256].astype(np.float64)
        alike = same / (size[i : i + 256, None] + size2 - same) >= jaccard - 1e-12
        if x == y:
            rows = np.arange(len(alike))
            alike[rows, rows + i] = False
        others[i : i + 256] = alike @ copies2
        others2 += copies[i : i + 256] @ alike
        a, b = np.nonzero(alike)
        u, v = stars(np.concatenate([u, name[a + i]]), np.concatenate([v, name2[b]]))
    if x != y:
        name, others = np.concatenate([name, name2]), np.concatenate([others, others2])
    root = name.copy()
    if len(u):
        order = np.argsort(u)
        at = np.minimum(np.searchsorted(u[order], name), len(u) - 1)
        root = np.where(u[order][at] == name, v[order][at], name)
    some = others > 0
    return pa.table([pa.array(c[some].astype(np.int64)) for c in (name, root, others)], schema=FOUND)


def _verify(jaccard: float):
    """Exact Jaccard of all pairs of a cluster's square, or of the pairs of a block, from the sets sent to it."""

    def run(group: pa.Table) -> pa.Table:
        if group["side"][0].is_valid:
            return _square(jaccard, group)
        kind = group["grams"].is_valid().to_numpy()
        held, pairs = group.filter(pa.array(kind)).select(["a", "grams"]), group.filter(pa.array(~kind)).select(["a", "b"])
        name, at = np.unique(held["a"].to_numpy(), return_index=True)
        blobs, x, y = held["grams"], pairs["a"].to_numpy(), pairs["b"].to_numpy()
        if not len(name):
            return FOUND.empty_table()
        p, q = (np.minimum(np.searchsorted(name, z), len(name) - 1) for z in (x, y))
        there = (name[p] == x) & (name[q] == y)
        p, q = p[there], q[there]
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        sets_ = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in at.tolist()]
        size = np.array([len(z) for z in sets_], np.int64)
        good = np.zeros(len(p), bool)
        edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        for i, end in zip(edges.tolist(), np.append(edges[1:], len(p)).tolist()):
            one = sets_[p[i]]
            while i < end:  # partners of about 500,000 grams at once
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[q[i:end]]), 500_000, "right")))
                g = np.concatenate([sets_[k] for k in q[i:j].tolist()])
                where = np.searchsorted(one, g)
                where[where == len(one)] = 0
                total = np.concatenate([[0], np.cumsum(one[where] == g)])
                upto = np.cumsum(size[q[i:j]])
                same = total[upto] - total[upto - size[q[i:j]]]
                good[i:j] = same / (len(one) + size[q[i:j]] - same) >= jaccard - 1e-12
                i = j
        return pa.table([pa.array(name[p[good]]), pa.array(name[q[good]]), pa.nulls(int(good.sum()), pa.int64())], schema=FOUND)

    return run


def _clusters(sets_: DataFrame, cluster_sets: int) -> tuple[DataFrame, DataFrame] | None:
    """(members, roots): (name, root) of the sets of clusters, and (root, k), the cuts of each cluster's side; None if there are none.

    A group whose bands say that few of its pairs are alike is none, for all its pairs would be compared.
    """
    banded = sets_.select("name", F.explode("bands").alias("band"))
    shared_ = cut(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("name").alias("least")).where(F.col("n") >= cluster_sets))
    if shared_.isEmpty():
        return None
    linked = cut(components(banded.join(small(shared_), "band").select(F.col("name").alias("a"), F.col("least").alias("b"))))
    close = shared_.join(linked.withColumnRenamed("node", "least"), "least").groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("close"))
    inside = linked.join(sets_.select(F.col("name").alias("node"), "size"), "node").groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    inside = cut(inside.join(close, "root").where(F.col("close") >= 0.2 * F.col("m") * F.col("m")))
    total, least = 0, None
    for r in inside.groupBy("m").agg(F.sum("m").alias("all")).orderBy(F.desc("m")).limit(100_000).toLocalIterator():
        total += r["all"]
        if total > MOST_CLUSTERED:
            break
        least = r["m"]
    if least is None:
        return None
    roots = inside.where(F.col("m") >= least).select("root", F.ceil(F.greatest(F.col("m") / SQUARE_SETS, F.col("size") / SQUARE_GRAMS)).cast("int").alias("k"))
    roots = cut(roots)
    return cut(linked.join(roots, "root").select(F.col("node").alias("name"), "root")), roots


def set_pairs(docs: DataFrame, jaccard: float = JACCARD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", owner_grams: int = OWNER_GRAMS, block_sets: int = BLOCK_SETS, broadcast_rows: int = BROADCAST_ROWS, cluster_sets: int = CLUSTER_SETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, found): (name, size, id) of each document with grams; (name, copies, least) of each distinct set, least being its least id; and (a, b, others) of names.

    Where others is null, a and b are alike, and each such pair comes once. Else a belongs to a cluster: it is connected with b (which may be a itself),
    and others is a part of the number of documents that are alike with it; the parts add up to those in its cluster.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = cut(rows.mapInArrow(tidy_batches(_scan(n)), "name long, size int, id long, bands array<long>, slice int, counts binary"))
    named = scanned.where("slice IS NULL").select("name", "size", "id")
    sets_ = cut(scanned.where("slice IS NULL").groupBy("name").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    sums = scanned.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect()
    parts = {r["slice"]: np.frombuffer(r["counts"], np.float32) for r in sums}
    sketch = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(1 << SKETCH_BITS, np.float32)
    owners = max(4, int(sketch.sum(dtype=np.float64) * (1 - jaccard) / owner_grams) + 1)
    shared = spark.sparkContext.broadcast(sketch)
    clusters, known = _clusters(sets_, cluster_sets), None
    if clusters:
        members = clusters[0].toArrow()
        order = np.argsort(members["name"].to_numpy())
        known = spark.sparkContext.broadcast((members["name"].to_numpy()[order], np.unique(members["root"].to_numpy(), return_inverse=True)[1][order]))
    texts = rows.select("text")
    sent = texts.mapInArrow(tidy_batches(_prefixes(n, jaccard, owners, shared)), "owner int, grams binary, each binary, name binary, size binary, l binary")
    lists = sent.groupBy("owner").applyInArrow(tidy_group(_lists(owners, known)), "task int, docs binary, length binary, lists int, name binary, size binary, l binary")
    counted = lists.groupBy("task").applyInArrow(tidy_stream(_counted(jaccard, known)), "a long, b long, n int, l int")
    candidates = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("l").alias("l"))
    pairs = cut(candidates.where("n >= l").select("a", "b"))
    # Sets that candidates connect are a block, to which each is sent once; a block of many sets is cut into squares.
    linked = cut(components(pairs))
    cuts = linked.groupBy("root").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("k"))
    nodes = cut(linked.join(cuts, "root").select("node", F.col("root").alias("label"), "k"))
    side = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.col("k")).cast("int")
    of_a = nodes.select(F.col("node").alias("a"), "label", "k")
    placed = pairs.join(small(of_a, broadcast_rows), "a").select("a", "b", "label", "k", F.least(side(F.col("a")), side(F.col("b"))).alias("x"), F.greatest(side(F.col("a")), side(F.col("b"))).alias("y"))
    whole_ = nodes.where("k = 1").select("label", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("node").alias("name"))
    parts = placed.where("k > 1")
    squares = parts.select("label", "x", "y", F.col("a").alias("name")).union(parts.select("label", "x", "y", F.col("b").alias("name"))).distinct()
    none = F.lit(None)
    asked = whole_.union(squares).select("label", "x", "y", "name", none.cast("int").alias("side"), none.cast("long").alias("copies"))
    if clusters:
        # A cluster's sets go to all squares of their side.
        own = clusters[0].join(clusters[1], "root").join(sets_.select("name", "copies"), "name")
        own = own.select(F.col("root").alias("label"), side(F.col("name")).alias("side"), "name", "copies", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        asked = asked.union(own.select("label", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "name", "side", "copies"))
    asked = cut(asked)
    n_asked = asked.count()
    wanted = spark.sparkContext.broadcast(bloom.build(asked))
    whole = texts.mapInArrow(tidy_batches(_chosen(n, wanted)), "name long, grams binary")
    tasks = max(4, n_asked // TASK_SETS)
    asked = F.broadcast(asked) if n_asked <= broadcast_rows // 4 else asked  # wider than the other tables
    delivered = whole.join(asked, "name").select("label", "x", "y", F.col("name").alias("a"), none.cast("long").alias("b"), "grams", "side", "copies")
    block = delivered.union(placed.select("label", "x", "y", "a", "b", none.cast("binary").alias("grams"), none.cast("int").alias("side"), none.cast("long").alias("copies")))
    # Blocks share tasks; a cluster's square is one of its own.
    alone = lambda c: F.when(F.col("side").isNotNull(), F.col(c))
    block = block.select(F.when(F.col("side").isNull(), F.pmod(F.xxhash64("label", "x", "y"), F.lit(tasks))).alias("task"), alone("label").alias("label"), alone("x").alias("x"), alone("y").alias("y"), "a", "b", "grams", "side", "copies")
    return named, sets_.select("name", "copies", "least"), block.groupBy("task", "label", "x", "y").applyInArrow(tidy_group(_verify(jaccard)), "a long, b long, others long")


def near_duplicates(docs: DataFrame, jaccard: float = JACCARD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(doc_id, class_id, links): each row that is alike with another one (equal texts included), the least id that pairs connect it with, and how many rows it is alike with.

    Rows without an id show doc_id null; class_id is null if no row of the class has one.
    """
    named, copies, found = set_pairs(docs, jaccard, n, id_col, text_col, **how)
    found = cut(found)
    pairs = found.where("others IS NULL").select("a", "b")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = both.join(copies.select(F.col("name").alias("b"), F.col("copies").alias("others")), "b").select("a", "others")
    alike = parts.union(found.where("others IS NOT NULL").select("a", "others")).groupBy("a").agg(F.sum("others").alias("others"))
    linked = components(found).select(F.col("node").alias("name"), "root")
    sets_ = copies.join(alike.withColumnRenamed("a", "name"), "name", "left").join(linked, "name", "left").where("copies > 1 OR others IS NOT NULL")
    sets_ = cut(sets_.select("name", F.coalesce("root", "name").alias("root"), "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    classes = sets_.groupBy("root").agg(F.min("least").alias("class_id"))
    marks = cut(sets_.join(classes, "root").select("name", "class_id", "links"))
    marks = F.broadcast(marks) if marks.count() <= how.get("broadcast_rows", BROADCAST_ROWS) else marks
    return named.join(marks, "name").select(F.col("id").alias("doc_id"), "class_id", "links")


def one_of_each(docs: DataFrame, jaccard: float = JACCARD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs with one row of each group of near duplicates (connected by pairs), the one with the least id.

    Rows without grams and rows without an id all stay; rows that share an id stay or go together.
    """
    named, _, found = set_pairs(docs, jaccard, n, id_col, text_col, **how)
    linked = components(cut(found.select("a", "b")))  # read more than once
    grouped = named.join(linked.select(F.col("node").alias("name"), "root"), "name", "left").select("id", F.coalesce("root", "name").alias("root"))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("keep"))
    marks = cut(grouped.join(sizes.where("n > 1"), "root").where("id IS NOT NULL").groupBy("id").agg(F.min("keep").alias("keep")))
    mark, keep = fresh(docs, "near_id"), fresh(docs, "near_keep")
    marks = marks.select(F.col("id").alias(mark), F.col("keep").alias(keep))
    marks = F.broadcast(marks) if marks.count() <= how.get("broadcast_rows", BROADCAST_ROWS) else marks
    joined = docs.join(marks, F.col(id_col).cast("long") == F.col(mark), "left")
    return joined.where(F.col(mark).isNull() | (F.col(keep) == F.col(mark))).drop(mark, keep)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that have another one whose word 3-gram set has a Jaccard of at least 0.5 with theirs, with their class and number of links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same classes and links from all grams of all documents.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS grams FROM w WHERE len(w) > 0),
s AS (SELECT len(grams) AS n, list(doc_id) AS ids, min(doc_id) AS least, grams FROM g GROUP BY grams),
t AS (SELECT least, unnest(grams) AS gram FROM s),
o AS (SELECT a.least AS a, b.least AS b, count(*) AS same FROM t a JOIN t b ON a.gram = b.gram AND a.least < b.least GROUP BY ALL),
p AS (SELECT o.a, o.b FROM o JOIN s p ON p.least = o.a JOIN s q ON q.least = o.b WHERE same / (p.n + q.n - same) >= 0.5 - 1e-12),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT least AS node, least AS other FROM s UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
l AS (SELECT e.a, sum(len(s.ids)) AS others FROM e JOIN s ON s.least = e.b GROUP BY e.a)
SELECT unnest(s.ids) AS doc_id, class_id, CAST(len(s.ids) - 1 + coalesce(others, 0) AS BIGINT) AS links
FROM s JOIN c ON c.node = s.least LEFT JOIN l ON l.a = s.least WHERE len(s.ids) > 1 OR others IS NOT NULL"""
