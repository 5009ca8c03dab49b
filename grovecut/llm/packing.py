"""Packing documents into windows of a fixed number of tokens with bounded space.

Documents are dealt to groups by a hash of id and text, GROUP_DOCS to a group, and taken in the order of that hash; so the
result doesn't depend on how the table is partitioned. Each group keeps OPEN_WINDOWS windows open. A document goes into the
open window that it fills best (the least room left over, then the oldest); where it fits none, the fullest window is
emitted and a new one opened. A document longer than a window is cut: its whole windows are emitted full at once, its rest
is packed like a document. What is open at a group's end is a leftover: the leftovers of all groups are merged, the fullest
first, in groups of about MERGE_WINDOWS windows, whole leftovers into what they fill best.

One row a piece: every token of every document is in exactly one row. A text without words gives one piece of length
0. Null texts are like empty ones; a null id stays null. Repeated rows are packed each. Very long texts are cut, none is
shortened. Ties between rows of equal id and text don't matter. An empty table gives an empty result. Other columns may
have any names. Window ids are unique.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy_keyed
from .text import words_of

WINDOW_TOKENS, OPEN_WINDOWS = 2048, 64
#: Documents of a group, and windows left over that are merged together by one task, about.
GROUP_DOCS, MERGE_WINDOWS = 20_000, 4096

SCHEMA = "window_id string, doc_id long, piece int, start long, length long, offset long"


class Packer:
    """Bounded-space best fit: at most `most` windows are open."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (room, number), sorted
        self.items: dict[int, list] = {}
        self.number = 0

    def add(self, item: tuple, length: int) -> tuple[int, list] | None:
        """Places an item; (number, items) of the window that had to be emitted for it, or None."""
        at = bisect.bisect_left(self.open, (length, -1))
        out = None
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                _, full = self.open.pop(0)
                out = full, self.items.pop(full)
            room, number = self.capacity, self.number
            self.number += 1
            self.items[number] = []
        self.items[number].append(item)
        if room > length:
            bisect.insort(self.open, (room - length, number))
        elif out is None:
            out = number, self.items.pop(number)
        else:
            self.full = getattr(self, "full", [])
            self.full.append((number, self.items.pop(number)))
        return out

    def done(self) -> list[tuple[int, list]]:
        """Full windows that were held back."""
        out, self.full = getattr(self, "full", []), []
        return out

    def rest(self) -> list[tuple[int, list]]:
        """The windows still open, fullest first."""
        return [(n, self.items[n]) for _, n in self.open]


def _rows(rows: list[tuple], open_: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([open_] * len(rows), pa.bool_())], ["window_id", "doc_id", "piece", "start", "length", "offset", "left"])


def _window(prefix: str, number: int, items: list) -> list[tuple]:
    out, offset = [], 0
    for doc, piece, start, length in items:
        out.append((f"{prefix}-{number}", doc, piece, start, length, offset))
        offset += length
    return out


def _pack(capacity: int, most: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
        prefix, packer, long, out = f"g{key[0].as_py()}", Packer(capacity, most), 0, []
        for doc, length in zip(group["doc_id"].to_pylist(), group["tokens"].to_pylist()):
            whole, rest = divmod(length, capacity)
            for piece in range(whole):
                out.append((f"{prefix}w{long}", doc, piece, piece * capacity, capacity, 0))
                long += 1
            if rest or not whole:
                if (full := packer.add((doc, whole, whole * capacity, rest), rest)) is not None:
                    out += _window(prefix, *full)
                for full in packer.done():
                    out += _window(prefix, *full)
        left = [r for number, items in packer.rest() for r in _window(prefix, number, items)]
        return pa.Table.from_batches([_rows(out, False), _rows(left, True)])

    return run


def _merge(capacity: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("window_id", "ascending"), ("offset", "ascending")])
        rows = list(zip(*(group[c].to_pylist() for c in ("window_id", "doc_id", "piece", "start", "length"))))
        by: dict[str, list] = {}
        for window, *item in rows:
            by.setdefault(window, []).append(tuple(item))
        sizes = sorted(((sum(i[3] for i in items), w) for w, items in by.items()), key=lambda x: (-x[0], x[1]))
        packer, prefix, out = Packer(capacity, len(sizes) + 1), f"m{key[0].as_py()}", []
        for size, window in sizes:
            if (full := packer.add(window, size)) is not None:
                out.append(full)
            out += packer.done()
        out += packer.rest()
        flat = [r for number, windows in out for r in _window(prefix, number, [i for w in windows for i in by[w]])]
        return pa.Table.from_batches([_rows(flat, False).select(range(6))])

    return run


def pack(docs: DataFrame, capacity: int = WINDOW_TOKENS, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text", merge_windows: int = MERGE_WINDOWS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(window_id, doc_id, piece, start, length, offset): the document's tokens start .. start+length lie at offset of the window."""
    text = F.col(text_col).cast("string")
    lengths = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(text).alias("tokens"), F.xxhash64(F.col(id_col).cast("long"), text).alias("h")))
    groups = max(1, -(-lengths.count() // group_docs))
    grouped = lengths.groupBy(F.pmod("h", F.lit(groups)).cast("int").alias("g"))
    placed = cut(grouped.applyInArrow(tidy_keyed(_pack(capacity, open_windows)), SCHEMA + ", left boolean"))
    left = placed.where("left").drop("left")
    merges = max(1, -(-left.agg(F.count_distinct("window_id")).head()[0] // merge_windows))
    merged = left.groupBy(F.pmod(F.xxhash64("window_id"), F.lit(merges)).alias("g")).applyInArrow(tidy_keyed(_merge(capacity)), SCHEMA)
    return placed.where("not left").drop("left").unionByName(merged)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
