"""Treebanks derived from whole texts by arithmetic, the same in Spark and in SQL. They need no files of their own.

A text's words (runs of characters other than space, tab, CR and LF) are cut into sentences of 9, 28, 4, 17 and 14 words in
turn; the last one may be shorter. The word in the middle is the root; the others hang on a word between them and it.
Sentences of 17 words and more have a second root, their last word but one; of sentences of 14 words the last has no head.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import tidy_batches
from .conllu import TOKEN
from .tables import spread

LENGTHS = (9, 28, 4, 17, 14)
#: No derived tree is higher: edges from the top to the bottom.
HEIGHT = 14
#: Bits of sent_key that number the sentences of a document; a text of 2**31 bytes has fewer.
SENTENCE_BITS = 30
_BEGINS = np.cumsum([0, *LENGTHS])
_TAGS = pa.array(["NOUN", "VERB", "ADJ", "ADP", "DET"])
_LABELS = pa.array([x + sub for x in ("nsubj", "obj", "case", "amod", "root", "punct") for sub in ("", ":x")])
_XPOS, _MISC = pa.array(["X0", "X1", "X2"]), pa.array(["Gloss=g", "_"])
_VALUES = pa.array(["Acc", "Nom", "Sing", "Plur"])
_FEATS = pa.array([f"Case={c}|Number={n}" for c in ("Acc", "Nom") for n in ("Sing", "Plur")])
_FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "feats_raw", "head", "deprel_full", "misc", "space_after"]
#: Whether a byte is part of a word.
_INSIDE = ~np.isin(np.arange(256), [9, 10, 13, 32])


def _sentences(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, words) of each sentence of documents of so many words."""
    count = words // 72 * 5 + np.searchsorted(_BEGINS[:-1], words % 72, "left")
    doc = np.repeat(np.arange(len(words)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = number // 5 * 72 + _BEGINS[number % 5]
    return doc, number, np.minimum(np.array(LENGTHS)[number % 5], words[doc] - begin)


def _tags(values: pa.Array, at: np.ndarray) -> pa.DictionaryArray:
    return pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), values)


class Piece:
    """The sentences of a batch of documents; columns of their tokens are made when they are asked for."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        ids, text = batch.column("doc_id"), pc.fill_null(pc.cast(batch.column("text"), pa.large_string()), "")
        begin = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        inside = _INSIDE[data]
        first = inside.copy()  # bytes with which a word begins
        first[1:] &= ~inside[:-1]
        at = begin[:-1][begin[:-1] < len(data)]
        first[at] = inside[at]
        starts = np.flatnonzero(first)
        self.kept = data[inside]
        self.ends = np.append(np.cumsum(inside)[starts] - 1, len(self.kept))  # where each word begins in kept, and the end
        words = np.bincount(np.searchsorted(begin, starts, "right") - 1, minlength=len(text))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        doc_id = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        most = 1 << 63 - SENTENCE_BITS
        if (known & ((doc_id < -most) | (doc_id >= most))).any():
            raise ValueError("doc_id is too large for sent_key")
        self.doc, number, n = _sentences(doc_id, words)
        self.lang = batch.column("lang")
        self.key = pa.array((doc_id[self.doc] << SENTENCE_BITS) + number, mask=~known[self.doc])
        self.k = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n) + 1  # 1 .. n
        self.n = np.repeat(n, n)
        self.root = (self.n + 1) // 2
        self.offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))

    @cached_property
    def form(self) -> pa.Array:
        return pa.StringArray.from_buffers(len(self.k), pa.py_buffer(self.ends.astype(np.int32)), pa.py_buffer(self.kept))

    @cached_property
    def size(self) -> np.ndarray:
        """Characters of each word."""
        total = np.concatenate([[0], np.cumsum((self.kept & 0xC0) != 0x80)])
        return np.diff(total[self.ends])

    def column(self, name: str) -> pa.Array:
        """A column of the tokens by its name in the reader's schema; tags and labels are dictionaries."""
        k, n, root = self.k, self.n, self.root
        if name == "id":
            return pa.array(k.astype(np.int32))
        if name == "form":
            return self.form
        if name == "lemma":
            return pc.utf8_lower(self.form)
        size = self.size
        if name == "head":
            head = np.where(k > root, np.maximum(root, k - 1 - size % 3), np.minimum(root, k + 1 + size % 3))
            head[(k == root) | ((n >= 17) & (k == n - 1))] = 0
            return pa.array(head.astype(np.int32), mask=(n == 14) & (k == 14))
        if name == "deprel_full":
            label = np.where(k == root, 4, np.where(self.kept[self.ends[1:] - 1] == ord("."), 5, (k + size) % 4))
            return _tags(_LABELS, label * 2 + (size % 2 == 0))
        if name in ("feats", "feats_raw"):
            even, third = (size % 2 == 0).astype(np.int64), (size % 3 == 0).astype(np.int64)
            if name == "feats_raw":
                return _tags(_FEATS, even * 2 + third)
            pairs, twice = pa.array(np.arange(0, 2 * len(k) + 1, 2).astype(np.int32)), np.arange(2 * len(k)).reshape(2, -1).T.ravel()
            return pa.MapArray.from_arrays(pairs, pa.array(["Case", "Number"]).take(pa.array(np.tile([0, 1], len(k)))), _VALUES.take(pa.array(np.concatenate([even, third + 2])[twice])))
        if name == "space_after":
            return pa.array(size % 7 != 0)
        return _tags(*{"upos": (_TAGS, size % 5), "xpos": (_XPOS, size % 3), "misc": (_MISC, (size % 4 != 0).astype(np.int64))}[name])

    def lists(self, name: str) -> pa.Array:
        """A column of the sentences: of their own, or a list of their tokens' values."""
        if name == "path":
            return self.lang.cast(pa.string()).take(pa.array(self.doc))
        if name == "sent_key":
            return self.key
        if name == "sent_id":
            return pc.binary_join_element_wise("s", pc.cast(self.key, pa.string()), "")
        return pa.ListArray.from_arrays(self.offsets, self.column(name))

    def whole(self) -> pa.RecordBatch:
        columns = [self.column(f) for f in _FIELDS]
        toks = pa.StructArray.from_arrays([c.dictionary_decode() if isinstance(c, pa.DictionaryArray) else c for c in columns], _FIELDS)
        return pa.RecordBatch.from_arrays([self.lists("path"), self.key, self.lists("sent_id"), pa.ListArray.from_arrays(self.offsets, toks), pa.array([""] * len(self.key), pa.string())], ["path", "sent_key", "sent_id", "toks", "conllu"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        # Tokens take much more room than text: a piece has about a megabyte of it.
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(size // 1_000_000)) + 1 if len(size) else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield Piece(batch.slice(a, b - a))


class Derived:
    """The sentences of each document. Steps in Python that read few of their columns derive them where they run, so that no token passes through the JVM."""

    def __init__(self, documents: DataFrame) -> None:
        self.texts = spread(documents.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def frame(self) -> DataFrame:
        """All columns, see derive()."""
        return self.texts.mapInArrow(tidy_batches(lambda batches: (p.whole() for p in _pieces(batches))), f"path string, sent_key long, sent_id string, toks array<{TOKEN}>, conllu string")

    def mapped(self, columns: Iterable[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """run over batches of sentences with some columns, those of the tokens as lists."""
        columns = list(columns)
        lists = lambda batches: (pa.RecordBatch.from_arrays([p.lists(c) for c in columns], columns) for p in _pieces(batches))
        return self.texts.mapInArrow(tidy_batches(lambda batches: run(lists(batches))), schema)


def derive(documents: DataFrame) -> DataFrame:
    """(path, sent_key, sent_id, toks, conllu): the sentences of each document, path is its lang. Null texts have none; without a doc_id sent_key is null."""
    return Derived(documents).frame()


#: The tokens in DuckDB, as a chain of WITH parts that ends in every (all tokens) and tok (those on a root).
SQL = rf"""
src AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
pos AS (SELECT doc_id, lang, len(w) AS words, unnest(w) AS form, unnest(range(len(w))) AS p FROM src WHERE len(w) > 0),
cut AS (SELECT *, p % 72 AS i, CASE WHEN p % 72 < 9 THEN 0 WHEN p % 72 < 37 THEN 1 WHEN p % 72 < 41 THEN 2 WHEN p % 72 < 58 THEN 3 ELSE 4 END AS c FROM pos),
num AS (SELECT doc_id * {1 << SENTENCE_BITS} + p // 72 * 5 + c AS sent_key, lang, form, i - [0, 9, 37, 41, 58][c + 1] + 1 AS id,
  least([9, 28, 4, 17, 14][c + 1], words - (p // 72 * 72 + [0, 9, 37, 41, 58][c + 1])) AS n, length(form) AS l FROM cut),
every AS (
  SELECT sent_key, lang, CAST(n AS INT) AS n, CAST(id AS INT) AS id, form, lower(form) AS lemma, l,
    CAST(CASE WHEN id = (n + 1) // 2 OR (n >= 17 AND id = n - 1) THEN 0 WHEN n = 14 AND id = 14 THEN NULL
      WHEN id > (n + 1) // 2 THEN greatest((n + 1) // 2, id - 1 - l % 3) ELSE least((n + 1) // 2, id + 1 + l % 3) END AS INT) AS head,
    ['NOUN', 'VERB', 'ADJ', 'ADP', 'DET'][l % 5 + 1] AS upos, 'X' || l % 3 AS xpos,
    CASE WHEN id = (n + 1) // 2 THEN 'root' WHEN form LIKE '%.' THEN 'punct' ELSE ['nsubj', 'obj', 'case', 'amod'][(id + l) % 4 + 1] END AS deprel,
    CASE WHEN l % 2 = 0 THEN 'Nom' ELSE 'Acc' END AS kase, CASE WHEN l % 3 = 0 THEN 'Plur' ELSE 'Sing' END AS num,
    CASE WHEN l % 4 = 0 THEN 'Gloss=g' ELSE '_' END AS misc, l % 7 <> 0 AS space_after
  FROM num),
tok AS (SELECT * FROM every WHERE head IS NOT NULL)"""
