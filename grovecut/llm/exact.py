"""Exact duplicates by a Golomb-coded fingerprint exchange.

Every map partition hashes its texts, sorts the hashes, cuts them by owner range and sends each owner one Golomb-coded
run of gaps. An owner decodes the runs it gets, finds the hashes that occur more than once and answers each sender
with a bitmap over the sender's own order. The senders' orders, written beside the runs, turn bits into document ids.
Only those suspects' texts are shuffled, and grouped by their bytes.

The hashes are as many bits as the number of documents needs plus SPARE_BITS, so an exchange costs little more than
SPARE_BITS bits a document at any size, and about one clean document in 2**SPARE_BITS is a suspect in vain.

Null texts are never duplicates. Empty texts are duplicates of each other. Rows with the same text are duplicates
whatever their ids, also when they have the same id or none. Very long texts are hashed and compared whole. Ties: the least
id is kept, and of rows that share it any one. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, least, small, table

SPARE_BITS = 12
#: Documents that one owner answers for.
OWNER_DOCS = 250_000


def golomb(values: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice code of sorted unsigned integers: gaps, a unary quotient and shift low bits each."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)[None, :]) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def ungolomb(code: bytes, n: int, shift: int) -> np.ndarray:
    """The n integers that golomb() coded."""
    if not n:
        return np.zeros(0, np.uint64)
    whole = np.frombuffer(code, np.uint8)
    low_bytes = (n * shift + 7) // 8
    split = len(whole) - low_bytes
    ends = np.flatnonzero(np.unpackbits(whole[:split]))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(whole[split:])[: n * shift].reshape(n, shift).astype(np.uint64)
    low = (bits << np.arange(shift, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(shift)) + low, dtype=np.uint64)


def rice(bits: int, n: int) -> int:
    """The low bits that suit n values spread over bits bits."""
    return max(0, bits - max(1, int(n)).bit_length())


def _send(bits: int, owners: int):
    def run(batches):
        from pyspark import TaskContext

        prints, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            prints.append(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits))
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
        prints, ids = np.concatenate(prints), np.concatenate(ids)
        order = np.lexsort((ids, prints))
        prints, ids = prints[order], ids[order]
        edges = np.searchsorted(prints, (np.arange(owners + 1, dtype=np.float64) * (2.0**bits / owners)).astype(np.uint64))
        edges[0], edges[-1] = 0, len(prints)
        task = TaskContext.get().partitionId()
        rows = [(task, o, golomb(prints[a:b], rice(bits, b - a)), int(b - a), ids[a:b].tobytes()) for o, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["sender", "owner", "code", "n", "ids"])

    return run


def _own(bits: int):
    def run(group: pa.Table) -> pa.Table:
        codes, counts = group["code"].to_pylist(), group["n"].to_pylist()
        runs = [ungolomb(c, n, rice(bits, n)) for c, n in zip(codes, counts)]
        every = np.sort(np.concatenate(runs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [np.isin(r, twice) for r in runs]
        bitmaps = [np.packbits(f).tobytes() if f.any() else b"" for f in found]  # an empty one: nothing to send
        return pa.table({"sender": group["sender"], "owner": group["owner"], "bitmap": pa.array(bitmaps, pa.binary())})

    return run


def _suspects(batches):
    for batch in batches:
        out = [np.zeros(0, np.int64)]
        for ids, bitmap, n in zip(batch.column("ids").to_pylist(), batch.column("bitmap").to_pylist(), batch.column("n").to_pylist()):
            out.append(np.frombuffer(ids, np.int64)[np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n] == 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["id"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The 64-bit hash of each text that isn't null, and a key of its row: the id, or for rows without one a number that no scan changes."""
    return docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = SPARE_BITS, owner_docs: int = OWNER_DOCS) -> DataFrame:
    """The ids (column id, -2**63 for null) of rows whose text's short hash occurs more than once."""
    n = docs.count()
    bits = min(60, max(8, n.bit_length() + spare_bits))
    owners = max(4, -(-n // owner_docs))
    sent = cut(_keyed(docs, id_col, text_col).mapInArrow(_send(bits, owners), "sender int, owner int, code binary, n int, ids binary"))
    answers = sent.select("sender", "owner", "code", "n").groupBy("owner").applyInArrow(_own(bits), "sender int, owner int, bitmap binary")
    joined = sent.select("sender", "owner", "n", "ids").join(answers.where(F.col("bitmap") != F.lit(b"")), ["sender", "owner"])
    return cut(joined.select("ids", "bitmap", "n").mapInArrow(_suspects, "id long").distinct())


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(doc_id, keep_id, copies): each row whose text another row has too, the least id of the group and its rows.

    Rows without an id show doc_id null; keep_id is null if no row of the group has one.
    """
    found = small(suspects(docs, id_col, text_col, **how))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("id")).join(found, "id", "left_semi")
    # Texts are grouped by their bytes; rows find their group again by a cryptographic hash, so that a text of many copies is no long list.
    groups = rows.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = small(cut(groups.select(F.unhex(F.sha2("text", 256)).alias("s"), "keep_id", "copies")))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("s")).join(groups, "s").select("doc_id", "keep_id", "copies")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs with one row of every group of equal texts, the one with the least id; null texts all stay. Columns as in docs."""
    found = small(suspects(docs, id_col, text_col, **how))
    mark = fresh(docs, "suspect")
    marked = docs.join(found.select(F.col("id").alias(mark)), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) == F.col(mark), "left")
    clean = marked.where(F.col(mark).isNull() | F.col(text_col).isNull()).drop(mark)
    twice = marked.where(F.col(mark).isNotNull() & F.col(text_col).isNotNull()).drop(mark)
    row = fresh(docs, "row")
    one = twice.groupBy(F.xxhash64(text_col), F.col(text_col)).agg(F.min_by(F.struct(*docs.columns), least(docs, id_col)).alias(row))
    return clean.unionByName(one.select(f"{row}.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has an exact copy, with the copy that is kept."""
    return duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, keep_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL) WHERE copies > 1"""
