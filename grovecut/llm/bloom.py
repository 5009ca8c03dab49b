"""A Bloom filter of fixed size, built in slices by the executors. It grows with no corpus: a fuller one lets more through."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import mix

#: Bits of the filter (16 MB whatever the corpus), slices in which it is built, and bits a name sets.
BITS, SLICES, HASHES = 1 << 27, 16, 3


def _places(name: np.ndarray) -> np.ndarray:
    """The bits of names, a column for each hash."""
    h = mix(name.view(np.uint64))
    step = (mix(h) << np.uint64(1)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(BITS) for k in range(HASHES)], 1).astype(np.int64)


def _sent(batches):
    for batch in batches:
        at = np.unique(_places(batch.column("name").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array((at // (BITS // SLICES)).astype(np.int32)), pa.array((at % (BITS // SLICES)).astype(np.int32))], ["slice", "at"])


def _slice(group: pa.Table) -> pa.Table:
    bits = np.zeros(BITS // SLICES, bool)
    bits[group["at"].to_numpy()] = True
    return pa.table({"slice": group["slice"][:1], "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})


def build(names: DataFrame) -> np.ndarray:
    """A filter that lets all names (column name, long) through, as packed bits."""
    out = np.zeros(BITS // 8, np.uint8)
    step = len(out) // SLICES
    for r in names.select("name").mapInArrow(_sent, "slice int, at int").distinct().groupBy("slice").applyInArrow(_slice, "slice int, bits binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def passes(filter_: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether each name may be in the filter; true for all that are."""
    at = _places(name)
    return ((filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
