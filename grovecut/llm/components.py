"""Connected components by alternating large-star and small-star rounds, with lineage cut every round.

Before the rounds each task replaces the edges it holds by stars (a union-find of its own), so a group with all its pairs
costs about as many edges as it has nodes.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that a task holds at once before it replaces them by stars.
HELD_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node with the least node of its component, the least one's with itself left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            far = root != np.arange(len(nodes))
            return nodes[far], nodes[root[far]]


def _contract(batches):
    u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        u.append(batch.column("u").to_numpy(zero_copy_only=False))
        v.append(batch.column("v").to_numpy(zero_copy_only=False))
        held += len(u[-1])
        if held > HELD_EDGES:
            x, y = stars(np.concatenate(u), np.concatenate(v))
            u, v, held = [x], [y], 0
            if len(x) > HELD_EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x, y = stars(np.concatenate(u), np.concatenate(v))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the least node of its component. Loops and repeated edges are allowed; edges with a null end are left out.

    Each round is two groupings by node; their number grows with the logarithm of the largest component.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    first = start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    if dict(start.dtypes)["u"] == "bigint":
        first = first.mapInArrow(_contract, "u long, v long")
    first = cut(first.distinct())
    nodes = first.select("u").union(first.select("v")).union(start.where("u = v").select("u")).distinct()
    now, last = first, None
    for _ in count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == last:
            break
        last = state
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("root"))
