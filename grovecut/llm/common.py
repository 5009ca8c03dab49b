"""What the operators of this subpackage share: reading, cutting lineage, names, size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import give_back, tidy_batches  # noqa: F401
from ..sources.tables import spread

#: Rows up to which a table of a few numbers a row is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, dealt to all cores if it is too small a number of files for them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir, or where none is named, a folder for tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs no recomputation before this."""
    shared(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows; df should be checkpointed, for it is counted."""
    return F.broadcast(df) if df.count() <= limit else df


def least(df: DataFrame, key: str) -> Column:
    """Orders rows by key with nulls last, for min_by."""
    return F.struct(F.col(key).isNull(), F.col(key))


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow, giving back memory after each group."""

    def inner(group):
        try:
            return run(group)
        finally:
            give_back()

    return inner


def tidy_stream(run: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As tidy_group, for a function that returns a group's result in parts."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pa.Table.from_batches(batches))
        finally:
            give_back()

    return inner


def tidy_keyed(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """As tidy_group, for a function of key and group."""

    def inner(key, group):
        try:
            return run(key, group)
        finally:
            give_back()

    return inner
