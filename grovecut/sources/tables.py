"""Tables that a scan would read in fewer tasks than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a split, as Spark cuts files by default.
SPLIT_BYTES = 1 << 27


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is a few small files, which can be split at their row groups only. A table that fills the cores by itself isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES and len(df.inputFiles()) < cores else df
