"""Work that can be taken up again: a cache of parsed treebanks, and counts kept by file so that only new files are counted.

Paths are of any file system that the session knows. All files that are new are read and counted in one job. A run's counts
count only if its list of files was written too, so that a run which broke off leaves nothing behind that is used.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mine as M
from ..plans.spec import MineSpec
from ..sources import paths
from ..sources.conllu import read_conllu


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The treebank files of a path: itself, or all *.conllu below it, sorted."""
    return [f for f, _ in paths.treebanks(spark, path)]


def cached(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The parsed sentences of a file, from Parquet if they are there and the file hasn't changed. What is kept doesn't depend on settings."""
    target = f"{folder}/{paths.treebanks(spark, path)[0][1]}"
    if not paths.exists(spark, f"{target}/_SUCCESS"):
        read_conllu(spark, path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _settings(spec: MineSpec) -> str:
    """Names the settings that counts depend on."""
    used = (spec.size, spec.processing_size, spec.node_type, spec.labeled, spec.label_subtypes, spec.fixed, spec.complete, spec.head, spec.ignored_labels, spec.allowed_labels, spec.query)
    return hashlib.sha1(repr(used).encode()).hexdigest()[:16]


def resumed_counts(spark: SparkSession, path: str, spec: MineSpec, folder: str) -> tuple[DataFrame, int]:
    """(counts with examples, tokens) of all files below path; files whose counts are in folder aren't read again."""
    files = paths.treebanks(spark, path)
    if not files:
        raise FileNotFoundError(f"no *.conllu in {path}")
    base = f"{folder}/{_settings(spec)}"
    done = {r["stamp"] for r in spark.read.parquet(f"{base}/done").select("stamp").collect()} if paths.exists(spark, f"{base}/done") else set()
    new = [x for x in files if x[1] not in done]
    if new:
        run = uuid.uuid4().hex
        stamps = spark.createDataFrame(new, "path string, stamp string")
        sentences = read_conllu(spark, [f for f, _ in new])
        counted = M.counts(sentences, spec, [*M.PARTS, "example"], by_path=True)
        counted.join(stamps, "path").drop("path").write.parquet(f"{base}/counts/run={run}")
        sizes = sentences.groupBy("path").agg(F.sum(F.size("toks")).alias("tokens"))
        stamps.join(sizes, "path", "left").select("stamp", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).write.parquet(f"{base}/done/run={run}")
    now = spark.createDataFrame([(k, stamp) for k, (_, stamp) in enumerate(files)], "file_rank int, stamp string")
    kept = spark.read.parquet(f"{base}/done").join(now, "stamp")
    tokens = kept.agg(F.sum("tokens")).head()[0]
    return merged(spark.read.parquet(f"{base}/counts").join(kept.select("stamp", "run", "file_rank"), ["stamp", "run"]).drop("stamp", "run")), tokens


def merged(parts: DataFrame) -> DataFrame:
    """Counts of files as counts of all: numbers added, the best exemplar and the first shape by file_rank."""
    e = F.col("exemplar")
    rank = F.struct(F.when(e["n_tokens"] < M.SHORT, 0).otherwise(e["n_tokens"]), F.col("file_rank"), e["sent_key"], e["ord"])
    rest = [c for c in parts.columns if c not in ("key", "number", "file_rank", "exemplar", "example", "example_id")]
    best = F.min_by(F.struct("exemplar", "example", "example_id"), rank).alias("best")
    out = parts.groupBy("key").agg(F.sum("number").alias("number"), *[F.min_by(c, "file_rank").alias(c) for c in rest], best)
    return out.select("key", "number", *rest, "best.*")
