"""Files by Hadoop's file systems, so that a path may be local, file:, hdfs:, s3a: or whatever the session knows."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def head(spark: SparkSession, path: str, size: int = 65536) -> str:
    """The first bytes of a file, as Latin-1."""
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size)).decode("latin-1")
    finally:
        stream.close()


def treebanks(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, stamp) of a path: itself, or all *.conllu below it, sorted. The stamp names a file by its path, size and time of change."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        status = each.next()
        name = status.getPath().toString()
        if name.endswith(".conllu") or name == fs.getFileStatus(p).getPath().toString():
            found.append((name, hashlib.sha1(f"{name}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()))
    return sorted(found)
