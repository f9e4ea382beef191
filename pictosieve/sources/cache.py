"""Stored hashes of files, so that a scan hashes only what is new or changed.

A cache is a Parquet table of path, size, digest and whatever else is stored with it; the version of its
layout is part of its directory's name, so another version is simply not found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def directory(folder: str, root: str, algorithm: str = "dhash") -> str:
    """Where the cache of a root lies; algorithms don't share one."""
    import hashlib

    return f"{folder}/{hashlib.sha256(root.encode()).hexdigest()[:16]}-{algorithm}-v{VERSION}"


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int], list[int]]:
    """The file system, and the numbers of all stored versions and of the complete ones."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    every = sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())
    return fs, every, [n for n in every if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version of the cache, empty if there is none."""
    _, _, complete = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={complete[-1]}") if complete else spark.createDataFrame([], schema)


def merge(*caches: DataFrame) -> DataFrame:
    """Entries of the first cache that has a path."""
    tagged = (c.withColumn("_priority", F.lit(i)) for i, c in enumerate(caches))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = every.groupBy("path").agg(F.min_by(F.struct(*[c for c in every.columns if c not in ("path", "_priority")]), "_priority").alias("e"))
    return best.select("path", "e.*")


def _same(cache: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"f.{k}") == F.col(f"c.{k}") for k in keys))


def hits(files: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("path", "size")) -> DataFrame:
    """Files that are stored as they are, with what is stored."""
    more = [c for c in cache.columns if c not in keys and c not in files.columns]
    return files.alias("f").join(cache.alias("c"), _same(cache, keys)).select("f.*", *(f"c.{c}" for c in more))


def misses(files: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("path", "size")) -> DataFrame:
    return files.alias("f").join(cache.alias("c"), _same(cache, keys), "left_anti")


def updated(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache to store: new entries, and old ones of other paths."""
    return cache.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.select(*cache.columns))


def save(cache: DataFrame, path: str) -> None:
    """A version of its own; older ones go when it is complete, so that a crash at any point leaves one."""
    spark = cache.sparkSession
    fs, every, _ = _versions(spark, path)
    new = every[-1] + 1 if every else 1
    cache.write.parquet(f"{path}/version={new}")
    for old in every:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
