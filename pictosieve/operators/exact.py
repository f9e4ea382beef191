"""Exact copies: sizes first, then the head of the content, then all of it.

The reductions are semi joins on aggregates, so files with a size of their own never have their content
read; nothing is collected by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_buckets(files: DataFrame) -> DataFrame:
    """size, files, for sizes that several files have; empty files never match one another."""
    return files.where(F.col("size") > 0).groupBy("size").agg(F.count("*").alias("files")).where(F.col("files") > 1)


def size_singletons(files: DataFrame) -> DataFrame:
    alone = files.groupBy("size").agg(F.count("*").alias("files")).where(F.col("files") == 1).select("size")
    return files.join(alone, "size", "left_semi")


def candidates(files: DataFrame, *keys: str) -> DataFrame:
    """The files that share all ``keys`` with another file."""
    shared = files.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys)
    return files.join(shared, list(keys), "left_semi")


def exact_members(files: DataFrame, head: int = 65536) -> DataFrame:
    """``files``: path, size, content. Adds digest and group_path (the group's first path) for files with a copy."""
    same_size = candidates(files.where(F.col("size") > 0), "size")
    same_head = candidates(same_size.withColumn("head", F.sha2(F.substring("content", 1, head), 256)), "size", "head")
    hashed = same_head.withColumn("digest", F.sha2("content", 256)).drop("head", "content")
    groups = hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("path").alias("group_path")).where(F.col("n") > 1)
    return hashed.join(groups.select("digest", "group_path"), "digest")
