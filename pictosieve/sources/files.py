"""Listing and reading image files with Spark's own sources."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension
from ..request import ScanRequest


def _inside(root: str, request: ScanRequest) -> Column:
    """Below the root, in no hidden directory, and directly in it if sub-folders are not asked for."""
    root = root.rstrip("/")
    rest = F.substr(F.col("path"), F.lit(len(root) + 1))
    ok = F.col("path").startswith(root + "/") & ~rest.rlike(r"/\.[^/]+/")
    return ok if request.include_subfolders else ok & ~F.substr(rest, F.lit(2)).contains("/")


def select(files: DataFrame, request: ScanRequest) -> DataFrame:
    """``files`` (path, size, and width and height where known) that the request asks for, each path once."""
    out = files.where(reduce(lambda a, b: a | b, (_inside(r, request) for r in request.roots)))
    out = out.where(extension(F.col("path")).isin(list(request.wanted)))
    if request.min_file_size > 0:
        out = out.where(F.col("size") >= request.min_file_size)
    if request.max_file_size > 0:
        out = out.where(F.col("size") <= request.max_file_size)
    if request.min_width > 0:  # what has no known width passes
        out = out.where(F.coalesce(F.nullif("width", F.lit(0)) >= request.min_width, F.lit(True)))
    if request.max_height > 0:
        out = out.where(F.coalesce(F.nullif("height", F.lit(0)) <= request.max_height, F.lit(True)))
    return out.dropDuplicates(["path"])


def plain(path: Column) -> Column:
    """A local path without its scheme."""
    return F.regexp_replace(path, "^file:(//)?", "")


def listing(spark: SparkSession, request: ScanRequest) -> DataFrame:
    """path, size, mtime, content of the files below the roots; roots that are not there give nothing.

    Spark's lister leaves out names that begin with a dot or an underscore, and empty files. The content
    is read only where a plan uses it.
    """
    jvm, roots = spark._jvm, []
    for root in dict.fromkeys(request.roots):
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            roots.append(root)
    if not roots:
        return spark.createDataFrame([], "path string, size long, mtime timestamp, content binary")
    names = ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in re.sub(r"[^.\w]", "", e)) for e in request.wanted)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + names + "}").load(roots)
    return read.select(plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
