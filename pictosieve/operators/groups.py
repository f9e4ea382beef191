"""From members of groups to ranked, ordered and counted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import base_name, confidence, extension, quality_score
from ..storage import cut, cut_for_join
from .series import SURE, filename_series, possible_series, time_series
from .similarity import perceptual_members

IMAGE = ("path", "size", "width", "height", "date_taken", "gps_lat", "gps_lon", "camera", "lens", "description")


def taken(date_taken: Column) -> Column:
    return F.try_to_timestamp(F.nullif(date_taken, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def score(photos: DataFrame) -> Column:
    known = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    placed = F.coalesce((F.col("gps_lat") != 0) & (F.col("gps_lon") != 0), F.lit(False))
    return quality_score(F.col("width"), F.col("height"), F.col("size"), known("date_taken"), placed, known("camera"), known("lens"), known("description"))


def linked(spark: SparkSession, photos: DataFrame, threshold: int = 10, banded: bool | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Exact copies (path, group_path) and other similar photos (path, group_path, min_distance), each with the columns to ``keep``.

    ``photos``: path, digest (null: alone), bucket, d_hash. Photos with an exact copy are left out of the perceptual pass.
    """
    several = photos.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    marked = photos.select("path", "digest", "bucket", "d_hash", *keep).join(cut_for_join(spark, several)[0], "digest", "left")
    marked = cut(spark, marked.withColumn("digest", F.when(F.col("n").isNotNull(), F.col("digest"))).drop("n"))
    copies = marked.where(F.col("digest").isNotNull())
    exact = copies.join(copies.groupBy("digest").agg(F.min("path").alias("group_path")), "digest").select("path", "group_path", *keep)
    return exact, perceptual_members(spark, marked.where(F.col("digest").isNull()).drop("digest"), threshold, banded, keep)


def members(spark: SparkSession, photos: DataFrame, threshold: int = 10, include_series: bool = True, banded: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, group_path, match_type, confidence for every photo in a group, and the columns to ``keep``.

    ``photos``: path, size, digest (null: alone), bucket, d_hash, and the columns of ``IMAGE``. Photos with an
    exact copy are left out of the perceptual pass. Without series, groups whose nearest pair is within half the
    threshold and whose names are a series go first; what is sure enough and in a series by then is a series too.
    """
    also = (*(c for c in ("date_taken", "camera") if c not in keep), *keep)
    exact, found = linked(spark, photos, threshold, banded, also)
    found = cut(spark, found)
    if not include_series:
        named = filename_series(found, "group_path", "path").where("by_name").select("group_path")
        close = found.where(F.col("min_distance") <= threshold // 2).select("group_path").distinct().join(named, "group_path", "left_semi")
        found = found.join(close, "group_path", "left_anti")
    conf = confidence(F.col("min_distance"))
    sure = found.where(conf >= SURE)
    possible, few = cut_for_join(spark, possible_series(sure, "group_path", "path"))
    sure = sure.join(possible, "group_path", "left_semi")
    named = filename_series(sure, "group_path", "path").where("by_name")
    timed = time_series(sure, "group_path", taken(F.col("date_taken")), F.col("camera")).where("by_time")
    series = named.select("group_path").unionAll(timed.select("group_path")).distinct().withColumn("in_series", F.lit(True))
    kind = F.when(F.col("in_series"), "series").otherwise("perceptual")
    near = found.join(F.broadcast(series) if few else series, "group_path", "left").select("path", "group_path", kind.alias("match_type"), conf.alias("confidence"), *keep)
    out = exact.select("path", "group_path", F.lit("exact").alias("match_type"), F.lit(100.0).alias("confidence"), *keep).unionByName(near)
    return out if include_series else out.where(F.col("match_type") != "series")


def ranked(found: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """Members with their image's columns, quality_score, and rank in the group (1: the one to keep).

    ``photos`` None: the members have the columns of ``IMAGE``.
    """
    full = found.withColumn("quality_score", score(found)) if photos is None else found.join(photos.select(*IMAGE, score(photos).alias("quality_score")), "path")
    group_id = F.substring(F.sha2(F.concat(F.col("match_type"), F.lit(":"), F.col("group_path")), 256), 1, 16)
    # by the id, not the path, so that what is asked of a group later finds its rows together
    order = W.partitionBy("group_id").orderBy(F.desc("quality_score"), "path")
    out = full.withColumn("group_id", group_id).withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)
    return out.withColumn("ext", extension(F.col("path")))


def summaries(images: DataFrame) -> DataFrame:
    """One row a group, largest first: group_id, match_type, confidence, images, wasted_bytes, best."""
    return images.groupBy("group_id", "match_type", "confidence").agg(
        F.count("*").alias("images"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("size"))), F.lit(0)).alias("wasted_bytes"), F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("best")
    ).orderBy(F.desc("images"), "group_id")


def json_lines(images: DataFrame) -> DataFrame:
    """group_id, rank, json: an image with its group's fields as one JSON text, so a group of any size stays dealt in rows."""
    shown = F.struct("group_id", "match_type", "confidence", "rank", "path", base_name(F.col("path")).alias("filename"), "size", "width", "height", "quality_score", "is_best")
    return images.select("group_id", "rank", F.to_json(shown).alias("json"))


def stats(photos: DataFrame, images: DataFrame) -> DataFrame:
    """One row: total_files, duplicate_groups, wasted_bytes."""
    found = images.agg(F.count(F.when(F.col("rank") == 1, 1)).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("size"))), F.lit(0)).alias("wasted_bytes"))
    return photos.agg(F.count("*").alias("total_files")).crossJoin(F.broadcast(found))


def stats_of_members(photos: DataFrame, found: DataFrame) -> DataFrame:
    """``stats`` of members that are not ranked: path, group_path, and the columns of ``IMAGE``.

    What is kept of a group is a minimum, so no group is sorted, and none is gathered in a task.
    """
    first = F.struct(score(found).isNull(), -score(found), "path", "size").alias("image")
    each = found.select("group_path", "size", first).groupBy("group_path").agg(F.sum("size").alias("bytes"), F.min("image").alias("best"))
    wasted = F.coalesce(F.sum(F.coalesce("bytes", F.lit(0)) - F.coalesce("best.size", F.lit(0))), F.lit(0))
    return photos.agg(F.count("*").alias("total_files")).crossJoin(F.broadcast(each.agg(F.count("*").alias("duplicate_groups"), wasted.alias("wasted_bytes"))))
