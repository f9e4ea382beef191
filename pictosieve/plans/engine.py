"""A scan from files to groups: list, hash (or take stored hashes), group, rank, count."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.imaging import decoded, header, literal, rasters
from ..functions.scalars import aspect_bucket
from ..operators import exact, groups, raster
from ..request import ScanRequest
from ..sources import cache, files
from ..storage import cut

STORED = "path string, size long, mtime timestamp, digest string, d_hash long, width int, height int, date_taken string, gps_lat double, gps_lon double, camera string, lens string, description string"


@dataclass
class ScanResult:
    status: str
    photos: DataFrame | None = None
    images: DataFrame | None = None
    stats: DataFrame | None = None
    seconds: float = 0.0


#: Files that are read at once.
FILES = 10_000


def hashed(spark: SparkSession, listed: DataFrame, algorithm: str, stop: Callable[[], bool] = lambda: False, told: Callable[[int], None] = lambda n: None) -> DataFrame:
    """Files (path, size, mtime, and whether their digest is needed) with everything that a cache stores.

    Only these files are read, ``FILES`` at a time by their paths: their content once for header and digest,
    and once by Spark's image source, which decodes what it can. ``stop`` is asked and ``told`` hears how many
    files are done between these.
    """
    wanted = listed if "digested" in listed.columns else listed.withColumn("digested", F.lit(True))
    wanted = cut(spark, wanted.select("path", "size", "mtime", "digested"))
    rows, parts, done = ((r[0], r[1]) for r in wanted.select("path", "digested").toLocalIterator()), [], 0
    while not stop() and (some := list(islice(rows, FILES))):
        these = [literal(p) for p, _ in some]
        read = spark.read.format("binaryFile").load(these).select(files.plain(F.col("path")).alias("path"), "content")
        flags = spark.createDataFrame(some, "path string, digested boolean")  # at most ``FILES`` rows
        read = read.join(F.broadcast(flags), "path")
        known = read.select("path", F.when(F.col("digested"), F.sha2("content", 256)).alias("digest"), header(F.col("content")).alias("h")).select("path", "digest", "h.*")
        pixels = decoded(spark, *these).select("path", F.col("a_hash" if algorithm == "phash" else "d_hash").alias("d_hash"), F.col("width").alias("w"), F.col("height").alias("v"))
        parts.append(cut(spark, known.join(pixels, "path", "left").withColumn("width", F.coalesce("width", "w")).withColumn("height", F.coalesce("height", "v")).drop("w", "v")))
        done += len(some)
        told(done)
    if not parts:
        return spark.createDataFrame([], STORED)
    return wanted.join(reduce(DataFrame.unionByName, parts), "path").select(*(c.split()[0] for c in STORED.split(", ")))


def scan(spark: SparkSession, request: ScanRequest, cache_folder: str | None = None, stop: Callable[[], bool] = lambda: False, told: Callable[[str, int], None] = lambda phase, n: None) -> ScanResult:
    """The whole plan. With a cache folder, files that are stored as they are (path, size, time) are not read.

    A digest is made of files only whose size another file has. Between the phases, and while files are hashed,
    ``stop`` is asked whether to end (the status is ``cancelled`` then) and ``told`` hears a phase and a number.
    """
    began, threshold = time.time(), request.threshold if request.threshold > 0 else 10
    over = lambda status, **x: ScanResult(status, seconds=time.time() - began, **x)
    listed = files.listing(spark, request)
    if request.min_width > 0 or request.max_height > 0:
        listed = listed.withColumn("h", header(F.col("content"))).select("*", "h.width", "h.height").drop("h")
    listed = cut(spark, files.select(listed, request).select("path", "size", "mtime"))
    told("listed", listed.count())
    shared = exact.size_buckets(listed).select(F.col("size").alias("shared"))
    listed = listed.join(shared, F.col("size") == F.col("shared"), "left").select("path", "size", "mtime", F.col("shared").isNotNull().alias("digested"))
    if stop():
        return over("cancelled")
    hear = lambda n: told("hashed", n)
    if cache_folder:
        places = [cache.directory(cache_folder, r, request.algorithm) for r in request.roots]
        stored = cache.merge(*(cache.load(spark, p, STORED) for p in places)).select(*(c.split()[0] for c in STORED.split(", ")))
        old = cut(spark, cache.hits(listed, stored, ("path", "size", "mtime")).where(~F.col("digested") | F.col("digest").isNotNull()))
        new = hashed(spark, listed.join(old.select("path"), "path", "left_anti"), request.algorithm, stop, hear)
        photos = cut(spark, old.select(*stored.columns).unionByName(new))
        cache.save(cut(spark, cache.updated(stored, photos)), places[0])
    else:
        photos = cut(spark, hashed(spark, listed, request.algorithm, stop, hear))
    if stop():
        return over("cancelled", photos=photos)
    if photos.isEmpty():
        return over("No images found")
    photos = photos.withColumn("bucket", aspect_bucket(F.col("width"), F.col("height"))).fillna({"date_taken": "", "camera": "", "lens": "", "description": "", "gps_lat": 0.0, "gps_lon": 0.0})
    images = cut(spark, groups.ranked(groups.members(spark, photos, threshold, request.include_series), photos))
    told("grouped", images.count())
    return over("complete", photos=photos, images=images, stats=groups.stats(photos, images))


def picture_quality(spark: SparkSession, *paths: str) -> DataFrame:
    """path, blockiness, blurring of the pictures at the paths, when a caller asks for them; small pictures have 0."""
    pixels = rasters(spark, *(literal(p) for p in paths))
    found = raster.blockiness(pixels, "path").join(raster.blurring(pixels, "path"), "path")
    small = decoded(spark, *(literal(p) for p in paths)).select("path")
    return small.join(found, "path", "left").na.fill(0.0, ["blockiness", "blurring"])
