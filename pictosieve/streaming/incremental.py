"""Hash files as they arrive: a stream over a folder that keeps its cache up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.imaging import header
from ..sources import cache
from ..storage import cut


def watch(spark: SparkSession, folder: str, store: str, progress: str, glob: str = "*") -> StreamingQuery:
    """Takes what is there now (and was not taken before) and ends; ``progress`` holds the stream's checkpoint.

    A batch replaces the cache's entries of its paths, so a batch that runs twice changes nothing.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    files = new.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"), header(F.col("content")).alias("h"))
    entries = files.select("path", "size", "mtime", "digest", "h.width", "h.height")

    def store_batch(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        stored = cache.load(session, store, "path string, size long, mtime timestamp, digest string, width int, height int")
        cache.save(cut(session, cache.updated(stored, batch.dropDuplicates(["path"]))), store)

    return entries.writeStream.foreachBatch(store_batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
