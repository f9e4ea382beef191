"""Queries over a result: narrowing, sorting, folders, and plans of what to delete.

``images`` is the flat result: a row for each image of a group, as ``groups.ranked`` gives it. State that
a user builds up (selected groups, promoted or deleted paths) comes as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import base_name, difference, format_bytes, parent, short_path, shown_date, shown_extension
from ..request import FilterSpec, SortSpec


def narrow(images: DataFrame, spec: FilterSpec) -> DataFrame:
    """Images that pass; groups that keep fewer than two of them, or another number than asked for, go."""
    out = images
    if spec.folder is not None:
        inside = F.replace(F.col("path"), F.lit("\\"), F.lit("/")).startswith(spec.folder + "/")
        out = out.withColumn("_any", F.max(inside).over(W.partitionBy("group_id"))).where("_any").drop("_any")
    keep: list[Column] = []
    if spec.max_diff is not None:
        keep.append(100 - F.coalesce(F.col("confidence"), F.lit(100.0)) <= spec.max_diff)
    if spec.filename:
        keep.append(F.lower(base_name(F.col("path"))).contains(spec.filename.lower()))
    if spec.extensions:
        keep.append(F.ltrim(F.col("ext"), F.lit(".")).isin([e.lower().lstrip(".") for e in spec.extensions]))
    if spec.min_size is not None:
        keep.append(F.col("size") >= spec.min_size)
    if spec.max_size is not None:
        keep.append(F.col("size") <= spec.max_size)
    for k in keep:
        out = out.where(k)
    n = F.col("_n")
    size = (n >= max(2, spec.min_group or 0)) & (n <= spec.max_group if spec.max_group is not None else F.lit(True))
    return out.withColumn("_n", F.count("*").over(W.partitionBy("group_id"))).where(size).drop("_n")


def sort_groups(groups: DataFrame, descending: bool = False) -> DataFrame:
    diff = difference(F.col("confidence"))
    return groups.withColumn("diff", diff).withColumn("place", F.row_number().over(W.orderBy(F.desc("diff") if descending else F.asc("diff"), "group_id")))


def sort_images(images: DataFrame, spec: SortSpec) -> DataFrame:
    """Adds ``place``: of an image in its group by the key; equal ones stay in order of rank."""
    keys = {
        "name": F.lower(base_name(F.col("path"))), "path": F.lower("path"), "dim": F.col("width") * F.col("height"), "ext": F.col("ext"),
        "size": F.col("size"), "block": F.col("blockiness") if "blockiness" in images.columns else F.lit(0), "blur": F.col("blurring") if "blurring" in images.columns else F.lit(0),
    }
    key = keys.get(spec.key, F.lit(""))
    order = W.partitionBy("group_id").orderBy(key.desc() if spec.descending else key.asc(), "rank")
    return images.withColumn("place", F.row_number().over(order))


def view(images: DataFrame, narrowed: FilterSpec, sort: SortSpec | None = None) -> DataFrame:
    """What a table shows: the images that pass, with the place of their group (by difference) and their own in it."""
    from .groups import summaries

    out = narrow(images, narrowed)
    sort = sort or SortSpec()
    places = sort_groups(summaries(out), descending=sort.key == "diff" and sort.descending).select("group_id", F.col("place").alias("group_place"))
    return sort_images(out, sort).join(places, "group_id")


def image_rows(images: DataFrame, promoted: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """A table's row for each image: group_id, path, status, pending, name, folder, extension, dimensions, size, taken."""
    none = images.select("path").limit(0)
    up, gone = ((none if x is None else x.select("path").distinct()) for x in (promoted, pending))
    marked = images.join(up.withColumn("_up", F.lit(True)), "path", "left").join(gone.withColumn("_gone", F.lit(True)), "path", "left")
    p, known = F.col("path"), (F.col("width") > 0) & (F.col("height") > 0)
    return marked.select(
        "group_id", "path", F.when(F.col("is_best") | F.coalesce("_up", F.lit(False)), "Original").otherwise("Duplicate").alias("status"), F.coalesce("_gone", F.lit(False)).alias("pending"),
        base_name(p).alias("name"), short_path(parent(p)).alias("folder"), shown_extension(p).alias("extension"),
        F.when(known, F.concat(F.col("width").cast("string"), F.lit("\u00d7"), F.col("height").cast("string"))).otherwise("--").alias("dimensions"), format_bytes(F.col("size")).alias("shown_size"), shown_date(F.col("date_taken")).alias("taken"),
    )


def counters(selected: DataFrame, pending: DataFrame) -> DataFrame:
    """One row of labels: of the selected groups, and of the deletions to confirm (empty if there are none)."""
    several = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    groups, paths = selected.agg(F.count_distinct("group_id").alias("g")), pending.agg(F.count_distinct("path").alias("p"))
    return groups.crossJoin(F.broadcast(paths)).select(several(F.col("g"), "group").alias("groups"), F.when(F.col("p") > 0, F.concat(F.lit("Confirm "), several(F.col("p"), "deletion"))).otherwise("").alias("deletions"))


def folders(images: DataFrame) -> DataFrame:
    """folder, images, sorted; the row ``All`` counts all."""
    return images.groupBy(parent(F.col("path")).alias("f")).agg(F.count("*").alias("n")).rollup("f").agg(F.sum("n").alias("images")).select(F.coalesce("f", F.lit("All")).alias("folder"), "images").orderBy("folder")


def keep_best(images: DataFrame, selected: DataFrame | None = None, promoted: DataFrame | None = None) -> DataFrame:
    """Paths to delete so that each (selected) group keeps its best and promoted images."""
    out = images if selected is None else images.join(selected, "group_id", "left_semi")
    out = out.where(~F.col("is_best"))
    return (out if promoted is None else out.join(promoted, "path", "left_anti")).select("group_id", "path", "size")


def delete_all(images: DataFrame, selected: DataFrame) -> DataFrame:
    return images.join(selected, "group_id", "left_semi").select("group_id", "path", "size")


def after_delete(images: DataFrame, deleted: DataFrame) -> DataFrame:
    """The result without deleted paths and without groups that are left with one image."""
    left = images.join(deleted.select("path"), "path", "left_anti")
    return left.withColumn("_n", F.count("*").over(W.partitionBy("group_id"))).where("_n >= 2").drop("_n")


def report(images: DataFrame, photos: DataFrame, group_id: str, now: Column | None = None) -> DataFrame:
    """One row, a JSON text, on a group whose match looks wrong; ``{"error": ...}`` if there is none."""
    digests = photos.select("path", "digest", F.lower(F.lpad(F.hex("d_hash"), 16, "0")).alias("d_hash"))
    rows = images.where(F.col("group_id") == group_id).join(digests, "path")
    image = F.struct("rank", "path", base_name(F.col("path")).alias("filename"), "size", "width", "height", "quality_score", "is_best", "digest", "d_hash")
    grouped = rows.groupBy("group_id", "match_type", "confidence").agg(F.array_sort(F.collect_list(image)).alias("images"))
    when = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    text = F.to_json(F.struct(F.lit("mismatch").alias("report_type"), "group_id", "match_type", "confidence", when.alias("timestamp"), "images"))
    one = images.sparkSession.range(1).select(F.lit('{"error":"group not found"}').alias("none"))
    return one.join(F.broadcast(grouped.select(text.alias("json"))), how="left").select(F.coalesce("json", "none").alias("report"))
