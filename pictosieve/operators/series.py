"""Bursts: groups of pictures taken in a row, by file names or by capture times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import series_number, series_prefix

#: The largest step between numbers, and the longest time in seconds.
STEP, SECONDS = 5, 60
#: Confidence from which a perceptual group can be a series.
SURE = 95.0


def filename_series(members: DataFrame, group: str, path: str) -> DataFrame:
    """group, by_name: whether all names end in digits after one prefix, in steps of at most ``STEP``."""
    named = members.select(group, series_prefix(F.col(path)).alias("prefix"), series_number(F.col(path)).alias("number"))
    gaps = named.withColumn("gap", F.col("number") - F.lag("number").over(W.partitionBy(group).orderBy("number")))
    regular = (F.count("*") > 1) & (F.count("number") == F.count("*")) & (F.count_distinct("prefix") == 1) & (F.max("gap") <= STEP)
    return gaps.groupBy(group).agg(F.coalesce(regular, F.lit(False)).alias("by_name"))


def possible_series(members: DataFrame, group: str, path: str) -> DataFrame:
    """group: all that can be a series by name or by time, told by counts alone, so that only these are sorted and parsed.

    ``members`` has date_taken and camera. Steps of at most ``STEP`` reach from the first number to the last and leave
    out no whole multiple: of those between, each 64th is asked for.
    """
    known = lambda c: F.when(F.col(c) != "", 1)
    some = members.select(group, series_number(F.col(path)).alias("number"), known("date_taken").alias("dated"), known("camera").alias("shot"))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    step, n = div(F.col("number"), STEP), F.count("*")
    asked = F.count_distinct(F.when(step % 64 == 0, step))
    by_name = (F.count("number") == n) & (F.max("number") - F.min("number") <= STEP * (n - 1))
    by_name &= asked == div(div(F.max("number"), STEP), 64) - div(div(F.min("number"), STEP) + 63, 64) + 1
    by_time = (F.count("dated") == n) & (F.count("shot") == n)
    return some.groupBy(group).agg(((n > 1) & (F.coalesce(by_name, F.lit(False)) | by_time)).alias("possible")).where("possible").select(group)


def time_series(members: DataFrame, group: str, taken: Column, camera: Column) -> DataFrame:
    """group, by_time: whether all have one camera and were taken within ``SECONDS``."""
    shown = members.select(group, taken.alias("taken"), F.when(camera != "", camera).alias("camera"))
    near = (F.unix_micros(F.max("taken")) - F.unix_micros(F.min("taken"))) <= SECONDS * 1_000_000
    every = (F.count("*") > 1) & (F.count("taken") == F.count("*")) & (F.count("camera") == F.count("*")) & (F.count_distinct("camera") == 1)
    return shown.groupBy(group).agg(F.coalesce(every & near, F.lit(False)).alias("by_time"))
