"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1))


def shown_extension(path: Column) -> Column:
    """What follows the last dot of the path, upper-case; empty if there is none."""
    return F.when(path.contains("."), F.upper(F.substring_index(path, ".", -1))).otherwise("")


def shown_date(taken: Column) -> Column:
    """As "May 6, 2024 07:08 AM"; ``--`` if there is none, and what is no date as it is."""
    return F.when(F.coalesce(taken, F.lit("")) == "", "--").otherwise(F.coalesce(F.date_format(F.try_to_timestamp(taken), "MMM d, yyyy hh:mm a"), taken))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def parent(path: Column) -> Column:
    """Up to the last slash or backslash; ``/`` if that is the first character or there is none."""
    up = F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*\z", 1)
    return F.when(up == "", F.lit("/")).otherwise(up)


def short_path(path: Column) -> Column:
    """The last two parts after ``.../``; a path of at most two parts stays."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def series_prefix(path: Column) -> Column:
    """What stands before the digits at the end of the name, lower-case; null without digits that fit 64 bits."""
    return F.when(series_number(path).isNotNull(), F.lower(F.regexp_extract(stem(path), r"(?s)^(.*?)(\d+)\z", 1)))


def series_number(path: Column) -> Column:
    return F.regexp_extract(stem(path), r"(?s)^(.*?)(\d+)\z", 2).try_cast("long")


def aspect_bucket(width: Column, height: Column) -> Column:
    """Long over short side in steps of a twentieth; ``unknown`` if a side is 0 or null."""
    ratio = F.greatest(width, height).cast("double") / F.least(width, height)
    return F.when((width > 0) & (height > 0), F.format_string("%.2f", F.round(ratio * 20) / 20)).otherwise("unknown")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_text(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("long")


def sampled(i: Column, source: Column, grid: int) -> Column:
    """The source coordinate of a grid coordinate."""
    return F.floor(i * source / grid).cast("int")


def _bits(bits: Column) -> Column:
    """A number from an array of 64 booleans, the first the lowest."""
    numbers = F.transform(bits, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def dhash(grid: Column) -> Column:
    """Of an array of 8 rows of 9 luminances: bit 8y+x is set if a value is larger than the next in its row."""
    at = lambda k: F.element_at(grid, (k + 1).cast("int"))
    return _bits(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(i + F.floor(i / 8)) > at(i + F.floor(i / 8) + 1)))


def ahash(grid: Column) -> Column:
    """Of an array of 64 luminances: bits of values over the mean, rounded down."""
    mean = F.floor(F.aggregate(grid, F.lit(0).cast("long"), lambda a, x: a + x) / 64)
    return _bits(F.transform(grid, lambda x: x > mean))


def confidence(distance: Column) -> Column:
    """Percent of the 64 bits that agree."""
    return (1 - distance / 64.0) * 100


def difference(conf: Column) -> Column:
    return F.round(100 - F.coalesce(conf, F.lit(100.0)), 1)


def quality_score(width: Column, height: Column, size: Column, dated: Column, placed: Column, camera: Column, lens: Column, described: Column) -> Column:
    """0 to 100, rounded down: resolution to 30, file size to 15, then what is known of the picture."""
    positive = lambda x: F.greatest(F.lit(0.0), x)
    pixels = F.when((width > 0) & (height > 0), positive(F.least(F.lit(30.0), F.log2(width.cast("double") * height / 1_000_000) * 7.5))).otherwise(0.0)
    weight = F.when(size > 0, positive(F.least(F.lit(15.0), F.log2(size.cast("double") / 1048576) * 3))).otherwise(0.0)
    flag = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    total = pixels + weight + flag(dated, 20) + flag(placed, 15) + flag(camera, 5) + flag(lens, 5) + flag(described, 10)
    # the logarithm of a power of two must not fall just short
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.round(total, 9)).cast("int")))


def quality_color(score: Column) -> Column:
    low = F.format_string("rgb(255,%d,60)", F.round(5.1 * score).cast("long"))
    return F.when(score <= 50, low).otherwise(F.format_string("rgb(%d,255,60)", F.round(5.1 * (100 - score)).cast("long")))


def thumbnail_side(side: Column, other: Column, most: int = 400) -> Column:
    """The length of ``side`` if the longer side is at most ``most``; at least 1."""
    long = F.greatest(side, other)
    return F.when(long <= most, side).otherwise(F.greatest(F.lit(1), F.floor(side * most / long))).cast("long")


def format_bytes(n: Column) -> Column:
    unit = F.least(F.lit(4), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1)
    scaled = n / F.pow(F.lit(1024.0), unit)
    text = F.when(unit == 0, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", scaled), F.lit(" "), name))
    return F.when(n.isNull(), "--").when(n == 0, "0 B").otherwise(text)


def format_duration(ms: Column) -> Column:
    whole = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), (whole % 60).cast("long")))


def format_gps(lat: Column, lon: Column) -> Column:
    known = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return F.when(known, F.format_string("%.4f, %.4f", lat, lon)).otherwise("--")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
