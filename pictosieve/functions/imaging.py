"""What image files tell: dimensions, EXIF fields, previews inside raw files, hashes of decoded pixels.

Headers are parsed in Arrow batches of the files' first bytes; pixels come from Spark's image source.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import ahash, dhash, thumbnail_side

#: Bytes of a file in which its header is looked for.
HEADER = 131072
#: Size under which a preview is taken only if there is no larger one, and how far it is looked for.
PREVIEW, PREVIEW_WITHIN = 10 * 1024, 50 << 20
#: Longest side of the raster that blockiness and blurring are measured on, and the shortest side that is measured.
RASTER, LEAST_SIDE = 512, 16

HEADER_SCHEMA = "width int, height int, date_taken string, gps_lat double, gps_lon double, camera string, lens string, iso int, focal_length string, description string"
#: EXIF tag numbers.
_TAGS = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0132: "modified", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0xA434: "lens", 0x8769: "exif", 0x8825: "gps", 0x0100: "width", 0x0101: "height"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
#: Bytes of the TIFF field types.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, GIF, BMP, JPEG, WebP or TIFF file."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if data[:4] in (b"II*\0", b"MM\0*"):
            found = _directory(data, struct.unpack(("<" if data[:1] == b"I" else ">") + "I", data[4:8])[0], "<" if data[:1] == b"I" else ">", _TAGS)
            return int(found["width"]), int(found["height"])
    except (struct.error, KeyError, IndexError, ValueError):
        pass
    return None


def _directory(data: bytes, at: int, order: str, names: dict[int, str]) -> dict[str, object]:
    """The named fields of a TIFF directory."""
    out: dict[str, object] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if tag not in names or kind not in _SIZES or n > 4096:
            continue
        size = _SIZES[kind] * n
        raw = entry[8 : 8 + size] if size <= 4 else data[(where := struct.unpack(order + "I", entry[8:12])[0]) : where + size]
        if len(raw) < size:
            continue
        if kind in (1, 2, 7):
            out[names[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            values = struct.unpack(order + ("i" if kind == 10 else "I") * 2 * n, raw)
            out[names[tag]] = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)]
        else:
            values = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw)
            out[names[tag]] = values[0] if values else 0
    return out


def exif(data: bytes) -> dict[str, object]:
    """EXIF fields, as far as they are there."""
    at = data.find(b"Exif\0\0")
    base = data[at + 6 :] if at >= 0 else data if data[:4] in (b"II*\0", b"MM\0*") else b""
    if len(base) < 8:
        return {}
    order, out, gps = "<" if base[:1] == b"I" else ">", {}, {}
    try:
        main = _directory(base, struct.unpack(order + "I", base[4:8])[0], order, _TAGS)
        if isinstance(main.get("exif"), int):
            main |= _directory(base, main["exif"], order, _TAGS)
        if isinstance(main.get("gps"), int):
            gps = _directory(base, main["gps"], order, _GPS)
    except (struct.error, IndexError):
        return {}
    taken = str(main.get("taken") or main.get("modified") or "")
    if len(taken) >= 19 and taken[4:5] == ":":
        out["date_taken"] = f"{taken[:4]}-{taken[5:7]}-{taken[8:10]}T{taken[11:19]}"
    out["camera"] = f"{main.get('make', '')} {main.get('model', '')}".strip()
    out["lens"], out["description"] = str(main.get("lens", "")), str(main.get("description", ""))
    if isinstance(main.get("iso"), int):
        out["iso"] = main["iso"]
    if isinstance(main.get("focal"), list) and main["focal"]:
        out["focal_length"] = f"{main['focal'][0]:.1f}mm"
    for name, minus in (("lat", "S"), ("lon", "W")):
        x = gps.get(name)
        if isinstance(x, list) and len(x) == 3:
            out[f"gps_{name}"] = (x[0] + x[1] / 60 + x[2] / 3600) * (-1 if gps.get(f"{name}_ref") == minus else 1)
    return out


def header(content: Column) -> Column:
    """A struct of ``HEADER_SCHEMA`` from a file's first bytes; what is not known is null."""
    names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]

    @F.pandas_udf(HEADER_SCHEMA)
    def parse(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in heads:
            rows = []
            for data in some:
                data = bytes(data or b"")
                size = dimensions(data) or (None, None)
                rows.append({"width": size[0], "height": size[1]} | exif(data))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return parse(F.substring(content, 1, HEADER))


def preview_of(data: bytes) -> bytes | None:
    """The largest JPEG inside a raw file that has dimensions; a small one only if there is no other."""
    best, small, at, data = None, None, 2, data[:PREVIEW_WITHIN]
    while (start := data.find(b"\xff\xd8", at)) >= 0 and (end := data.find(b"\xff\xd9", start + 2)) >= 0:
        part, at = data[start : end + 2], start + 1
        if len(part) < PREVIEW:
            small = small or part
        elif dimensions(part):
            best, at = max(best or b"", part, key=len), end + 2
    return best or small


@F.pandas_udf(T.BinaryType())
def preview(content: pd.Series) -> pd.Series:
    return content.map(lambda x: preview_of(bytes(x or b"")))


def _path(origin: Column) -> Column:
    """The path as the file source has it, from the escaped address that the image source gives."""
    return F.url_decode(F.replace(F.regexp_replace(origin, "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def literal(path: str) -> str:
    """The path with what a reader would take for a pattern escaped."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def decoded(spark: SparkSession, *paths: str) -> DataFrame:
    """path, width, height, d_hash, a_hash of images that the JVM can decode (JPEG, PNG, BMP, GIF, TIFF)."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(paths))
    pixels = images.select(_path(F.col("image.origin")).alias("path"), "image.width", "image.height", "image.nChannels", "image.data")

    def grid(across: int, down: int) -> Column:
        """Luminances of 16-bit channels at the nearest pixels; the data are rows of blue, green, red (and alpha)."""

        def lum(k: Column) -> Column:
            x, y = F.floor((k % across) * F.col("width") / across), F.floor(F.floor(k / across) * F.col("height") / down)
            at = ((y * F.col("width") + x) * F.col("nChannels")).cast("int")
            byte = lambda i: F.conv(F.hex(F.substr(F.col("data"), at + 1 + i, F.lit(1))), 16, 10).cast("long") * 257
            one = F.col("nChannels") == 1
            alpha = F.when(F.col("nChannels") == 4, byte(3)).otherwise(65535)
            seen = lambda i: F.floor(byte(F.when(one, 0).otherwise(i)) * alpha / 65535)
            return F.floor((299 * seen(2) + 587 * seen(1) + 114 * seen(0)) / 1000).cast("long")

        return F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), lum)

    return pixels.withColumn("g9", grid(9, 8)).withColumn("g8", grid(8, 8)).select("path", "width", "height", dhash(F.col("g9")).alias("d_hash"), ahash(F.col("g8")).alias("a_hash"))


def rasters(spark: SparkSession, *paths: str) -> DataFrame:
    """path, y, x, gray (0 to 255): nearest pixels of pictures, the longer side at most ``RASTER``; small pictures have none."""
    @F.pandas_udf("array<array<double>>")
    def lines(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, w, h, c in zip(data, width, height, channels, strict=True):
            ratio = min(1.0, RASTER / max(w, h))
            tw, th = int(w * ratio), int(h * ratio)
            source = np.frombuffer(bytes(d), np.uint8).reshape(h, w, c)
            some = source[np.arange(th) * h // th][:, np.arange(tw) * w // tw].astype(np.int64) * 257
            if c == 4:
                some = some[..., :3] * some[..., 3:] // 65535
            bgr = some[..., :3] if c > 1 else np.repeat(some, 3, axis=2)
            out.append(((299 * bgr[..., 2] + 587 * bgr[..., 1] + 114 * bgr[..., 0]) / 1000 / 256).tolist())
        return pd.Series(out)

    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(paths))
    big = images.where(f"image.width >= {LEAST_SIDE} AND image.height >= {LEAST_SIDE}")
    rows = big.select(_path(F.col("image.origin")).alias("path"), F.posexplode(lines("image.data", "image.width", "image.height", "image.nChannels")).alias("y", "line"))
    return rows.select("path", "y", F.posexplode("line").alias("x", "gray"))


def _png(pixels: np.ndarray) -> bytes:
    """Rows of red, green, blue as a PNG file."""
    h, w, _ = pixels.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def thumbnails(spark: SparkSession, *paths: str, most: int = 400) -> DataFrame:
    """path, width, height, thumbnail: a PNG of nearest pixels, its longer side at most ``most``, as base64."""

    @F.pandas_udf(T.BinaryType())
    def shrink(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for d, sw, sh, c, tw, th in zip(data, width, height, channels, w, h, strict=True):
            source = np.frombuffer(bytes(d), np.uint8).reshape(sh, sw, c)
            some = source[np.arange(th) * sh // th][:, np.arange(tw) * sw // tw]
            out.append(_png(np.ascontiguousarray(some[..., 2::-1] if c > 1 else np.repeat(some, 3, axis=2))))
        return pd.Series(out)

    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(paths))
    pixels = images.select(_path(F.col("image.origin")).alias("path"), F.col("image.data").alias("data"), F.col("image.width").alias("sw"), F.col("image.height").alias("sh"), F.col("image.nChannels").alias("c"))
    sized = pixels.withColumn("width", thumbnail_side(F.col("sw"), F.col("sh"), most)).withColumn("height", thumbnail_side(F.col("sh"), F.col("sw"), most))
    return sized.select("path", "width", "height", F.base64(shrink("data", "sw", "sh", "c", "width", "height")).alias("thumbnail"))
