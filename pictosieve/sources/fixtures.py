"""Photo libraries made of ordinary tables, so that the finder's queries run where there are no image files.

Texts stand for file contents, and their characters, laid out as rows of a raster, for luminances. Each
view has a DataFrame and, for comparison, the same as a common table expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import aspect_bucket
from ..storage import cut

EXTENSIONS = (".jpg", ".JPG", ".png", ".tiff", ".tif", ".bmp", ".webp", ".jpeg", ".heic", ".txt")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, ext, size, width, height, text."""
    i = F.col("doc_id")
    folder = F.when(i % 17 == 0, "/.thumbs").when(i % 5 == 0, "/sub").otherwise("")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 10 + 1).cast("int"))
    name = F.concat(F.when(i % 3 == 0, "img_").otherwise("IMG_"), F.lpad(i.cast("string"), 6, "0"))
    n = F.length("text")
    side = n * F.when(F.col("lang") == "en", 4.0).when(F.col("lang") == "fr", 16.0).when(F.col("lang") == "de", 1.0).otherwise(3.0)
    width = F.greatest(F.lit(1), F.floor(F.sqrt(side / F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "fr", 9.0).when(F.col("lang") == "de", 1.0).otherwise(2.0)))).cast("long")
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    out = docs.select("doc_id", F.concat(F.lit("/library/"), "source", folder, F.lit("/"), name, ext).alias("path"), ext.alias("ext"), F.octet_length("text").cast("long").alias("size"), width.alias("width"), n.alias("n"), "text")
    return out.withColumn("height", F.floor(F.col("n") / F.col("width")).cast("long")).drop("n")


PHOTO_FILES = f"""
photo_files AS (SELECT *, n // width AS height FROM (
  SELECT doc_id, '/library/' || source || CASE WHEN doc_id % 17 = 0 THEN '/.thumbs' WHEN doc_id % 5 = 0 THEN '/sub' ELSE '' END || '/' || CASE WHEN doc_id % 3 = 0 THEN 'img_' ELSE 'IMG_' END || lpad(doc_id::VARCHAR, 6, '0') || ext AS path,
         ext, octet_length(encode(text))::BIGINT AS size, length(text) AS n, greatest(1, floor(sqrt(length(text) * num / den)))::BIGINT AS width, text
  FROM (SELECT *, [{", ".join(f"'{e}'" for e in EXTENSIONS)}][doc_id % 10 + 1] AS ext,
        CASE lang WHEN 'en' THEN 4e0 WHEN 'fr' THEN 16e0 WHEN 'de' THEN 1e0 ELSE 3e0 END AS num, CASE lang WHEN 'en' THEN 3e0 WHEN 'fr' THEN 9e0 WHEN 'de' THEN 1e0 ELSE 2e0 END AS den FROM documents WHERE text IS NOT NULL)))"""


#: Before a single number, so that one that looks like it is not taken for it.
_ORDER_MARK = bytearray(b"\0\0\xfe\xff")


def _at(wide: Column, place: Column) -> Column:
    """The number of the character at a place from 1 of a text in four bytes a character, or 0 beyond its end."""
    one = F.decode(F.concat(F.lit(_ORDER_MARK), F.substring(wide, (4 * place - 3).cast("int"), F.lit(4))), "UTF-32")
    return F.ascii(one).cast("long")


def photo_grid(photos: DataFrame) -> DataFrame:
    """Adds grid: 8 rows of 9 luminances."""

    def cell(wide: Column, k: Column) -> Column:
        y, x = F.floor(k / 9), k % 9
        return _at(wide, (F.floor(y * F.col("height") / 8) * F.col("width") + F.floor(x * F.col("width") / 9) + 1).cast("int"))

    # a text is widened once and then read at any place; a place in UTF-8 is counted from the text's begin
    wide = F.array(F.encode("text", "UTF-32"))
    return photos.withColumn("grid", F.transform(wide, lambda w: F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: cell(w, k)))[0])


#: Bytes of texts whose characters are placed at once.
PLACED = 1 << 18


def _dhashes(text: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """See ``photo_dhash``; characters are compared by their bytes, whose order is that of their numbers."""
    (y, x), lead = np.divmod(np.arange(72), 9), np.arange(256)
    own = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [0xFF000000, 0xFFFF0000, 0xFFFFFF00], 0xFFFFFFFF).astype(np.uint32)
    text = text.cast("large_string")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    w, h = (pc.fill_null(side.cast("int64"), 0).to_numpy(zero_copy_only=False)[:, None] for side in (width, height))
    out, at = np.zeros(len(text), np.int64), 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PLACED, side="right")) - 1)
        some = np.concatenate([data[ends[at] : ends[to]], np.zeros(4, np.uint8)])
        starts = np.flatnonzero((some & 0xC0) != 0x80)  # the last four are of no text
        first = np.searchsorted(starts, ends[at : to + 1] - ends[at])[:, None]
        place = first[:-1] + (y * h[at:to] >> 3) * w[at:to] + x * w[at:to] // 9
        p = starts[np.minimum(place, len(starts) - 4)]
        light = sum(some[p + k].astype(np.uint32) << np.uint32(24 - 8 * k) for k in range(4)) & own[some[p]]
        light[place >= first[1:]] = 0  # beyond the end of a text
        light = light.reshape(-1, 8, 9)
        out[at:to] = np.packbits((light[:, :, :-1] > light[:, :, 1:]).reshape(-1, 64), axis=1, bitorder="little").view(np.int64)[:, 0]
        at = to
    return pa.array(out)


def photo_dhash() -> Column:
    """The ``dhash`` of ``photo_grid`` without the grid, in Arrow batches: a lambda is not compiled and takes most of the time of hashing."""

    def of(text: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        return _dhashes(text, width, height)

    return F.arrow_udf(of, "long")("text", "width", "height")


PHOTO_GRID = """
photo_grid AS (SELECT doc_id, k // 9 AS y, k % 9 AS x, unicode(substr(text, ((k // 9) * height // 8) * width + ((k % 9) * width) // 9 + 1, 1))::BIGINT AS lum FROM photo_files, range(72) r(k)),
d_hashes AS (SELECT doc_id, sum(CASE WHEN lum > nxt THEN (1::HUGEINT << (8 * y + x)::INT) ELSE 0 END) AS h FROM (SELECT *, lead(lum) OVER (PARTITION BY doc_id, y ORDER BY x) AS nxt FROM photo_grid) WHERE x < 8 GROUP BY doc_id)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo files with digest, d_hash, bucket, and what else a picture's header tells."""
    i = F.col("doc_id")
    # hashing and texts of numbers are the dear part and their result is small: it is stored once, as a scan's cache is
    listed = photo_files(spark, sf_dir)
    known = listed.withColumn("digest", F.sha2("text", 256)).withColumn("d_hash", photo_dhash()).drop("text")
    minutes = F.timestamp_seconds(F.lit(1577836800) + i * 60)
    out = known.select(
        "doc_id", "path", "ext", "size", "width", "height", "digest", "d_hash", aspect_bucket(F.col("width"), F.col("height")).alias("bucket"),
        F.when(i % 7 == 0, "").otherwise(F.date_format(minutes, "yyyy-MM-dd'T'HH:mm:ss")).alias("date_taken"),
        F.when(i % 6 == 0, i / 100).otherwise(F.lit(0.0)).alias("gps_lat"), F.when(i % 6 == 0, i / 200).otherwise(F.lit(0.0)).alias("gps_lon"),
        F.when(i % 3 == 0, "Acme X1").otherwise("").alias("camera"), F.when(i % 4 == 0, "50mm").otherwise("").alias("lens"), F.when(i % 10 == 0, "note").otherwise("").alias("description"),
    )
    return cut(spark, out)


_ASPECT = "CASE WHEN width > 0 AND height > 0 THEN printf('%.2f', round(greatest(width, height)::DOUBLE / least(width, height) * 20) / 20) ELSE 'unknown' END"
_SCORE = """least(100, greatest(0, floor(round(
  CASE WHEN width > 0 AND height > 0 THEN greatest(0, least(30, log2(width::DOUBLE * height / 1000000) * 7.5::DOUBLE)) ELSE 0 END + CASE WHEN size > 0 THEN greatest(0, least(15, log2(size::DOUBLE / 1048576) * 3)) ELSE 0 END
  + CASE WHEN date_taken <> '' THEN 20 ELSE 0 END + CASE WHEN gps_lat <> 0 AND gps_lon <> 0 THEN 15 ELSE 0 END + CASE WHEN camera <> '' THEN 5 ELSE 0 END + CASE WHEN lens <> '' THEN 5 ELSE 0 END + CASE WHEN description <> '' THEN 10 ELSE 0 END, 9))::INT))"""

PHOTOS = f"""{PHOTO_FILES},{PHOTO_GRID},
photos AS (SELECT f.doc_id, path, ext, size, width, height, sha256(text) AS digest, h AS d_hash, {_ASPECT} AS bucket,
  CASE WHEN f.doc_id % 7 = 0 THEN '' ELSE strftime(make_timestamp((1577836800 + f.doc_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') END AS date_taken,
  CASE WHEN f.doc_id % 6 = 0 THEN f.doc_id / 100 ELSE 0 END::DOUBLE AS gps_lat, CASE WHEN f.doc_id % 6 = 0 THEN f.doc_id / 200 ELSE 0 END::DOUBLE AS gps_lon,
  CASE WHEN f.doc_id % 3 = 0 THEN 'Acme X1' ELSE '' END AS camera, CASE WHEN f.doc_id % 4 = 0 THEN '50mm' ELSE '' END AS lens, CASE WHEN f.doc_id % 10 = 0 THEN 'note' ELSE '' END AS description
  FROM photo_files f JOIN d_hashes USING (doc_id))"""

#: Threshold of the groups below, so that they are not trivial.
THRESHOLD = 18


def groups_sql(threshold: int = THRESHOLD, exclude_exact: bool = True) -> str:
    """Common table expressions ending in ``members``: path, group_path, match_type, confidence, min_distance, and ``images``."""
    rest = "SELECT * FROM photos WHERE path NOT IN (SELECT path FROM exact)" if exclude_exact else "SELECT * FROM photos"
    return f"""{PHOTOS},
exact AS (SELECT path, min(path) OVER (PARTITION BY digest) AS group_path FROM photos QUALIFY count(*) OVER (PARTITION BY digest) > 1),
rest AS ({rest}),
pairs AS (SELECT a.path AS a, b.path AS b, bit_count(xor(a.d_hash, b.d_hash))::INT AS distance FROM rest a JOIN rest b ON a.bucket = b.bucket AND a.path < b.path WHERE a.d_hash <> 0 AND b.d_hash <> 0 AND bit_count(xor(a.d_hash, b.d_hash)) <= {threshold}),
links AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT u, u AS v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
roots AS (SELECT u AS path, min(v) AS group_path FROM reach GROUP BY u),
near AS (SELECT path, group_path, min_distance FROM roots JOIN (SELECT group_path, min(distance) AS min_distance FROM pairs JOIN roots ON a = path GROUP BY group_path) USING (group_path)),
parts AS (SELECT n.*, regexp_extract(regexp_extract(path, '[^/]*$'), '^(.*?)(\\d+)\\.[^.]*$', 1) AS stem, try_cast(regexp_extract(regexp_extract(path, '[^/]*$'), '^(.*?)(\\d+)\\.[^.]*$', 2) AS BIGINT) AS number, date_taken, camera FROM near n JOIN photos USING (path)),
gaps AS (SELECT *, number - lag(number) OVER (PARTITION BY group_path ORDER BY number) AS gap FROM parts),
kinds AS (SELECT group_path, count(number) = count(*) AND count(DISTINCT lower(stem)) = 1 AND max(gap) <= 5 AS by_name,
  count(*) FILTER (date_taken <> '' AND camera <> '') = count(*) AND count(DISTINCT camera) = 1 AND date_diff('second', min(try_cast(nullif(date_taken, '') AS TIMESTAMP)), max(try_cast(nullif(date_taken, '') AS TIMESTAMP))) <= 60 AS by_time FROM gaps GROUP BY group_path),
members AS (SELECT path, group_path, 'exact' AS match_type, 100e0 AS confidence, NULL::INT AS min_distance, false AS by_name FROM exact
  UNION ALL SELECT path, group_path, CASE WHEN (1 - min_distance / 64e0) * 100 >= 95 AND (by_name OR by_time) THEN 'series' ELSE 'perceptual' END, (1 - min_distance / 64e0) * 100, min_distance, by_name FROM near JOIN kinds USING (group_path)),
images AS (SELECT *, row_number() OVER (PARTITION BY group_path ORDER BY quality_score DESC, path) AS rank, substr(sha256(match_type || ':' || group_path), 1, 16) AS group_id FROM (SELECT m.*, p.* EXCLUDE (path), {_SCORE} AS quality_score FROM members m JOIN photos p USING (path)))"""


def embed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grid: 64 luminances of an embedding."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 32767).cast("long")).alias("grid"))


EMBED_GRID = "embed_grid AS (SELECT vec_id, i - 1 AS i, floor((embedding[i]::DOUBLE + 1) * 32767)::BIGINT AS lum FROM embeddings, range(1, 65) r(i))"


def large(photos_: DataFrame) -> DataFrame:
    """Photos of at least 16 by 16."""
    return photos_.where((F.col("width") >= 16) & (F.col("height") >= 16))


def photo_raster(photos_: DataFrame) -> DataFrame:
    """image, y, x, gray of all pixels of photos of at least 16 by 16."""
    rows = large(photos_).select("doc_id", "width", "text", F.explode(F.sequence(F.lit(0), (F.col("height") - 1).cast("int"))).alias("y"))
    line = rows.select("doc_id", "y", F.substr(F.col("text"), (F.col("y") * F.col("width") + 1).cast("int"), F.col("width").cast("int")).alias("line"))
    return line.select("doc_id", "y", F.posexplode(F.split("line", "")).alias("x", "c")).where(F.col("c") != "").select("doc_id", "y", "x", F.ascii("c").cast("long").alias("gray"))


PHOTO_RASTER = "photo_raster AS (SELECT doc_id, k // width AS y, k % width AS x, unicode(text[k + 1])::BIGINT AS gray FROM (SELECT *, unnest(range(0, width * height)) AS k FROM photo_files WHERE width >= 16 AND height >= 16))"


def order_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture an order, a group a customer."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    both = o.join(c, o["o_custkey"] == c["c_custkey"])
    first = F.col("o_orderpriority") == "1-URGENT"
    return both.select(
        F.col("o_orderkey").alias("photo_id"), F.col("o_custkey").alias("group_id"), (500 + F.col("o_custkey") % 6000).alias("width"), (400 + F.col("o_orderkey") % 4000).alias("height"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("size"), F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("date_taken"),
        F.when(F.col("c_nationkey") < 12, F.col("c_acctbal").cast("double") / 100).otherwise(0.0).alias("gps_lat"), F.when(F.col("c_nationkey") < 12, 1.0).otherwise(0.0).alias("gps_lon"),
        F.when(first | (F.col("o_orderpriority") == "2-HIGH"), "Acme X1").otherwise("").alias("camera"), F.when(first, "50mm").otherwise("").alias("lens"), F.when(F.col("c_mktsegment") == "BUILDING", "note").otherwise("").alias("description"),
    )


ORDER_PHOTOS = f"""
order_photos AS (SELECT *, {_SCORE} AS quality_score FROM (SELECT o_orderkey AS photo_id, o_custkey AS group_id, 500 + o_custkey % 6000 AS width, 400 + o_orderkey % 4000 AS height, floor(o_totalprice * 100)::BIGINT AS size,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::VARCHAR ELSE '' END AS date_taken, CASE WHEN c_nationkey < 12 THEN c_acctbal::DOUBLE / 100 ELSE 0 END AS gps_lat, CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS gps_lon,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Acme X1' ELSE '' END AS camera, CASE WHEN o_orderpriority = '1-URGENT' THEN '50mm' ELSE '' END AS lens, CASE WHEN c_mktsegment = 'BUILDING' THEN 'note' ELSE '' END AS description
  FROM orders JOIN customer ON o_custkey = c_custkey))"""


def burst_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("l_returnflag") == "N", "DSC").when(F.col("l_returnflag") == "A", "IMG_").otherwise("img_")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.concat(prefix, F.lpad((F.col("l_suppkey") % 50).cast("string"), 4, "0"), F.lit(".jpg")).alias("filename"))


def burst_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return read(spark, sf_dir, "events").select(F.floor(seconds / 300).cast("long").alias("group_id"), F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("taken"))


def hash_caches(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two stored tables of digests: the first with some stale sizes, the second with other digests."""
    i, stored = F.col("doc_id"), files.select("doc_id", "path", "size", F.sha2("text", 256).alias("digest"))
    first = stored.where(i % 2 == 0).select("path", F.when(i % 8 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "digest")
    second = stored.where(i % 3 == 0).select("path", "size", F.concat(F.lit("other:"), "digest").alias("digest"))
    return first, second


HASH_CACHES = """
first_cache AS (SELECT path, CASE WHEN doc_id % 8 = 0 THEN size + 1 ELSE size END AS size, sha256(text) AS digest FROM photo_files WHERE doc_id % 2 = 0),
second_cache AS (SELECT path, size, 'other:' || sha256(text) AS digest FROM photo_files WHERE doc_id % 3 = 0),
merged AS (SELECT * FROM first_cache UNION ALL SELECT * FROM second_cache WHERE path NOT IN (SELECT path FROM first_cache))"""
