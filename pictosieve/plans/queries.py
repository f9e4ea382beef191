"""The finder's queries by name, over ordinary tables, and each one's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import exact, groups, raster, results, series, similarity
from ..request import SUPPORTED, FilterSpec, ScanRequest, SortSpec
from ..sources import cache, files
from ..sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$', 1))"
_KNOWN = f"{_EXT} IN ({', '.join(repr(e) for e in SUPPORTED)})"
_VISIBLE = "NOT regexp_matches(substr(path, 9), '/\\.[^/]+/')"
_COLS = "path, ext, size, width, height"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return X.photo_files(spark, d)


def _cols(df: DataFrame) -> DataFrame:
    return df.select("path", "ext", "size", "width", "height")


# ---- scans


@query(f"WITH {X.PHOTO_FILES} SELECT {_COLS} FROM photo_files WHERE {_KNOWN} AND {_VISIBLE}")
def scan_supported_files(spark: SparkSession, d: str) -> DataFrame:
    return _cols(files.select(_listed(spark, d), ScanRequest("/library")).orderBy("path"))


@query(f"WITH {X.PHOTO_FILES} SELECT {_COLS} FROM photo_files WHERE {_EXT} IN ('.jpg', '.png', '.heic') AND {_VISIBLE} AND size BETWEEN 500 AND 4000 AND width >= 20 AND height <= 60")
def scan_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked = ScanRequest.of("/library", extensions=("JPG", " png ", ".heic"), min_file_size=500, max_file_size=4000, min_width=20, max_height=60)
    return _cols(files.select(_listed(spark, d), asked))


@query(f"WITH {X.PHOTO_FILES} SELECT {_COLS} FROM photo_files WHERE {_KNOWN} AND {_VISIBLE} AND NOT contains(substr(path, 15), '/') AND path LIKE '/library/src1/%'")
def scan_flat(spark: SparkSession, d: str) -> DataFrame:
    return _cols(files.select(_listed(spark, d), ScanRequest("/library/src1", include_subfolders=False)))


@query(f"WITH {X.PHOTO_FILES} SELECT {_COLS} FROM photo_files WHERE {_KNOWN} AND {_VISIBLE} AND (path LIKE '/library/src1/%' OR path LIKE '/library/src2/%')")
def scan_multi_root_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _cols(files.select(_listed(spark, d), ScanRequest.of("/library/src1; /library/src2 ;/library/src1;")))


@query(f"WITH {X.PHOTO_FILES} SELECT path, regexp_extract(path, '[^/]*$') AS name, {_EXT} AS extension, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem, "
       "CASE WHEN len(string_split(path, '/')) <= 3 THEN path ELSE '.../' || array_to_string(string_split(path, '/')[-2:], '/') END AS short FROM photo_files")  # fmt: skip
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _listed(spark, d).select("path", S.base_name(p).alias("name"), S.extension(p).alias("extension"), S.parent(p).alias("folder"), S.stem(p).alias("stem"), S.short_path(p).alias("short"))


# ---- exact copies


@query(f"WITH {X.PHOTO_FILES} SELECT size, count(*) AS files FROM photo_files WHERE size > 0 GROUP BY size HAVING count(*) > 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return exact.size_buckets(_listed(spark, d))


@query(f"WITH {X.PHOTO_FILES} SELECT path, size FROM photo_files QUALIFY count(*) OVER (PARTITION BY size) = 1")
def size_singletons(spark: SparkSession, d: str) -> DataFrame:
    return exact.size_singletons(_listed(spark, d)).select("path", "size")


@query(f"WITH {X.PHOTO_FILES} SELECT path, size, sha256(substr(text, 1, 64)) AS head FROM photo_files QUALIFY count(*) OVER (PARTITION BY size, substr(text, 1, 64)) > 1")
def partial_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    same_size = exact.candidates(_listed(spark, d), "size")
    return exact.candidates(same_size.withColumn("head", F.sha2(F.substring("text", 1, 64), 256)), "size", "head").select("path", "size", "head")


def _exact(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_members(_listed(spark, d).withColumn("content", F.col("text").cast("binary")))


@query(f"WITH {X.PHOTO_FILES} SELECT path, sha256(text) AS digest, min(path) OVER (PARTITION BY text) AS group_path FROM photo_files QUALIFY count(*) OVER (PARTITION BY text) > 1")
def exact_members(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d).select("path", "digest", "group_path")


@query(f"WITH {X.PHOTO_FILES} SELECT sha256(text) AS digest, min(path) AS group_path, count(*) AS files, sum(size)::BIGINT AS bytes FROM photo_files GROUP BY text HAVING count(*) > 1")
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d).groupBy("digest", "group_path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# ---- stored hashes


@query(f"WITH {X.PHOTO_FILES},{X.HASH_CACHES} SELECT path, size, digest FROM photo_files JOIN first_cache USING (path, size)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    photos = _listed(spark, d)
    return cache.hits(photos, X.hash_caches(photos)[0]).select("path", "size", "digest")


@query(f"WITH {X.PHOTO_FILES},{X.HASH_CACHES} SELECT path, size FROM photo_files WHERE (path, size) NOT IN (SELECT (path, size) FROM first_cache)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    photos = _listed(spark, d)
    return cache.misses(photos, X.hash_caches(photos)[0]).select("path", "size")


@query(f"WITH {X.PHOTO_FILES},{X.HASH_CACHES} SELECT path, size, digest FROM merged")
def cache_merged(spark: SparkSession, d: str) -> DataFrame:
    return cache.merge(*X.hash_caches(_listed(spark, d))).select("path", "size", "digest")


def _assembled(photos: DataFrame) -> DataFrame:
    stored = cache.merge(*X.hash_caches(photos))
    found = cache.hits(photos, stored).select("path", "size", "digest", F.lit(True).alias("hit"))
    new = cache.misses(photos, stored).select("path", "size", F.sha2("text", 256).alias("digest"), F.lit(False).alias("hit"))
    return found.unionByName(new)


_ASSEMBLED = "assembled AS (SELECT f.path, f.size, coalesce(m.digest, sha256(text)) AS digest, m.path IS NOT NULL AS hit FROM photo_files f LEFT JOIN merged m ON f.path = m.path AND f.size = m.size)"


@query(f"WITH {X.PHOTO_FILES},{X.HASH_CACHES},{_ASSEMBLED} SELECT path, size, digest, hit FROM assembled")
def assemble_results(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(_listed(spark, d))


@query(f"WITH {X.PHOTO_FILES},{X.HASH_CACHES},{_ASSEMBLED} SELECT path, size, digest FROM assembled WHERE path LIKE '/library/src1/%' UNION ALL SELECT path, size, digest FROM merged WHERE path NOT LIKE '/library/src1/%'")
def cache_writeback(spark: SparkSession, d: str) -> DataFrame:
    photos = _listed(spark, d)
    fresh = _assembled(photos).where(F.col("path").startswith("/library/src1/"))
    return cache.updated(cache.merge(*X.hash_caches(photos)).select("path", "size", "digest"), fresh)


# ---- fingerprints and pairs


@query(f"WITH {X.PHOTO_FILES},{X.PHOTO_GRID} SELECT doc_id, printf('%016x', h::UBIGINT) AS d_hash FROM d_hashes")
def dhash_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return X.photo_grid(_listed(spark, d)).select("doc_id", S.hash_text(S.dhash(F.col("grid"))).alias("d_hash"))


_AHASH = f"{X.EMBED_GRID}, a_hashes AS (SELECT vec_id, sum(CASE WHEN lum > mean THEN (1::HUGEINT << i::INT) ELSE 0 END)::UBIGINT AS h FROM (SELECT *, sum(lum) OVER (PARTITION BY vec_id) // 64 AS mean FROM embed_grid) GROUP BY vec_id)"


@query(f"WITH {_AHASH} SELECT vec_id, printf('%016x', h) AS a_hash FROM a_hashes")
def ahash_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return X.embed_grid(spark, d).select("vec_id", S.hash_text(S.ahash(F.col("grid"))).alias("a_hash"))


@query(f"WITH {_AHASH} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM a_hashes a JOIN a_hashes b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 20")
def ahash_pairs(spark: SparkSession, d: str) -> DataFrame:
    hashed = X.embed_grid(spark, d).select(F.col("vec_id").alias("path"), F.lit("all").alias("bucket"), S.ahash(F.col("grid")).alias("d_hash"))
    return similarity.pairs_banded(hashed, 20)


@query(f"WITH {X.PHOTOS} SELECT bucket, count(*) AS photos FROM photos GROUP BY bucket")
def aspect_buckets(spark: SparkSession, d: str) -> DataFrame:
    return X.photos(spark, d).groupBy("bucket").agg(F.count("*").alias("photos"))


_PAIRS = f"WITH {X.PHOTOS}, pairs AS (SELECT a.path AS a, b.path AS b, bit_count(xor(a.d_hash, b.d_hash))::INT AS distance FROM photos a JOIN photos b ON a.bucket = b.bucket AND a.path < b.path WHERE a.d_hash <> 0 AND b.d_hash <> 0 AND bit_count(xor(a.d_hash, b.d_hash)) <= 10)"


@query(f"{_PAIRS} SELECT a, b, distance FROM pairs")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pairs(similarity.hashable(X.photos(spark, d)), 10)


@query(f"{_PAIRS} SELECT a, b, distance FROM pairs")
def hamming_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pairs_banded(similarity.hashable(X.photos(spark, d)), 10)


@query(f"{_PAIRS} SELECT distance, count(*) AS pairs FROM pairs GROUP BY distance")
def hamming_histogram(spark: SparkSession, d: str) -> DataFrame:
    return hamming_pairs(spark, d).groupBy("distance").agg(F.count("*").alias("pairs"))


# ---- groups


@query(f"WITH RECURSIVE {X.groups_sql(10, False)} SELECT path, group_path, min_distance::INT AS min_distance FROM near")
def perceptual_components(spark: SparkSession, d: str) -> DataFrame:
    return similarity.perceptual_members(spark, X.photos(spark, d), 10)


@query(f"WITH RECURSIVE {X.groups_sql()} SELECT path, group_path, match_type, confidence FROM members WHERE match_type <> 'exact'")
def perceptual_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.members(spark, X.photos(spark, d), X.THRESHOLD).where("match_type <> 'exact'")


@query("""WITH n AS (SELECT l_orderkey AS group_id, CASE l_returnflag WHEN 'N' THEN 'dsc' ELSE 'img_' END AS prefix, l_suppkey % 50 AS number FROM lineitem),
g AS (SELECT *, number - lag(number) OVER (PARTITION BY group_id ORDER BY number) AS gap FROM n)
SELECT group_id, count(*) > 1 AND count(DISTINCT prefix) = 1 AND coalesce(max(gap), 99) <= 5 AS by_name FROM g GROUP BY group_id""")
def filename_series(spark: SparkSession, d: str) -> DataFrame:
    return series.filename_series(X.burst_names(spark, d), "group_id", "filename")


@query("""WITH e AS (SELECT (floor(epoch(ts))::BIGINT // 300) AS group_id, event_type AS camera, ts FROM events)
SELECT group_id, count(*) > 1 AND count(DISTINCT camera) = 1 AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 60000000 AS by_time FROM e GROUP BY group_id""")
def time_camera_series(spark: SparkSession, d: str) -> DataFrame:
    return series.time_series(X.burst_times(spark, d), "group_id", F.col("taken"), F.col("camera"))


@query(f"""WITH RECURSIVE {X.groups_sql()} SELECT path, group_path, match_type, confidence FROM members
WHERE match_type = 'exact' OR match_type = 'perceptual' AND NOT (coalesce(min_distance, 99) <= {X.THRESHOLD // 2} AND coalesce(by_name, false))""")
def series_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return groups.members(spark, X.photos(spark, d), X.THRESHOLD, include_series=False)


@query(f"WITH RECURSIVE {X.groups_sql()} SELECT match_type, count(*) AS images, count(DISTINCT group_id) AS groups FROM images GROUP BY match_type")
def series_relabel(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).groupBy("match_type").agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))


def _images(spark: SparkSession, d: str, photos: DataFrame | None = None) -> DataFrame:
    photos = X.photos(spark, d) if photos is None else photos
    return groups.ranked(groups.members(spark, photos, X.THRESHOLD, keep=groups.IMAGE[1:]))


@query(f"WITH {X.ORDER_PHOTOS} SELECT photo_id, quality_score FROM order_photos")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    photos = X.order_photos(spark, d)
    return photos.select("photo_id", groups.score(photos).alias("quality_score"))


@query(f"WITH {X.ORDER_PHOTOS} SELECT group_id, photo_id, quality_score FROM order_photos QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, photo_id) = 1")
def quality_best(spark: SparkSession, d: str) -> DataFrame:
    photos = X.order_photos(spark, d)
    best = photos.groupBy("group_id").agg(F.max(F.struct(groups.score(photos).alias("s"), (-F.col("photo_id")).alias("i"))).alias("b"))
    return best.select("group_id", (-F.col("b.i")).alias("photo_id"), F.col("b.s").alias("quality_score"))


_G = f"WITH RECURSIVE {X.groups_sql()}"


@query(f"{_G} SELECT group_id, rank::INT AS rank, path, quality_score, rank = 1 AS is_best FROM images")
def group_images_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("group_id", "rank", "path", "quality_score", "is_best")


@query(f"""{_G} SELECT group_id, rank::INT AS rank, to_json({{'group_id': group_id, 'match_type': match_type, 'confidence': confidence, 'rank': rank, 'path': path, 'filename': regexp_extract(path, '[^/]*$'),
  'size': size, 'width': width, 'height': height, 'quality_score': quality_score, 'is_best': rank = 1}})::VARCHAR AS json FROM images""")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    return groups.json_lines(_images(spark, d))


_SUMS = "sums AS (SELECT group_id, match_type, confidence, count(*) AS images, coalesce(sum(size) FILTER (rank > 1), 0)::BIGINT AS wasted_bytes, max(path) FILTER (rank = 1) AS best FROM images GROUP BY ALL)"


@query(f"{_G}, {_SUMS} SELECT * FROM sums")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.summaries(_images(spark, d))


@query(f"{_G} SELECT match_type, sum(size)::BIGINT AS wasted_bytes FROM images WHERE rank > 1 GROUP BY match_type")
def wasted_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).where("rank > 1").groupBy("match_type").agg(F.sum("size").alias("wasted_bytes"))


@query(f"{_G} SELECT (SELECT count(*) FROM photos) AS total_files, count(DISTINCT group_id) AS duplicate_groups, coalesce(sum(size) FILTER (rank > 1), 0)::BIGINT AS wasted_bytes FROM images")
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    photos = X.photos(spark, d)
    exact, near = groups.linked(spark, photos, X.THRESHOLD, keep=groups.IMAGE[1:])
    return groups.stats_of_members(photos, exact.unionByName(near.drop("min_distance")))


@query(f"{_G} SELECT DISTINCT path FROM images")
def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("path").distinct()


# ---- picture quality


@query(f"""WITH {X.PHOTO_FILES}, {X.PHOTO_RASTER}, s AS (SELECT *, abs(gray - lag(gray) OVER (PARTITION BY doc_id, y ORDER BY x)) AS step FROM photo_raster)
SELECT doc_id, CASE WHEN avg(step) < 0.01 THEN 0 ELSE round(greatest(0, (sum(step) FILTER (x % 8 = 0) / count(step) FILTER (x % 8 = 0)) / (sum(step) / count(step)) - 1) * 100, 2) END::DOUBLE AS blockiness FROM s WHERE y >= 1 AND x >= 1 GROUP BY doc_id""")
def blockiness(spark: SparkSession, d: str) -> DataFrame:
    return raster.blockiness(X.photo_raster(_listed(spark, d)), "doc_id")


@query(f"""WITH {X.PHOTO_FILES}, {X.PHOTO_RASTER}, s AS (SELECT doc_id, lag(gray) OVER r + lead(gray) OVER r + lag(gray) OVER c + lead(gray) OVER c - 4 * gray AS l FROM photo_raster
  WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y)),
v AS (SELECT doc_id, sum(l * l) / count(l) - (sum(l) / count(l)) * (sum(l) / count(l)) AS v FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN v < 0.01 THEN 100 ELSE round(greatest(0, least(100, 100 - 0.2::DOUBLE * v)), 2) END::DOUBLE AS blurring FROM v""")
def blurring(spark: SparkSession, d: str) -> DataFrame:
    return raster.blurring_whole(X.large(_listed(spark, d)), "doc_id")


# ---- views of a result


def _narrowed(where: str, group: str = "true") -> str:
    return f"{_G} SELECT group_id, path FROM images WHERE {where} QUALIFY count(*) OVER (PARTITION BY group_id) >= 2 AND {group}"


def _narrow(spark: SparkSession, d: str, **spec: object) -> DataFrame:
    return results.narrow(_images(spark, d), FilterSpec(**spec)).select("group_id", "path")


@query(_narrowed("100 - confidence <= 20"))
def filter_diff(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, max_diff=20)


@query(_narrowed("contains(lower(regexp_extract(path, '[^/]*$')), 'img_0')"))
def filter_filename(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, filename="iMG_0")


@query(_narrowed("lower(ext) IN ('.jpg', '.png', '.tif')"))
def filter_extension(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, extensions=("jpg", "PNG", ".tif"))


@query(_narrowed("size BETWEEN 1024 AND 4096"))
def filter_size(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, min_size=1024, max_size=4096)


@query(_narrowed("true", "count(*) OVER (PARTITION BY group_id) BETWEEN 3 AND 5"))
def filter_group_size(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, min_group=3, max_group=5)


@query(_narrowed("group_id IN (SELECT group_id FROM images WHERE path LIKE '/library/src1/%')"))
def filter_folder(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, folder="/library/src1")


@query(f"{_G}, {_SUMS} SELECT group_id, round(100 - confidence, 1) AS diff, (row_number() OVER (ORDER BY round(100 - confidence, 1) DESC, group_id))::INT AS place FROM sums")
def sort_groups_by_diff(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_groups(groups.summaries(_images(spark, d)), descending=True).select("group_id", "diff", "place")


@query(f"{_G} SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY lower(regexp_extract(path, '[^/]*$')), rank))::INT AS place FROM images")
def sort_images_by_name(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_images(_images(spark, d), SortSpec("name")).select("group_id", "path", "place")


@query(f"{_G} SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY width * height DESC, rank))::INT AS place FROM images")
def sort_images_by_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_images(_images(spark, d), SortSpec("dim", descending=True)).select("group_id", "path", "place")


@query(f"{_G} SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY lower(path) DESC, rank))::INT AS place FROM images")
def sort_images_by_path(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_images(_images(spark, d), SortSpec("path", descending=True)).select("group_id", "path", "place")


@query(f"{_G} SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY lower(ext), rank))::INT AS place FROM images")
def sort_images_by_extension(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_images(_images(spark, d), SortSpec("ext")).select("group_id", "path", "place")


@query(f"{_G} SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY size DESC, rank))::INT AS place FROM images")
def sort_images_by_size(spark: SparkSession, d: str) -> DataFrame:
    return results.sort_images(_images(spark, d), SortSpec("size", descending=True)).select("group_id", "path", "place")


@query(f"""{_G}, passed AS (SELECT * FROM images WHERE group_id IN (SELECT group_id FROM images WHERE path LIKE '/library/src1/%') AND size >= 200 AND 100 - confidence <= 25),
kept AS (SELECT * FROM passed QUALIFY count(*) OVER (PARTITION BY group_id) >= 2),
placed AS (SELECT group_id, (row_number() OVER (ORDER BY round(100 - confidence, 1), group_id))::INT AS group_place FROM kept GROUP BY group_id, confidence)
SELECT group_id, path, group_place, (row_number() OVER (PARTITION BY group_id ORDER BY size DESC, rank))::INT AS place FROM kept JOIN placed USING (group_id)""")
def view_narrowed_and_sorted(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec(folder="/library/src1", min_size=200, max_diff=25)
    return results.view(_images(spark, d), spec, SortSpec("size", descending=True)).select("group_id", "path", "group_place", "place")


@query(f"{_G} SELECT coalesce(folder, 'All') AS folder, count(*) AS images FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM images) GROUP BY ROLLUP (folder)")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return results.folders(_images(spark, d))


_SELECTED = "group_id IN (SELECT group_id FROM images WHERE rank = 1 AND size % 2 = 0)"
_KEEP = f"keep AS (SELECT group_id, path, size FROM images WHERE {_SELECTED} AND rank > 1 AND path NOT IN (SELECT path FROM images WHERE rank = 2 AND size % 3 = 0))"


def _picked(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    return images.where("rank = 1 AND size % 2 = 0").select("group_id"), images.where("rank = 2 AND size % 3 = 0").select("path")


@query(f"{_G}, {_KEEP} SELECT * FROM keep")
def keep_best_plan(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return results.keep_best(images, *_picked(images))


@query(f"{_G} SELECT group_id, path, size FROM images WHERE {_SELECTED}")
def delete_all_plan(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return results.delete_all(images, _picked(images)[0])


@query(f"{_G}, {_KEEP} SELECT group_id, path FROM images WHERE path NOT IN (SELECT path FROM keep) QUALIFY count(*) OVER (PARTITION BY group_id) >= 2")
def after_delete(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return results.after_delete(images, results.keep_best(images, *_picked(images))).select("group_id", "path")


@query(f"{_G}, {_KEEP} SELECT (SELECT count(DISTINCT group_id) || ' group' || CASE WHEN count(DISTINCT group_id) = 1 THEN '' ELSE 's' END FROM images WHERE {_SELECTED}) AS groups, "
       "(SELECT CASE WHEN count(*) = 0 THEN '' ELSE 'Confirm ' || count(*) || ' deletion' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END END FROM keep) AS deletions")  # fmt: skip
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return results.counters(_picked(images)[0], results.keep_best(images, *_picked(images)))


@query(f"""{_G} SELECT coalesce((SELECT to_json({{'report_type': 'mismatch', 'group_id': group_id, 'match_type': match_type, 'confidence': confidence, 'timestamp': '2024-01-01T00:00:00Z',
  'images': list({{'rank': rank, 'path': path, 'filename': regexp_extract(path, '[^/]*$'), 'size': size, 'width': width, 'height': height, 'quality_score': quality_score, 'is_best': rank = 1, 'digest': digest, 'd_hash': lower(printf('%016x', d_hash))}} ORDER BY rank)}})::VARCHAR
  FROM images WHERE group_id = (SELECT min(group_id) FROM images) GROUP BY group_id, match_type, confidence), '{{"error":"group not found"}}') AS report""")
def mismatch_report(spark: SparkSession, d: str) -> DataFrame:
    from ..storage import cut

    photos = X.photos(spark, d)
    images = cut(spark, _images(spark, d, photos))
    first = images.agg(F.min("group_id")).first()[0]
    return results.report(images, photos, first or "", F.lit("2024-01-01T00:00:00Z").cast("timestamp"))


# ---- formats


_BYTES = """CASE WHEN n IS NULL THEN '--' WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576, 1))
WHEN n < 1099511627776 THEN printf('%.1f GB', round(n / 1073741824, 1)) ELSE printf('%.1f TB', round(n / 1099511627776, 1)) END"""


@query(f"SELECT o_orderkey, {_BYTES} AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT * (o_orderkey % 7 * 4001 + 1) END AS n FROM orders)")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    n = F.when(i % 11 == 0, F.lit(None).cast("long")).when(i % 13 == 0, F.lit(0)).otherwise(F.floor("o_totalprice").cast("long") * (i % 7 * 4001 + 1))
    return X.read(spark, d, "orders").select("o_orderkey", n.cast("long").alias("n")).select("o_orderkey", S.format_bytes(F.col("n")).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', round(ms / 1000, 1)) ELSE (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' END AS shown FROM (SELECT o_orderkey, o_orderkey * 37 % 200000 // (o_orderkey % 9 * 40 + 1) AS ms FROM orders)")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    ms = F.floor(i * 37 % 200000 / (i % 9 * 40 + 1)).cast("long")
    return X.read(spark, d, "orders").select("o_orderkey", ms.alias("ms")).select("o_orderkey", S.format_duration(F.col("ms")).alias("shown"))


@query("SELECT c_custkey, CASE WHEN lat = 0 AND lon = 0 THEN '--' ELSE printf('%.4f, %.4f', round(lat, 4), round(lon, 4)) END AS shown FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey / 64 END::DOUBLE AS lat, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE -c_custkey / 32 END::DOUBLE AS lon FROM customer)")
def format_gps(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    lat, lon = F.when(i % 3 == 0, 0.0).otherwise(i / 64), F.when(i % 6 == 0, 0.0).otherwise(-i / 32)
    return X.read(spark, d, "customer").select("c_custkey", S.format_gps(lat, lon).alias("shown"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM pages")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "pages").select("page_id", S.escape_html(F.col("html")).alias("safe"))


@query(f"WITH {X.ORDER_PHOTOS} SELECT quality_score, CASE WHEN quality_score <= 50 THEN printf('rgb(255,%d,60)', round(5.1::DOUBLE * quality_score)::BIGINT) ELSE printf('rgb(%d,255,60)', round(5.1::DOUBLE * (100 - quality_score))::BIGINT) END AS color, count(*) AS photos FROM order_photos GROUP BY ALL")
def quality_color(spark: SparkSession, d: str) -> DataFrame:
    return quality_score(spark, d).groupBy("quality_score").agg(F.count("*").alias("photos")).withColumn("color", S.quality_color(F.col("quality_score")))


@query(f"WITH {X.ORDER_PHOTOS} SELECT photo_id, CASE WHEN greatest(width, height) <= 400 THEN width ELSE greatest(1, width * 400 // greatest(width, height)) END AS width, CASE WHEN greatest(width, height) <= 400 THEN height ELSE greatest(1, height * 400 // greatest(width, height)) END AS height FROM order_photos")
def thumbnail_size(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return X.order_photos(spark, d).select("photo_id", S.thumbnail_side(w, h).alias("width"), S.thumbnail_side(h, w).alias("height"))


# ---- rows of a table


@query(f"""{_G}, r AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, size AS n FROM images)
SELECT group_id, path, CASE WHEN rank = 1 OR rank = 2 AND size % 3 = 0 THEN 'Original' ELSE 'Duplicate' END AS status, rank = 3 AS pending, regexp_extract(path, '[^/]*$') AS name,
  CASE WHEN len(string_split(up, '/')) <= 3 THEN up ELSE '.../' || array_to_string(string_split(up, '/')[-2:], '/') END AS folder, upper(regexp_extract(path, '[^.]*$')) AS extension,
  CASE WHEN width > 0 AND height > 0 THEN width || '\u00d7' || height ELSE '--' END AS dimensions, {_BYTES} AS shown_size, CASE WHEN date_taken = '' THEN '--' ELSE strftime(date_taken::TIMESTAMP, '%b %-d, %Y %I:%M %p') END AS taken FROM r""")
def image_rows(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return results.image_rows(images, _picked(images)[1], images.where("rank = 3").select("path"))
