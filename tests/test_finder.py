"""The duplicate finder: worked values, its queries against DuckDB, and real image files."""

import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from pictosieve.functions import imaging
from pictosieve.functions import scalars as S
from pictosieve.operators import components, groups, raster, series, similarity
from pictosieve.plans import engine
from pictosieve.plans import queries as Q
from pictosieve.request import SUPPORTED, ScanRequest
from pictosieve.sources import files, fixtures
from pictosieve.streaming.incremental import watch

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_worked_values(spark):
    lit = F.lit
    got = one(spark, *(S.aspect_bucket(lit(w), lit(h)) for w, h in ((4, 3), (3, 4), (16, 9), (0, 9))))
    assert got == ("1.35", "1.35", "1.80", "unknown")
    assert one(spark, *(S.confidence(lit(d)) for d in (0, 3, 4))) == (100.0, 95.3125, 93.75)
    assert one(spark, S.format_bytes(lit(None).cast("long")), S.format_bytes(lit(0)), S.format_bytes(lit(int(4.3 * 1024**2)))) == ("--", "0 B", "4.3 MB")
    assert one(spark, *(S.format_duration(lit(x)) for x in (999, 2300, 105000))) == ("999ms", "2.3s", "1m 45s")
    no = [lit(False)] * 5
    assert one(spark, *(S.quality_score(lit(1000 * mp), lit(1000), lit(0), *no) for mp in (1, 2, 8, 16))) == (0, 7, 22, 30)
    assert one(spark, *(S.quality_score(lit(0), lit(0), lit(int(m * 1048576)), *no) for m in (0.5, 1, 4, 32))) == (0, 0, 6, 15)
    assert one(spark, S.parent(lit("/a/b/c.jpg")), S.parent(lit("x")), S.extension(lit("/a.b/C.JPG")), S.extension(lit("/a.b/c")), S.stem(lit("/a/c.x.y"))) == ("/a/b", "/", ".jpg", "", "c.x")
    assert one(spark, S.hash_text(lit(-1)), S.hamming(lit(-1), lit(0))) == ("f" * 16, 64)


def test_requests():
    r = ScanRequest.of("/a; /b ;;", threshold=-1, algorithm="both", extensions=("JPG", " .png "))
    assert r.roots == ("/a", "/b") and r.threshold == 10 and r.algorithm == "dhash" and r.wanted == (".jpg", ".png")
    assert ScanRequest("/a").wanted == SUPPORTED


def test_series(spark):
    names = {1: ["IMG_4446", "IMG_4448", "IMG_4450", "IMG_4451"], 2: ["a1", "a7"], 3: ["IMG_1", "img_2"], 4: ["a", "b2"], 5: ["x" + "9" * 30, "x1"]}
    df = spark.createDataFrame([(g, n + ".jpg") for g, some in names.items() for n in some], "g int, path string")
    assert {r.g: r.by_name for r in series.filename_series(df, "g", "path").collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    times = [(1, "2024-01-01 00:00:00", "c"), (1, "2024-01-01 00:01:00", "c"), (2, "2024-01-01 00:00:00", "c"), (2, "2024-01-01 00:01:01", "c"), (3, "2024-01-01 00:00:00", "c"), (3, None, "c"), (4, "2024-01-01 00:00:00", ""), (4, "2024-01-01 00:00:01", "")]
    df = spark.createDataFrame(times, "g int, t string, c string").withColumn("t", F.col("t").cast("timestamp"))
    assert {r.g: r.by_time for r in series.time_series(df, "g", F.col("t"), F.col("c")).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200)]
    got = {r.v: r.root for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)}


def test_bands_find_the_same_pairs(spark):
    import random

    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in hashes for _ in range(2)]
    df = spark.createDataFrame([(f"p{i}", "b", h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "path string, bucket string, d_hash long")
    for t in (0, 4, 10):
        want = sorted(map(tuple, similarity.pairs(df, t).collect()))
        assert want == sorted(map(tuple, similarity.pairs_banded(df, t).collect())) == sorted(map(tuple, similarity.near_pairs(df, t).collect()))
        assert want == sorted(map(tuple, similarity.pairs_banded(df, t, 2).collect()))


def test_stars_link_what_pairs_link(spark, monkeypatch):
    import random

    rng = random.Random(3)
    hashes = [rng.getrandbits(64) for _ in range(150)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 19))) for h in hashes[:60] for _ in range(2)]
    hashes += [hashes[0] ^ (i << 40) for i in range(1, 200)]  # one group, all of which are near
    rows = [(f"p{i:04}", "ab"[i % 7 == 0], h - (1 << 64) if h >> 63 else h) for i, h in enumerate(dict.fromkeys(hashes))]
    df = spark.createDataFrame(rows, "path string, bucket string, d_hash long")
    want = sorted(map(tuple, similarity.perceptual_members(spark, df, 18, False).collect()))
    pairs, stars = similarity.pairs(df, 18).count(), []
    for part in (similarity.PART, 40):  # whole buckets, and buckets dealt over cells
        monkeypatch.setattr(similarity, "PART", part)
        assert sorted(map(tuple, similarity.perceptual_members(spark, df, 18).collect())) == want
        stars.append(similarity.near_stars(df, 18).count())
    assert pairs > 10000 and stars[0] < len(rows)


def test_only_what_is_not_settled_is_compared(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    near = np.unique(rng.integers(0, 1 << 20, 2000, dtype=np.uint64))  # a component of nearly all of them
    far = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    h = rng.permutation(np.unique(np.concatenate([near, far, far[:9] ^ np.uint64(0b1110)])))
    differ = np.bitwise_count(h[:, None] ^ h)
    np.fill_diagonal(differ, 65)
    want = np.arange(len(h))
    while ((low := np.minimum(want, np.where(differ <= 5, want, len(h)).min(axis=1))) != want).any():
        want = low
    least = np.full(len(h), 65)
    np.minimum.at(least, want, np.where(differ.min(axis=1) <= 5, differ.min(axis=1), 65))
    monkeypatch.setattr(similarity, "BLOCK", 100)
    done, real = [], similarity._compared

    def counted(h, rows, columns, *rest):
        done.append(len(rows) * len(columns))
        return real(h, rows, columns, *rest)

    monkeypatch.setattr(similarity, "_compared", counted)
    root, nearest = similarity.tied(h, 5)
    assert (root == want).all() and (nearest == least[want]).all() and sum(done) < len(h) ** 2 / 4
    left, roots, nearests = np.arange(len(h)) % 3 > 0, np.arange(len(h)), np.full(len(h), 65, np.uint8)
    for some in (np.flatnonzero(left), np.flatnonzero(~left)):
        root, nearest = similarity.tied(h[some], 5)
        roots[some], nearests[some] = some[root], nearest
    done.clear()
    root, nearest = similarity.linked(h, left, roots, nearests, 5)
    assert (root == want).all() and (nearest == least[want]).all() and sum(done) < left.sum() * (~left).sum() / 4


def test_flat_raster(spark):
    df = spark.createDataFrame([(1, y, x, 7) for y in range(16) for x in range(16)], "i int, y int, x int, gray long")
    assert raster.blockiness(df, "i").first()[1] == 0.0 and raster.blurring(df, "i").first()[1] == 100.0


def test_whole_rasters_blur_as_their_pixels(spark, monkeypatch):
    import random

    rng = random.Random(5)
    images = [(i, w, h, "".join(chr(rng.choice((97, 233, 0x20AC, 0x1F600))) for _ in range(w * h + 3))) for i, (w, h) in enumerate(((16, 16), (40, 19), (17, 60), (16, 1)))]
    df = spark.createDataFrame([*images, (9, 20, 20, "a" * 400)], "doc_id long, width long, height long, text string")
    pixels = spark.createDataFrame([(i, k // w, k % w, ord(t[k])) for i, w, h, t in images for k in range(w * h)], "doc_id long, y int, x int, gray long")
    for lines in (raster.AT_ONCE, 50):  # at once, and a line after the other
        monkeypatch.setattr(raster, "AT_ONCE", lines)
        assert sorted(map(tuple, raster.blurring_whole(df, "doc_id").collect())) == [*sorted(map(tuple, raster.blurring(pixels, "doc_id").collect())), (9, 100.0)]
    assert "Exchange" not in raster.blurring_whole(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r[1] for r in con.execute(Q.ORACLES["blurring"]).fetchall()}
    got = {r.doc_id: r.blurring for r in Q.blurring(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_grid_of_any_characters(spark):
    rows = [(1, "\ufeff\U0001f600a\u00e9" * 40, 8, 20), (2, "", 1, 0), (3, "ab", 1, 2)]
    grids = {r.doc_id: r.grid for r in fixtures.photo_grid(spark.createDataFrame(rows, "doc_id long, text string, width long, height long")).collect()}
    for i, t, w, h in rows:
        places = [(k // 9 * h // 8) * w + k % 9 * w // 9 for k in range(72)]
        assert grids[i] == [ord(t[p]) if p < len(t) else 0 for p in places]


def test_hash_without_its_grid(spark):
    import random

    rng = random.Random(11)
    rows = [(i, "".join(chr(rng.choice((0, 97, 98, 233, 0x20AC, 0xFEFF, 0xFFFD, 0x1F600))) for _ in range(rng.randrange(300))), rng.randrange(1, 20), rng.randrange(20)) for i in range(60)]
    df = fixtures.photo_grid(spark.createDataFrame(rows, "doc_id long, text string, width long, height long")).select(S.dhash(F.col("grid")).alias("want"), fixtures.photo_dhash().alias("got"))
    assert df.where("want <> got").count() == 0 and df.where("got <> 0").count() > 30


@pytest.mark.parametrize("name", ["filter_size", "group_images_ranked", "scan_stats", "sort_images_by_dimensions"])
def test_grouped_query_in_several_parts_equals_its_sql(spark, name, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 12)
    test_query_equals_its_sql(spark, name)


@pytest.mark.parametrize("name", ["scan_filtered", "exact_groups", "cache_writeback", "dhash_fingerprint", "ahash_pairs", "hamming_pairs_banded", "filename_series", "quality_best", "duplicate_groups", "folder_rollup", "after_delete", "format_bytes", "view_narrowed_and_sorted", "batch_counters", "image_rows", "sort_images_by_extension", "result_json", "mismatch_report"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "customer lineitem orders events documents embeddings pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.QUERIES[name](spark, SF)
    cursor = con.execute(Q.ORACLES[name])
    names = [d[0] for d in cursor.description]
    shown = lambda rows: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)
    assert sorted(names) == sorted(got.columns) and shown(map(tuple, got.select(*names).collect())) == shown(cursor.fetchall())


def png(width, height, at):
    rows = b"".join(b"\0" + b"".join(bytes(at(x, y)) for x in range(width)) for y in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_scan_of_real_files(spark, tmp_path):
    wave = lambda x, y: ((x * 37 + y * 11) % 256, (x * x + y) % 256, (y * 29) % 256)
    a, other = png(36, 24, wave), png(36, 24, lambda x, y: ((x * 91 ^ y * 57) % 256,) * 3)
    near = png(36, 24, lambda x, y: tuple(min(255, c + (x == 1)) for c in wave(x, y)))
    root = tmp_path / "in"
    for name, data in {"a.png": a, "copy.PNG": a, "sub/near.png": near, "other.png": other, "notes.txt": b"x", "broken.jpg": b"\xff\xd8no", "empty.jpg": b"", ".hidden/a.png": a}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    for _ in range(2):  # the second time from the cache
        out = engine.scan(spark, ScanRequest(str(root)), str(tmp_path / "cache"))
        assert out.status == "complete" and tuple(out.stats.first()) == (5, 1, len(a))
        assert sorted(r.path.rsplit("/", 1)[1] for r in out.images.collect()) == ["a.png", "copy.PNG"]
    assert {(r.width, r.height) for r in out.photos.where("path like '%.png'").collect()} == {(36, 24)}
    near_only = engine.scan(spark, ScanRequest(str(root), extensions=("png",), threshold=12))
    assert near_only.images.count() >= 2
    assert engine.scan(spark, ScanRequest(str(tmp_path / "none"))).status == "No images found"
    for _ in range(2):
        watch(spark, str(root), str(tmp_path / "store"), str(tmp_path / "progress"), "*.png").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_scan_hashes_pictures_of_all_folders(spark, tmp_path):
    for i in range(1010):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.png").write_bytes(png(9, 8, lambda x, y: (x * 20, y, 5)))
    (tmp_path / "d7" / "in").mkdir()
    (tmp_path / "d7" / "in" / "x.png").write_bytes(png(9, 8, lambda x, y: (x * 20, y, 5)))
    out = engine.hashed(spark, files.listing(spark, ScanRequest(str(tmp_path))), "dhash")
    assert out.count() == 1011 and out.where("d_hash is null").count() == 0


def test_scan_of_odd_names_and_a_cached_second_scan(spark, tmp_path, monkeypatch):
    picture = lambda k: png(18, 16, lambda x, y: ((x * 37 + y * 11 + k * x * y) % 256, (x * x + y) % 256, (y * 29) % 256))
    names = ["my photo é.png", "100%.png", "a+b.png", "x#y.png", "b[1].png", "q{2}.png", "%41.png", "日本 語.png"]
    (tmp_path / "in").mkdir()
    for i, n in enumerate(names):
        (tmp_path / "in" / n).write_bytes(picture(0)[:-4] + bytes([i, 0, 0, 0]))  # one picture, contents of one size
    (tmp_path / "in" / "alone.png").write_bytes(picture(3) + b"more")
    heard = []
    out = engine.scan(spark, ScanRequest(str(tmp_path / "in")), str(tmp_path / "cache"), told=lambda phase, n: heard.append((phase, n)))
    photos = {r.path.rsplit("/", 1)[1]: r for r in out.photos.collect()}
    assert set(photos) == {*names, "alone.png"} and all(r.d_hash for r in photos.values())
    assert photos["alone.png"].digest is None and all(photos[n].digest for n in names)
    assert {r.path.rsplit("/", 1)[1] for r in out.images.collect()} >= set(names) and heard[:2] == [("listed", 9), ("hashed", 9)]
    (tmp_path / "in" / "new.png").write_bytes(picture(5) + b"x" * 99)
    seen = []
    real = engine.decoded
    monkeypatch.setattr(engine, "decoded", lambda spark, *paths: seen.extend(paths) or real(spark, *paths))
    again = engine.scan(spark, ScanRequest(str(tmp_path / "in")), str(tmp_path / "cache"))
    assert [p.rsplit("/", 1)[1] for p in seen] == ["new.png"] and again.photos.count() == 10
    assert engine.scan(spark, ScanRequest(str(tmp_path / "in")), stop=lambda: True).status == "cancelled"
    quality = {r.path.rsplit("/", 1)[1]: (r.blockiness, r.blurring) for r in engine.picture_quality(spark, str(tmp_path / "in" / "b[1].png"), str(tmp_path / "in" / "a+b.png")).collect()}
    assert set(quality) == {"b[1].png", "a+b.png"} and len(set(quality.values())) == 1


def test_rows_and_counters(spark):
    from pictosieve.operators import results

    assert one(spark, S.shown_extension(F.lit("/a/b.tar.gz")), S.shown_extension(F.lit("ab")), S.shown_date(F.lit("")), S.shown_date(F.lit("soon")), S.shown_date(F.lit("2024-05-06T07:08:09"))) == ("GZ", "", "--", "soon", "May 6, 2024 07:08 AM")
    images = spark.createDataFrame([("g", "/x/y/z/a.jpg", True, 4, 3, 10, ""), ("g", "/x/b.png", False, 0, 3, 0, "2024-05-06")], "group_id string, path string, is_best boolean, width int, height int, size long, date_taken string")
    rows = {r.name: r for r in results.image_rows(images, images.where("path like '%b.png'"), images.where("is_best")).collect()}
    assert rows["a.jpg"].dimensions == "4\u00d73" and rows["a.jpg"].pending and rows["a.jpg"].folder == ".../y/z" and rows["b.png"].status == "Original" and rows["b.png"].dimensions == "--"
    assert tuple(results.counters(images, images).first()) == ("1 group", "Confirm 2 deletions") and results.counters(images.limit(0), images.limit(0)).first()[1] == ""


def test_cache_versions(spark, tmp_path):
    from pictosieve.sources import cache

    at, schema = str(tmp_path / "c"), "path string, size long"
    assert cache.load(spark, at, schema).count() == 0
    cache.save(spark.createDataFrame([("a", 1)], schema), at)
    cache.save(cache.load(spark, at, schema).unionAll(spark.createDataFrame([("b", 2)], schema)), at)
    (tmp_path / "c" / "version=9").mkdir()  # of a scan that did not end
    assert cache.load(spark, at, schema).count() == 2
    cache.save(spark.createDataFrame([("c", 3)], schema), at)
    assert [r.path for r in cache.load(spark, at, schema).collect()] == ["c"]


def test_thumbnails_and_pixel_hashes(spark, tmp_path):
    import base64

    (tmp_path / "x.png").write_bytes(png(30, 20, lambda x, y: (x * 8, y * 9, 5)))
    got = imaging.thumbnails(spark, str(tmp_path), most=15).first()
    data = base64.b64decode(got.thumbnail)
    assert (got.width, got.height) == (15, 10) == imaging.dimensions(data)
    assert zlib.decompress(data[data.index(b"IDAT") + 4 :])[1:7] == bytes((0, 0, 5, 16, 0, 5))
    # luminance falls nowhere along a row, and the lower rows are lighter
    hashed = imaging.decoded(spark, str(tmp_path)).first()
    assert hashed.d_hash == 0 and 20 <= (hashed.a_hash % (1 << 64)).bit_count() <= 44


def test_headers():
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + entry(0x0110, 2, 3, b"X1\0\0") + entry(0x8827, 3, 1, struct.pack("<HH", 200, 0)) + entry(0x0132, 2, 20, struct.pack("<I", 60))
    tiff = tiff.ljust(60, b"\0") + b"2024:05:06 07:08:09\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 12000 + b"\xff\xd9"
    assert imaging.dimensions(jpeg) == (40, 30)
    found = imaging.exif(jpeg)
    assert found["camera"] == "X1" and found["iso"] == 200 and found["date_taken"] == "2024-05-06T07:08:09"
    assert imaging.preview_of(b"raw" * 9 + jpeg + b"end") == jpeg and imaging.preview_of(b"raw") is None
    small = b"\xff\xd8\xff\xe0 small \xff\xd9"
    assert imaging.preview_of(b"raw" + small + b"-" + jpeg) == jpeg and imaging.preview_of(b"raw" + small) == small
    assert imaging.dimensions(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6) and imaging.dimensions(b"") is None


def test_joined_at_once_equals_rounds(spark):
    import random

    rng = random.Random(5)
    edges = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(200)] + [("é", "z"), ("\U0001f600", "é")]
    df = spark.createDataFrame(edges, "a string, b string")
    found = [sorted(map(tuple, components.components(spark, df, n).collect())) for n in (0, 199, 10_000)]
    assert found[0] == found[1] == found[2] and ("\U0001f600", "z") in found[0]
    assert components.components(spark, df.limit(0), 10).count() == 0
    assert sorted(map(tuple, components.components(spark, spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"), 5).collect())) == [(1, 1), (2, 1), (3, 1)]


def test_possible_series_leaves_none_out_and_most_others(spark):
    import random

    rng, rows, want = random.Random(7), [], {}
    for g in range(200):
        at, names = rng.randrange(5000), []
        for _ in range(rng.randrange(1, 400)):
            names.append(at)
            at += rng.choice((0, 1, 5)) if g % 2 else rng.choice((1, 2, 5, 5, 6))
        want[g] = len(names) > 1 and all(b - a <= 5 for a, b in zip(names, names[1:], strict=False))
        rows += [(g, f"/x/IMG_{k:06d}.jpg", "", "") for k in names]
    rows += [(2000, f"/x/IMG_{k:06d}.jpg", "", "c") for k in range(20000) if rng.random() < 0.4]
    rows += [(1000, "/x/a.jpg", "2024-05-06", "c"), (1000, "/x/b.jpg", "2024-05-06", "c"), (1001, "/x/a.jpg", "2024-05-06", "c"), (1001, "/x/b.jpg", "", "c")]
    df = spark.createDataFrame(rows, "g long, path string, date_taken string, camera string")
    named = {r.g for r in series.filename_series(df, "g", "path").where("by_name").collect()}
    possible = {r.g for r in series.possible_series(df, "g", "path").collect()}
    assert named == {g for g, x in want.items() if x} and named | {1000} <= possible and possible.isdisjoint((1001, 2000))


def test_stats_need_no_order_within_groups(spark):
    photos = fixtures.photos(spark, SF)
    exact, near = groups.linked(spark, photos, fixtures.THRESHOLD, keep=groups.IMAGE[1:])
    out = groups.stats_of_members(photos, exact.unionByName(near.drop("min_distance")))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    images = groups.ranked(groups.members(spark, photos, fixtures.THRESHOLD), photos)
    assert tuple(out.first()) == tuple(groups.stats(photos, images).first())
    assert tuple(groups.stats_of_members(photos, exact.limit(0)).first())[1:] == (0, 0)


def test_hash_is_made_in_batches_and_not_by_a_lambda(spark, monkeypatch):
    assert "ArrowEvalPython" in fixtures.photo_files(spark, SF).select(fixtures.photo_dhash().alias("h"))._jdf.queryExecution().executedPlan().toString()
    import pyarrow as pa

    text, side = ["aé\U0001f600" * 30, None, "", "zy" * 50, "b"], [3, 2, 1, 4, None]
    whole = fixtures._dhashes(pa.array(text), pa.array(side), pa.array(side)).to_pylist()
    monkeypatch.setattr(fixtures, "PLACED", 1)
    assert fixtures._dhashes(pa.array(["x", *text])[1:], pa.array(side), pa.array(side)).to_pylist() == whole and whole[1:3] == [0, 0]
