"""Pairs of perceptual hashes within a number of bits, inside a bucket of the aspect ratio."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import hamming
from .components import components, smallest_reached


def hashable(photos: DataFrame) -> DataFrame:
    """Those with a hash; 0 stands for a picture that could not be decoded."""
    return photos.where(F.col("d_hash").isNotNull() & (F.col("d_hash") != 0))


def pairs(photos: DataFrame, threshold: int) -> DataFrame:
    """``photos``: path, bucket, d_hash. Gives a, b (paths, a first), distance; an equi-join with a residual."""
    left = photos.select(F.col("path").alias("a"), "bucket", F.col("d_hash").alias("ha"))
    right = photos.select(F.col("path").alias("b"), "bucket", F.col("d_hash").alias("hb"))
    near = hamming(F.col("ha"), F.col("hb"))
    return left.join(right, "bucket").where((F.col("a") < F.col("b")) & (near <= threshold)).select("a", "b", near.cast("int").alias("distance"))


#: Thresholds up to which hashes that agree on one band, or on two of more bands, are few enough to compare.
ONE_BAND, TWO_BANDS = 9, 14


def pairs_banded(photos: DataFrame, threshold: int, agree: int = 1) -> DataFrame:
    """As ``pairs``, for large buckets: two hashes within t bits agree on ``agree`` of t + ``agree`` bands of them.

    A pair is emitted for the first bands it agrees on, so no ``distinct`` is needed.
    """
    n = threshold + agree
    edges = [64 * i // n for i in range(n + 1)]
    masks = [(((1 << (b - a)) - 1) << a) - (1 << 64 if b == 64 else 0) for a, b in zip(edges, edges[1:], strict=False)]
    sets = list(combinations(masks, agree))
    keys = F.array(*(F.struct(F.lit(i).alias("set"), F.col("d_hash").bitwiseAND(F.lit(sum(some))).alias("value")) for i, some in enumerate(sets)))
    split = photos.select("path", "bucket", "d_hash", F.explode(keys).alias("k")).select("path", "bucket", "d_hash", "k.set", "k.value")
    left = split.select(F.col("path").alias("a"), "bucket", "set", "value", F.col("d_hash").alias("ha"))
    right = split.select(F.col("path").alias("b"), "bucket", "set", "value", F.col("d_hash").alias("hb"))
    near, differ = hamming(F.col("ha"), F.col("hb")), F.col("ha").bitwiseXOR(F.col("hb"))
    # the numbers of the bands they agree on; the first ones are the set's
    same = F.filter(F.array(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks))), lambda i: i.isNotNull())
    own = F.element_at(F.array(*(F.array(*map(F.lit, some)) for some in combinations(range(n), agree))), F.col("set") + 1)
    met = left.join(right, ["bucket", "set", "value"]).where((F.col("a") < F.col("b")) & (near <= threshold))
    return met.where(F.slice(same, 1, agree) == own).select("a", "b", near.cast("int").alias("distance"))


def near_pairs(photos: DataFrame, threshold: int) -> DataFrame:
    """``pairs`` by whatever tells hashes apart at the threshold: one band, two bands, or beyond that only the bucket."""
    if threshold > TWO_BANDS:
        return pairs(photos, threshold)
    return pairs_banded(photos, threshold, 1 if threshold <= ONE_BAND else 2)


#: Hashes in a part of a bucket, rows that are compared before it is looked which hashes still matter, and rows that are compared at once.
PART, BLOCK, STRIP = 16384, 1024, 8


def _compared(h: np.ndarray, rows: np.ndarray, columns: np.ndarray, root: np.ndarray, least: np.ndarray, threshold: int) -> np.ndarray:
    """The roots when each of ``rows`` is compared with each of ``columns``, or where these begin with the rows, each two once.

    ``least`` of a row gets its least distance within the threshold.
    """
    whole = len(rows) > 0 and len(columns) > 0 and rows[0] == columns[0]
    left, right = h[rows], h[columns]
    most = STRIP * len(right)
    differ, bits, near = np.empty(most, np.uint64), np.empty(most, np.uint8), np.zeros(-(-most // 8) * 8, bool)
    for at in range(0, len(left), STRIP) if len(right) else ():
        to, first = min(at + STRIP, len(left)), at if whole else 0
        shape = (to - at, len(right) - first)
        n = shape[0] * shape[1]
        np.bitwise_xor(left[at:to, None], right[None, first:], out=differ[:n].reshape(shape))
        np.bitwise_count(differ[:n], out=bits[:n])
        if whole:  # not with itself, nor twice
            bits[:n].reshape(shape)[:, : to - at][np.tri(to - at, dtype=bool)] = 65
        np.less_equal(bits[:n], threshold, out=near[:n])
        near[n:] = False
        eights = np.flatnonzero(near[: -(-n // 8) * 8].view(np.uint64))
        if len(eights) > shape[1]:  # many are near: a row at a time, with each component that is not linked to it yet
            nearest = bits[:n].reshape(shape).min(axis=1)
            least[rows[at:to]] = np.minimum(least[rows[at:to]], np.where(nearest <= threshold, nearest, 65))
            for k, a in enumerate(rows[at:to]):
                roots = root[columns[first:]]
                met = np.zeros(len(h), bool)
                met[roots[near[k * shape[1] : (k + 1) * shape[1]] & (roots != root[a])]] = True
                b = np.flatnonzero(met)
                root = smallest_reached(root, np.full(len(b), a), b)
        elif len(eights):
            some = (8 * eights[:, None] + np.arange(8)).ravel()
            some = some[near[some]]
            a, b = np.divmod(some, shape[1])
            np.minimum.at(least, rows[a + at], bits[some])
            root = smallest_reached(root, rows[a + at], columns[b + first])
    return root


def _nearest(root: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least distance in each one's component; 65: it is alone."""
    out = np.full(len(root), 65, np.uint8)
    np.minimum.at(out, root, least)
    return out[root]


def _settled(root: np.ndarray, least: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``some`` are in the component that has most of them, if it holds hashes that differ by one bit.

    Different hashes are no nearer, so what its members have to each other adds nothing any more.
    """
    most = np.bincount(root[some]).argmax()
    return (root[some] == most) & (least[root == most].min() <= 1)


def tied(h: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of each hash's component, and the least distance in it, by comparing each two different hashes.

    Only two of a component that is ``_settled`` need not be compared.
    """
    root, least, every = np.arange(len(h)), np.full(len(h), 65, np.uint8), np.arange(len(h))
    order = np.argsort(h)
    for bit in range(64 if len(h) > BLOCK else 0):  # those that differ by one bit, so that it is soon known what is settled
        ask = np.flatnonzero(h >> np.uint64(bit) & np.uint64(1) == 0)
        at = order[np.minimum(np.searchsorted(h, h[ask] ^ np.uint64(1 << bit), sorter=order), len(h) - 1)]
        hit = h[at] == h[ask] ^ np.uint64(1 << bit)
        least[ask[hit]] = least[at[hit]] = 1
        root = smallest_reached(root, ask[hit], at[hit])
    for at in range(0, len(h), BLOCK):
        root = _compared(h, every[at : at + BLOCK], every[at:], root, least, threshold)
        rest = every[at + BLOCK :]
        if len(rest):
            done = _settled(root, least, rest)
            if len(rest) - done.sum() <= BLOCK:
                root = _compared(h, rest[~done], rest[~done], root, least, threshold)
                root = _compared(h, rest[~done], rest[done], root, least, threshold)
                break
    return root, _nearest(root, least)


def linked(h: np.ndarray, left: np.ndarray, root: np.ndarray, least: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``tied``, of two parts that are tied by themselves: ``left`` tells which hashes are of the first one."""
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    in_a, in_b = _settled(root, least, a), _settled(root, least, b)
    if in_a.any() or in_b.any():  # if one has a distance of one bit, a component that both are linked to has it
        in_a, in_b = root[a] == np.bincount(root[a]).argmax(), root[b] == np.bincount(root[b]).argmax()
    inner, other = a[in_a], b[in_b]
    for at in range(0, len(inner), STRIP) if len(other) else ():
        root = _compared(h, inner[at : at + STRIP], other, root, least, threshold)
        if root[inner[0]] == root[other[0]]:
            break
    root = _compared(h, a[~in_a], b, root, least, threshold)
    root = _compared(h, inner, b[~in_b], root, least, threshold)
    return root, _nearest(root, least)


def tied_parts(photos: DataFrame, threshold: int) -> DataFrame:
    """``photos`` (path, bucket, d_hash, of which no two in a bucket are equal) with parts, part, root, least.

    A bucket is dealt over parts; root is a path of the photo's component in its part, least the least distance there (65: it is alone).
    """
    shared = photos.groupBy("bucket").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = photos.join(F.broadcast(shared), "bucket").withColumn("part", F.pmod(F.xxhash64("d_hash", "path"), F.col("parts")))

    def of(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        root, least = tied(part["d_hash"].to_numpy().view(np.uint64), threshold)
        return part.append_column("root", part["path"].take(pa.array(root))).append_column("least", pa.array(least.astype(np.int32)))

    return dealt.groupBy("bucket", "part").applyInArrow(of, StructType([*dealt.schema.fields]).add("root", "string").add("least", "integer"))


def tied_links(parts: DataFrame, threshold: int) -> DataFrame:
    """a, b, distance: links that join the roots of ``tied_parts`` as comparing all of a bucket does. Each two parts meet in a cell."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    met = parts.where("parts > 1").select("bucket", "part", "d_hash", "root", "least", other).where("part <> other")
    celled = met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "d_hash", "root", "least")

    def of(cell: pa.Table) -> pa.Table:
        part, names = cell["part"].to_numpy(), cell["root"].combine_chunks().dictionary_encode()
        _, first, place = np.unique(names.indices.to_numpy(), return_index=True, return_inverse=True)
        left = part == cell["i"][0].as_py()
        least = cell["least"].to_numpy().astype(np.uint8)
        root = first[place]
        if left.any() and not left.all():  # else one of the parts has no hashes
            root, least = linked(cell["d_hash"].to_numpy().view(np.uint64), left, root, least, threshold)
        tip = first[root[first] != first]
        return pa.table({"a": cell["root"].take(pa.array(root[tip])), "b": cell["root"].take(pa.array(tip)), "distance": pa.array(least[tip].astype(np.int32))})

    return celled.groupBy("bucket", "i", "j").applyInArrow(of, "a string, b string, distance int")


def near_stars(photos: DataFrame, threshold: int) -> DataFrame:
    """a, b, distance: links of the same components as ``pairs`` and of the same least distance in each, at most one for each hash and other part."""
    parts = tied_parts(photos, threshold)
    stars = parts.where("root <> path").select(F.col("root").alias("a"), F.col("path").alias("b"), F.col("least").alias("distance"))
    return stars.unionAll(tied_links(parts, threshold))


def one_each(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One photo for each (bucket, hash), and edges of distance 0 from the others to it: copies make no pairs."""
    first = photos.groupBy("bucket", "d_hash").agg(F.min("path").alias("path"))
    rest = photos.join(first.withColumnRenamed("path", "a"), ["bucket", "d_hash"]).where(F.col("a") != F.col("path"))
    return first, rest.select("a", F.col("path").alias("b"), F.lit(0).alias("distance"))


#: Links between parts that are joined in one task.
AT_ONCE = 200_000


def perceptual_members(spark: SparkSession, photos: DataFrame, threshold: int, banded: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, group_path, min_distance of photos that a chain of near hashes links, and the columns to ``keep``.

    ``banded`` None: by the bands that suit the threshold, beyond them by comparing all in cells.
    """
    from ..storage import cut

    if banded is None and threshold > TWO_BANDS:
        return _members_of_parts(spark, hashable(photos), threshold, keep)
    first, copies = one_each(hashable(photos))
    found = near_pairs(first, threshold) if banded is None else (pairs_banded if banded else pairs)(first, threshold)
    edges = cut(spark, found.unionByName(copies))
    roots = components(spark, edges)
    nearest = edges.join(roots, F.col("a") == F.col("v")).groupBy("root").agg(F.min("distance").alias("min_distance"))
    out = roots.join(nearest, "root").select(F.col("v").alias("path"), F.col("root").alias("group_path"), "min_distance")
    return out.join(photos.select("path", *keep), "path") if keep else out


def _members_of_parts(spark: SparkSession, photos: DataFrame, threshold: int, keep: tuple[str, ...]) -> DataFrame:
    """``perceptual_members`` for thresholds at which no bands tell hashes apart.

    Any two hashes of a bucket are compared in a part or in a cell of two parts, unless they are in a component that
    has the least distance there is. Parts give roots, cells join roots, so only roots go through ``components``.
    """
    from ..storage import cut

    first = cut(spark, photos.groupBy("bucket", "d_hash").agg(F.min("path").alias("path"), F.count("*").alias("n")))
    parts = cut(spark, tied_parts(first, threshold))
    links = cut(spark, tied_links(parts, threshold))
    tops = components(spark, links, AT_ONCE).select(F.col("v").alias("root"), F.col("root").alias("top"))
    own = parts.join(tops, "root", "left").select("bucket", "d_hash", "path", F.coalesce("top", "root").alias("top"), F.when(F.col("n") > 1, 0).otherwise(F.col("least")).alias("distance"))
    between = links.join(tops, F.col("a") == F.col("root")).select(F.lit(None).cast("string").alias("path"), "top", "distance")
    groups = own.select("path", "top", "distance").unionAll(between).groupBy("top").agg(F.min("path").alias("group_path"), F.min("distance").alias("min_distance")).where(F.col("min_distance") < 65)
    found = own.join(groups, "top").select("bucket", "d_hash", "group_path", "min_distance")
    return photos.select("path", "bucket", "d_hash", *keep).join(found, ["bucket", "d_hash"]).select("path", "group_path", "min_distance", *keep)
