"""Approximate nearest neighbours by largest inner product, with a permutation index.

Vectors are scaled by the largest length and given one more component that makes them unit vectors
(queries: 0 there), so the largest inner product is the nearest. Pivots come from a bounded, documented
sample (``SAMPLE``). Every vector is posted, once each, in the inverted files of its ``POSTS`` nearest of the
file pivots, whose number grows with the table so that a file holds about ``FILE`` vectors; a query goes to
the files of its ``VISITS`` nearest file pivots only. A file that grows beyond twice that is split into
shards. So vectors are sent ``POSTS`` times and queries ``VISITS`` times, however large the table.

In a file, a vector is represented by its ``NEAREST`` nearest of ``PIVOTS`` ranking pivots in order, and
posted in an inverted list for each with the place the pivot has. A query adds up, over its own pivots'
lists, what the footrule distance of the two orders lacks to its largest value; the ``CANDIDATES`` nearest
vectors of the file are reranked by the exact inner product, in double precision. What the files give is
merged. The work of a query has a constant bound: ``VISITS`` files of about ``FILE`` vectors, of which
``VISITS * CANDIDATES`` are reranked. A task holds one shard and streams the queries to it.

Equal vectors are one row of the index, with as many of their smallest ids as a result can show; equal
queries are asked once. So a group of copies, however large, costs one vector.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or have another length
than most take no part, nor do null ids; of a repeated query id its smallest row asks; rows with the
query's own id are no candidates, other repeated rows each are; ties go to the smaller id; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Ranking pivots, and how many of them represent a vector.
PIVOTS, NEAREST = 512, 64
#: Vectors of a file, files of a vector, files that a query visits, vectors of a file that are reranked for it.
FILE, POSTS, VISITS, CANDIDATES = 4096, 2, 16, 256
#: Vectors that pivots are taken from; as many if there are more files, up to the last number.
SAMPLE, MOST_FILES = 2048, 16384
TOP = 20
#: Queries that a task ranks at once.
AT_ONCE = 256


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), length of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    fine &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    out = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return out.withColumn("length", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c)))


def _farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        i = int(best.argmin())
        chosen.append(i)
        best = np.maximum(best, sample @ sample[i])
    return sample[chosen]


def _places(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest pivots, in order (ties: the earlier pivot)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class Shard:
    """Vectors of a file, with an inverted list for each ranking pivot."""

    def __init__(self, unit: np.ndarray, v: np.ndarray, first_id: np.ndarray, pivots: np.ndarray, k: int):
        self.v, self.first_id, self.k, self.pivots = v, first_id, k, pivots
        pivot = _places(unit, pivots, k).ravel()
        place = np.tile(np.arange(k, 0, -1, dtype=np.int32), len(v))  # k for the nearest
        by = np.argsort(pivot, kind="stable")
        ends = np.searchsorted(pivot[by], np.arange(1, len(pivots)))
        self.posts, self.weights = np.split(by // k, ends), np.split(place[by], ends)

    def nearest(self, q: np.ndarray, order: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the ``top`` best of the candidates; ``order``: the query's nearest pivots."""
        agree = np.zeros(len(self.v), np.int32)
        for i, p in enumerate(order.tolist()):
            agree[self.posts[p]] += np.minimum(self.weights[p], self.k - i)
        found = np.arange(len(agree))
        if len(agree) > CANDIDATES:  # and what is as near as the last of them
            found = np.flatnonzero(agree >= np.partition(agree, len(agree) - CANDIDATES)[len(agree) - CANDIDATES])
        score = (self.v[found] * q).sum(axis=1)
        best = np.lexsort((self.first_id[found], -score))[:top]
        return found[best], score[best]


_NAMES = ["file", "shard", "asks", "a", "b", "embedding", "ids"]
_CELLS = "file int, shard int, asks boolean, a long, b long, embedding array<double>, ids array<long>"


def search(spark: SparkSession, vectors: DataFrame, asks: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows to each row where ``asks``."""
    rows = valid(vectors)
    counts = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max("length").alias("most"))
    best = counts.orderBy(F.desc("n"), "dim").first()
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = best["dim"], best["most"]
    rows = rows.where(F.size("embedding") == dim).select("vec_id", "embedding")
    asked = rows.where(asks)
    # a query's own id is no candidate: so many more have to be looked at
    wanted = top + (asked.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    key = [F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("second"), "embedding").alias("b")]
    number = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    index = rows.withColumn("number", number).where(F.col("number") <= wanted).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = cut(spark, index.select(*key, "embedding", "ids"))
    queries = cut(spark, asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", *key, "embedding"))

    n = index.count()
    files = max(1, min(MOST_FILES, n * POSTS // FILE))
    drawn = index.orderBy("a", "b").limit(max(SAMPLE, files)).select("embedding").collect()

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / most
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def unit_query(x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))])

    sample = unit(np.array([r[0] for r in drawn]))
    file_pivots, pivots = sample[:files], _farthest_first(sample[:SAMPLE], PIVOTS)
    k = min(NEAREST, len(pivots))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = _places(unit(_matrix(b.column(0), dim)), file_pivots, POSTS)
                yield pa.RecordBatch.from_pydict({"file": place.ravel().astype(np.int32)})

    sizes = np.zeros(files, np.int64)  # at most ``MOST_FILES`` numbers
    for r in index.select("embedding").mapInArrow(filed, "file int").groupBy("file").count().collect():
        sizes[r["file"]] = r["count"]
    shards = np.maximum(1, -(-sizes // (2 * FILE)))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = _places(unit(_matrix(b.column(2), dim)), file_pivots, POSTS)
                row = np.repeat(np.arange(len(place)), place.shape[1])
                some, file = b.take(pa.array(row)), place.ravel()
                shard = (np.asarray(some.column(1)).view(np.uint64) % shards[file].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), pa.array(shard), pa.array(np.zeros(len(row), bool)), *some.columns], names=_NAMES)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = _places(unit_query(_matrix(b.column(2), dim)), file_pivots, VISITS)
                file, row = place.ravel(), np.repeat(np.arange(len(place)), place.shape[1])
                many = shards[file]
                shard = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                file, row = np.repeat(file, many), np.repeat(row, many)
                some = b.take(pa.array(row))
                none = pa.nulls(len(row), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(np.ones(len(row), bool)), *some.columns, none], names=_NAMES)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by file, shard and asks: a shard's vectors, then its queries."""
        at, held, shard = None, [], None
        for batch in batches:
            file, part, is_query = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            new = np.flatnonzero((file[1:] != file[:-1]) | (part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(file)], strict=True):
                if lo == hi:
                    continue
                some, here = batch.slice(lo, hi - lo), (file[lo], part[lo])
                if here != at:
                    at, held, shard = here, [], None
                if not is_query[lo]:
                    held.append(some)
                    continue
                if shard is None and held:
                    own = pa.Table.from_batches(held).combine_chunks()
                    v, ids = _matrix(own["embedding"].combine_chunks(), dim), own["ids"].combine_chunks()
                    first_id = np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]
                    shard = Shard(unit(v), v, first_id, pivots, k), own
                if shard is None:
                    continue
                index, own = shard
                for start in range(0, hi - lo, AT_ONCE):
                    asking = some.slice(start, AT_ONCE)
                    q = _matrix(asking.column(5), dim)
                    found = [index.nearest(x, o, wanted) for x, o in zip(q, _places(unit_query(q), pivots, k), strict=True)]
                    of, which = np.repeat(np.arange(len(q)), [len(f) for f, _ in found]), np.concatenate([f for f, _ in found])
                    asker, got = asking.take(pa.array(of)), own.take(pa.array(which)).combine_chunks()
                    cols = [asker.column(3), asker.column(4), got["a"].combine_chunks(), got["b"].combine_chunks(), got["ids"].combine_chunks(), pa.array(np.concatenate([s for _, s in found]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["qa", "qb", "a", "b", "ids", "score"])

    vectors_in = index.select("a", "b", "embedding", "ids").mapInArrow(posted, _CELLS)
    asked_once = queries.dropDuplicates(["a", "b"]).select("a", "b", "embedding").mapInArrow(sent, _CELLS)
    cells = vectors_in.unionByName(asked_once).repartition("file", "shard").sortWithinPartitions("file", "shard", "asks")
    found = cells.mapInArrow(ranked, "qa long, qb long, a long, b long, ids array<long>, score double").dropDuplicates(["qa", "qb", "a", "b"])
    order = W.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id")
    merged = found.select("qa", "qb", F.explode("ids").alias("vec_id"), "score").withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    askers = queries.select(F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"))
    near = askers.join(merged, ["qa", "qb"]).where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
