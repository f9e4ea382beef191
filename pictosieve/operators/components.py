"""Connected components of a graph given as edges, by alternating large and small stars.

No vertex's neighbours are gathered: a round takes minima (combined before the shuffle) and joins them
back, so a vertex with very many neighbours is an ordinary skewed join, which Spark splits. Rounds are
written to the shared folder; they end when the edges, which are stars then, no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut


def smallest_reached(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component when a[i] and b[i] are linked too; ``root``: as it was before."""
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``components`` of all edges that are given."""
    edges = pa.Table.from_batches([b for b in batches if len(b)] or [pa.record_batch({"u": pa.array([], "string"), "v": pa.array([], "string")})])
    u, v = edges["u"].combine_chunks(), edges["v"].combine_chunks()
    names = pa.concat_arrays([u, v]).unique()
    names = names.take(pc.sort_indices(names))
    ends = [pc.index_in(x, names).to_numpy(zero_copy_only=False) for x in (u, v)]
    root = smallest_reached(np.arange(len(names)), *ends)
    if len(names):
        yield pa.record_batch({"v": names, "root": names.take(pa.array(root))})


def components(spark: SparkSession, edges: DataFrame, at_once: int = 0) -> DataFrame:
    """``edges``: a, b (equal types, no nulls). Gives v, root for every vertex of an edge: the smallest it reaches.

    Up to ``at_once`` edges are joined in one task, which spares the rounds; more go through them.
    """
    e = cut(spark, edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if at_once and e.count() <= at_once:
        kind = e.schema["v"].dataType
        return cut(spark, e.coalesce(1).mapInArrow(_rooted, StructType().add("v", kind).add("root", kind)))
    state = None
    while True:
        # large star: every larger neighbour of a vertex is tied to the smallest neighbour
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour too, and the vertex itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(spark, small.where(F.col("u") != F.col("v")).distinct())
        was, state = state, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if was == state:
            break
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionAll(e.select("v", F.col("v").alias("root")).distinct())
