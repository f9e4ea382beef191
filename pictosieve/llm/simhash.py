"""SimHash near-dedup by segment popcounts.

A text's fingerprint takes the majority of each bit over its word shingles' XXH64. Two fingerprints'
bit counts in each of 16 segments of 4 bits, as points of a grid, lie at most their Hamming distance apart
in Manhattan distance. So fingerprints within ``BITS`` = 2 bits have points within 2, and then a common
cell at most 1 from both: the range join enters every point in its own cell and the up to 32 next to it,
and keeps cells with more than one fingerprint. In a cell of at most ``DENSE`` fingerprints, candidates
are pairs whose points are at most ``BITS`` apart in Manhattan distance, and pairs whose fingerprints differ
in at most ``BITS`` bits are links. A denser cell is split by the finest grid, of segments of one bit, in
which Manhattan distance is the Hamming distance: a pair within 2 bits has a common cell there too (a
number at most 1 bit from both, in the coarse cell), each fingerprint enters its at most 4 numbers of the
coarse cell, and those that share one are linked in a star, verified against its centre
(at most 65 differ by 1 bit from a number, so no group is large). No pairs are made within a group of
copies: equal fingerprints are one vertex. A fingerprint has at most 2080 others within 2 bits, so links
grow with the fingerprints and not with the square of a group.

Several tables (fingerprints from independently mixed hashes) may be used: documents are linked if any
table links them, which finds near copies whose distance in one table is a little over 2.

``deduplicate`` links as above the fingerprints of its shingles, of 5 words. Pairs at the similarity that it asks
for may differ by far more than 2 bits, so it adds links to those: candidates are texts that share one of ``BANDS``
bands of ``ROWS`` MinHashes (a pair at a Jaccard similarity of 0.8 does with a chance of 0.9999), and of them pairs
whose sets of shingles have a Jaccard similarity of at least ``ALIKE``, counted on the texts, are links too. Texts of equal sets are one
vertex.
A bucket (texts that share a band) is compared in cells of about two times ``CELL`` texts at most, so that
any two of its texts meet in one; a cell gives links as stars, not pairs. Cells of a bucket grow with the
square of its size over ``CELL``.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; rows that repeat a doc_id are one document; null ids take part in links but
are no component's name unless a component has nothing else (then it is null). Extra columns are ignored
by ``link`` and kept by ``deduplicate``, for which rows of one doc_id but different texts are different
documents, rows equal in both are one document and stay together, and of rows with a null id one stays if
nothing else of their component does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .blocks import Block, mix
from .common import cut, map_blocks, table

BITS, SEED, SHINGLE = 2, 42, 3
#: Fingerprints of a cell from which it is split.
DENSE = 64
#: Near copies: Jaccard similarity from which texts are, bands of MinHashes, texts in half a cell.
ALIKE, BANDS, ROWS, CELL = 0.8, 24, 5, 512
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.translate(_LOW).split()
    if not words:
        return np.zeros(0, np.uint64)
    data, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, tables: int = 1) -> DataFrame:
    """doc_id, fps: the fingerprint by each table; the first is of the hashes themselves."""
    salts = [np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1) for i in range(tables)]

    def made(block: Block) -> dict[str, object]:
        out = []
        for i in range(block.n):
            h = shingle_hashes(block.bytes_of(i), shingle)
            out.append([fingerprint(mix(h ^ s) if s else h) for s in salts])
        return {"fps": out}

    return map_blocks(documents, made, "fps array<long>", keep=["doc_id"])


def _grid(x: Column) -> Column:
    """Bit counts of the 16 nibbles of ``x``, each in its nibble."""
    lowest = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(x, i).bitwiseAND(lowest) for i in (1, 2, 3)), x.bitwiseAND(lowest))


def _entries(fps: DataFrame) -> DataFrame:
    """``fps``: t, fp, rep. Rows: t, cell, fp, rep, side (0: its own cell; j or -j: one more or less in segment j)."""
    cell = F.col("own")
    at = lambda j: F.shiftrightunsigned(cell, 4 * j).bitwiseAND(F.lit(15))
    around = [F.struct(cell.alias("cell"), F.lit(0).alias("side"))]
    for j in range(16):
        up, down = F.lit(1 << 4 * j), F.lit(1 << 4 * j)
        around.append(F.when(at(j) < 4, F.struct((cell + up).alias("cell"), F.lit(j + 1).alias("side"))))
        around.append(F.when(at(j) > 0, F.struct((cell - down).alias("cell"), F.lit(-j - 1).alias("side"))))
    return fps.withColumn("own", _grid(F.col("fp"))).select("t", "fp", "rep", F.explode(F.array(*around)).alias("x")).where(F.col("x").isNotNull()).select("t", "x.cell", "fp", "rep", "x.side")


def _manhattan(x: Column, y: Column) -> Column:
    """Between two points of the grid: the differences of their 16 numbers, added up."""
    part = lambda p, j: F.shiftrightunsigned(p, 4 * j).bitwiseAND(F.lit(15))
    return sum((F.abs(part(x, j) - part(y, j)) for j in range(1, 16)), F.abs(part(x, 0) - part(y, 0)))


def links(fps: DataFrame) -> DataFrame:
    """``fps``: t, fp, rep; distinct (t, fp). Edges a, b between the reps of fingerprints within 2 bits."""
    entries = _entries(fps)
    shared = entries.groupBy("t", "cell").agg(F.count("*").alias("members")).where("members > 1")
    near = entries.join(shared, ["t", "cell"])
    # cells of few: candidates by the distance of the points, verified by the bits
    few = near.where(F.col("members") <= DENSE).select("t", "cell", "fp", "rep", _grid(F.col("fp")).alias("point"))
    x, y = few.alias("x"), few.alias("y")
    candidate = (F.col("x.t") == F.col("y.t")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & (_manhattan(F.col("x.point"), F.col("y.point")) <= BITS)
    verified = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= BITS
    pairs = x.join(y, candidate & verified).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    # dense cells: by the grid of single bits
    j, up = F.abs("side") - 1, F.col("side") > 0
    shared_bits = []
    for i in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), 4 * j + i)
        clear = F.col("fp").bitwiseAND(bit) == 0
        shared_bits.append(F.when(clear == up, F.col("fp").bitwiseXOR(bit)))
    number = F.when(F.col("side") == 0, F.array("fp")).otherwise(F.array(*shared_bits))
    met = near.where(F.col("members") > DENSE).select("t", "fp", "rep", F.explode(number).alias("number")).where(F.col("number").isNotNull())
    groups = met.groupBy("t", "number").agg(F.collect_set(F.struct("rep", "fp")).alias("in")).where(F.size("in") > 1)
    centre = F.array_min("in")
    stars = groups.select(centre.alias("c"), F.explode("in").alias("x")).where(F.bit_count(F.col("c.fp").bitwiseXOR(F.col("x.fp"))) <= BITS)
    stars = stars.select(F.col("c.rep").alias("a"), F.col("x.rep").alias("b"))
    return pairs.unionAll(stars).where("a != b").distinct()


def link(spark: SparkSession, documents: DataFrame, shingle: int = SHINGLE, tables: int = 1) -> DataFrame:
    """doc_id, fps, component_id of each document."""
    docs = cut(spark, fingerprints(documents, shingle, tables))
    # documents of equal fingerprints are one vertex, named by their fingerprint, or of several tables by its hash with the first
    nodes = docs.groupBy("fps").agg(F.min("doc_id").alias("least"))
    nodes = cut(spark, nodes.withColumn("node", F.struct(F.col("fps")[0].alias("fp"), (F.xxhash64("fps") if tables > 1 else F.lit(0).cast("long")).alias("more"))))
    by_table = nodes.select("node", F.posexplode("fps").alias("t", "fp"))
    reps = by_table.groupBy("t", "fp").agg(F.min("node").alias("rep"))
    edges = links(reps)
    if tables > 1:
        edges = edges.unionAll(by_table.join(reps, ["t", "fp"]).select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a != b"))
    root = components(spark, edges)
    named = nodes.join(root, nodes["node"] == root["v"], "left").select("fps", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fps", "component_id")
    return docs.join(named, "fps").select("doc_id", "fps", "component_id")


def near_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp, near_set, bands: the fingerprint, the set of shingles by its hash, and its keys in each band (none if empty)."""
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fold = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def made(block: Block) -> dict[str, object]:
        fps, sets, bands = [], [], []
        for i in range(block.n):
            every = shingle_hashes(block.bytes_of(i), shingle)
            fps.append(fingerprint(every))
            h = np.unique(every)
            sets.append(xxhash.xxh128_digest(h.tobytes()))
            least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
            for at in range(0, len(h), 4096):
                least = np.minimum(least, (h[at : at + 4096, None] * times).min(axis=0))
            bands.append(mix((mix(least.reshape(BANDS, ROWS)) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist() if len(h) else [])
        return {"fp": fps, "near_set": sets, "bands": bands}

    keyed = documents.select("doc_id", "text", F.md5("text").alias("text_key"))
    return map_blocks(keyed, made, "fp long, near_set binary, bands array<long>", keep=["doc_id", "text_key"])


def _alike(texts: list[bytes], shingle: int) -> np.ndarray:
    """For each text the first one that links of a Jaccard similarity of ``ALIKE`` tie it to."""
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    size = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number))
    root, at = np.arange(len(sets)), np.concatenate([[0], np.cumsum(size)])
    for i in range(1, len(sets)):
        mine = number[at[i] : at[i + 1]]
        both = np.bincount(np.concatenate([owner[ends[k - 1] if k else 0 : ends[k]] for k in mine.tolist()]), minlength=len(sets))[:i]
        linked = np.unique(root[:i][both >= ALIKE * (size[:i] + size[i] - both)])
        if len(linked):
            root[: i + 1][np.isin(root[: i + 1], np.append(linked, i))] = linked[0]
    return root


def set_links(docs: DataFrame) -> DataFrame:
    """a, b: sets of shingles whose texts have fingerprints within ``BITS``; those of one fingerprint are a star. ``docs``: fp, near_set."""
    by_fp = docs.select("fp", "near_set").distinct()
    reps = by_fp.groupBy("fp").agg(F.min("near_set").alias("rep"))
    same = by_fp.join(reps, "fp").where("near_set != rep").select(F.col("rep").alias("a"), F.col("near_set").alias("b"))
    return links(reps.select(F.lit(0).alias("t"), "fp", "rep")).unionAll(same)


def near_copies(spark: SparkSession, documents: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_key, stays: of each component of fingerprints within ``BITS`` and of pairs that share a band and are ``ALIKE``, the row with the least id and text."""
    docs = cut(spark, near_sets(documents, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.coalesce("text_key", F.lit("")).alias("key"))
    nodes = docs.groupBy("near_set").agg(F.min(row).alias("least"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"))
    nodes = cut(spark, nodes)
    entries = nodes.select(F.col("near_set").alias("node"), "text_key", F.posexplode("bands").alias("t", "band"))
    shared = entries.groupBy("t", "band").agg(F.ceil(F.count("*") / CELL).alias("parts"), F.count("*").alias("n")).where("n > 1")
    members = cut(spark, entries.join(shared, ["t", "band"]))
    # a bucket of several parts has a cell for each two of them
    part = F.pmod(F.xxhash64("node", "t"), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: (x != F.col("part")) | (F.col("parts") == 1))
    celled = members.withColumn("part", part).withColumn("other", F.explode(others)).select("t", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "text_key")
    texts = documents.select(F.md5("text").alias("text_key"), "text").join(members.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])

    def linked(cell: pa.Table) -> pa.Table:
        node, root = cell["node"].combine_chunks(), _alike([t.as_py().encode() for t in cell["text"]], shingle)
        tied = root != np.arange(len(root))
        return pa.table({"a": node.filter(pa.array(tied)), "b": node.take(pa.array(root[tied]))})

    alike = celled.join(texts, "text_key").groupBy("t", "band", "i", "j").applyInArrow(linked, "a binary, b binary")
    root = components(spark, cut(spark, set_links(docs)).unionAll(alike))
    named = nodes.join(root, nodes["near_set"] == root["v"], "left").select("near_set", "least", F.coalesce("root", "near_set").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("stays"))
    return docs.join(named.join(least, "root").select("near_set", "stays"), "near_set").select("doc_id", F.coalesce("text_key", F.lit("")).alias("text_key"), (F.col("stays") == row).alias("stays"))


def deduplicate(spark: SparkSession, documents: DataFrame, shingle: int = 5) -> DataFrame:
    """Of each component of near copies the least doc_id (null is the largest), of its texts one; with all columns."""
    gone = cut(spark, near_copies(spark, documents, shingle).where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    same = documents["doc_id"].eqNullSafe(gone["gone_id"]) & (F.coalesce(F.md5(documents["text"]), F.lit("")) == gone["gone_key"])
    kept = documents.join(gone, same, "left_anti")
    return kept.where("doc_id IS NOT NULL").unionAll(kept.where("doc_id IS NULL").dropDuplicates(["text"]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
