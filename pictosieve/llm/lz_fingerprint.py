"""Document fingerprints from Lempel-Ziv phrases.

Each text's UTF-8 bytes are parsed as LZ78 does: the next phrase is the shortest piece that is not in
the dictionary yet. The phrases' hashes make the text's set, and the ``SIZE`` smallest its signature, written as hex.
The likeness of two signatures estimates the Jaccard similarity of the phrase sets (exact for sets of at
most ``SIZE``), which is high for texts that would compress well together.

``with_next`` compares each document with the next one in descending order of doc_id (the last with the
first), and with its own text whose second half is replaced by the next one's beginning. Documents are
dealt into ranges of ids whose bounds are ids of documents (from a distributed quantile sketch), so a
range's first document is known beforehand and is sent to the range before it too: one shuffle of the
texts, no window over the whole table, and each task streams through its range.

Defined cases: null and empty texts have the empty fingerprint; two of these are alike (1), one and
another text are not (0). Null ids come last; rows of one id are ordered by text, so repeated rows follow
one another; a lone document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, mix
from .common import table

#: Hashes in a signature.
SIZE = 64


def feed(tree: dict[int, int], node: int, data: bytes) -> int:
    """Parse on from ``node`` (0: between phrases); gives the node after ``data``.

    ``tree`` is the dictionary: it leads from a phrase's node and the next byte, as one number, to the
    longer phrase's node, which is 256 times its number. A byte that leads nowhere ends a phrase.
    """
    get, new = tree.get, len(tree) << 8
    for byte in data:
        key = node | byte
        to = get(key)
        if to is None:
            new += 256
            tree[key] = new
            node = 0
        else:
            node = to
    return node


def signature(tree: dict[int, int]) -> list[int]:
    """The smallest hashes of the phrases; a phrase's hash continues that of the phrase it prolongs."""
    keys = np.fromiter(tree.keys(), np.int64, len(tree))
    before, byte = keys >> 8, (keys & 255).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(keys) + 1, np.uint64)
    waits = np.arange(len(keys))
    known = np.zeros(len(keys) + 1, bool)
    known[0] = True
    while len(waits):
        ready = known[before[waits]]
        now = waits[ready]
        h[now + 1] = mix(h[before[now]] * np.uint64(0x9E3779B97F4A7C15) + byte[now])
        known[now + 1] = True
        waits = waits[~ready]
    found = h[1:] >> np.uint64(32)
    if len(found) > 4 * SIZE:
        found = np.partition(found, 2 * SIZE)[: 2 * SIZE + 1]
    return np.unique(found)[:SIZE].tolist()


def _text(smallest: list[int]) -> str:
    return "".join(f"{h:08x}" for h in smallest)


def likeness(a: list[int], b: list[int]) -> float:
    if not a or not b:
        return float(a == b)
    x, y = set(a), set(b)
    union = sorted(x | y)[:SIZE] if len(a) == SIZE or len(b) == SIZE else x | y
    return sum(h in x and h in y for h in union) / len(union)


class Parsed:
    """A text's signature, and the state of the parse where its second half begins."""

    __slots__ = ("half", "node", "signature", "stays", "text", "tree")

    def __init__(self, text: str):
        self.text, self.half = text, len(text) // 2
        self.stays = text[: len(text) - self.half]
        tree: dict[int, int] = {}
        start = self.stays.encode()
        self.node = feed(tree, 0, start)
        self.tree = tree.copy()
        feed(tree, self.node, text.encode()[len(start) :])
        self.signature = signature(tree)

    def edited(self, other: str) -> tuple[str, list[int]]:
        """The text with its second half replaced by the beginning of another, and its signature; once."""
        new = other[: self.half]
        feed(self.tree, self.node, new.encode())
        return self.stays + new, signature(self.tree)


def fingerprint(text: str | None) -> str:
    return _text(Parsed(text or "").signature)


def _range(x: Column, bounds: Column, n: int) -> Column:
    """The number of the ``n`` bounds (descending) that are not under ``x``, by bisection; as long for any ``n``."""
    halves = [1 << k for k in reversed(range(n.bit_length()))]
    step = lambda at, h: F.when((at + h <= n) & (F.get(bounds, at + h - 1) >= x), at + h).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step) if n else F.lit(0)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    points = [i / parts for i in range(1, parts)] or [0.5]
    stats = documents.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", points, F.lit(max(10_000, 20 * parts))).alias("at")).first()
    bounds = sorted({b for b in stats["at"] or [] if b != stats["top"]}, reverse=True)
    last = len(bounds)
    posts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one literal
    part = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(_range(F.col("doc_id"), posts, last))
    own = F.struct(part.alias("part"), F.lit(False).alias("ahead"))
    before = F.when(F.get(posts, part - 1) == F.col("doc_id") if bounds else F.lit(False), F.struct((part - 1).alias("part"), F.lit(True).alias("ahead")))
    around = F.when(F.col("doc_id").eqNullSafe(F.lit(stats["top"]).cast("long")), F.struct(F.lit(last).alias("part"), F.lit(True).alias("ahead")))
    dealt = documents.select("doc_id", "text", F.inline(F.filter(F.array(own, before, around), lambda x: x.isNotNull())))
    ranges = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("ahead", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, Parsed] | None = None
        done = False
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for block in blocks(batches):
            rows = []
            for i, (doc_id, ahead) in enumerate(zip(block.rows.column(0).to_pylist(), block.rows.column(2).to_pylist(), strict=True)):
                if done:
                    break
                now = Parsed(block.bytes_of(i).decode("utf-8", "replace"))
                if held:
                    was_id, was = held
                    text, smallest = was.edited(now.text)
                    rows.append((was_id, len(was.text), hashlib.sha256(text.encode()).hexdigest(), _text(was.signature), _text(smallest), likeness(was.signature, smallest), likeness(was.signature, now.signature)))
                held, done = (doc_id, now), ahead
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.select("doc_id", "text", "ahead").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
