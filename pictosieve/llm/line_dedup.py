"""Line dedup with content-defined chunks of lines.

Each document's lines are hashed; a rolling hash over ``WINDOW`` line hashes ends a chunk where it is 0
modulo ``EVERY`` (and ``MOST`` lines do). So boundaries depend on nearby lines only, and shared passages
fall into equal chunks wherever they stand. Chunks of several lines, and as the smallest chunks single
lines of at least ``ANCHOR`` words, are found by hash over all documents; the first owner of a chunk is
the smallest document that has it. Before anything is removed the chunks' bytes are compared: those that
several documents (or places) have are grouped by hash and text, and a hash that stands for two texts is
left alone.

Where a document has a chunk of an earlier owner (or of its own, further up), both are known to have the
same lines in the same order there. What the chunk's edges miss is added line by line: an owner's chunk
comes with the hashes (128 bits) of up to ``BESIDE`` lines before and after it, and neighbouring lines
that equal them belong to the passage, too. Chunks of one owner that meet at the same distance make one
passage. A passage is removed if it holds a chunk of several lines, or ``LONG`` words; lines that are
repeated one by one, or in another order, stay. The owner keeps the passage, so every text survives.

No group is gathered: chunks are counted with partial sums, and what is found is joined back by hash (an
ordinary skewed join of stored rows, which is split). A document's own list is as long as the document.
The texts are shuffled once; both steps that read them share that exchange.

Defined cases: null and empty texts stay as they are; blank lines belong to a passage between its lines;
rows equal in doc_id and text are one document, so all of them stay or lose the same; rows of one doc_id
with other texts are documents of their own, ordered by a hash of the text, as are rows with a null id,
which come after all others; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block
from .common import column, cut, fresh, map_blocks, map_rows, table

WINDOW, EVERY, MOST = 2, 3, 64
#: Words of a single line that is a chunk; lines to either side that a passage may be longer by; words that make a passage.
ANCHOR, BESIDE, LONG = 10, 4, 50
_LAST = (1 << 63) - 1
_DIGEST = 16


def _lines(text: bytes) -> tuple[list[bytes], list[bytes], list[int]]:
    lines = text.split(b"\n")
    digest = xxhash.xxh3_128_digest
    return lines, [digest(x) for x in lines], [len(x.split()) for x in lines]


def chunks(hashes: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each content-defined chunk."""
    out, start, digest = [], 0, xxhash.xxh64_intdigest
    for i in range(len(words)):
        if i + 1 - start >= MOST or digest(b"".join(hashes[max(0, i - WINDOW + 1) : i + 1])) % EVERY == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(words):
        out.append((start, len(words)))
    return out


def units(hashes: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """Chunks of several lines, and single lines with words enough."""
    many = [(a, b) for a, b in chunks(hashes, words) if b - a > 1 and any(words[a:b])]
    return many + [(i, i + 1) for i, n in enumerate(words) if n >= ANCHOR]


def _unit_hash(hashes: list[bytes], a: int, b: int) -> bytes:
    return xxhash.xxh3_128_digest(b"%d " % (b - a) + b"".join(hashes[a:b]))


_PLACE = ["id", "version", "pos"]


def _key(documents: DataFrame) -> list[Column]:
    """id, version (of the text; above all others for a null id)."""
    version = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    none = F.col("doc_id").isNull()
    return [F.when(none, F.lit(_LAST)).otherwise(F.col("doc_id").cast("long")).alias("id"), (version + F.when(none, F.lit(1 << 62)).otherwise(0)).alias("version")]


def _units(keyed: DataFrame) -> DataFrame:
    """h, id, version, pos, before, after: all units; with the hashes of the lines beside them."""

    def made(block: Block):
        ids, versions = column(block, "id"), column(block, "version")
        rows, h, pos, before, after = [], [], [], [], []
        for i in range(block.n):
            _, hashes, words = _lines(block.bytes_of(i))
            for a, b in units(hashes, words):
                rows.append(i)
                h.append(_unit_hash(hashes, a, b))
                pos.append(a)
                before.append(b"".join(hashes[max(0, a - BESIDE) : a]))
                after.append(b"".join(hashes[b : b + BESIDE]))
        at = np.array(rows, np.int64)
        yield {"h": h, "id": ids.take(at), "version": versions.take(at), "pos": pos, "before": before, "after": after}

    return map_rows(keyed, made, "h binary, id long, version long, pos int, before binary, after binary", read=("id", "version"))


def repeated(documents: DataFrame) -> DataFrame:
    """h, owner (id, version, pos, before, after) of units that are at several places."""
    place = F.struct(*_PLACE, "before", "after")
    return _units(documents.select(*_key(documents), "text")).groupBy("h").agg(F.min(place).alias("owner"), F.max(F.struct(*_PLACE)).alias("last")).where("owner.id != last.id OR owner.version != last.version OR owner.pos != last.pos").select("h", "owner")


def passages(text: bytes, found: list[dict]) -> tuple[list[bool], list[int]]:
    """For each line whether it stays, and the lines' words; ``found``: units with h, pos and their owner, which is another place."""
    lines, hashes, words = _lines(text)
    size = {(a, _unit_hash(hashes, a, b)): b - a for a, b in units(hashes, words)}
    by: dict[tuple, list[tuple[int, int, bool]]] = {}  # of an owner and a distance, spans of equal lines
    for x in found:
        a, n = x["pos"], size.get((x["pos"], x["h"]))
        if n is None:
            continue
        b = a + n
        lo, hi, before, after = a, b, x["before"], x["after"]
        while lo > 0 and a - lo < len(before) // _DIGEST and hashes[lo - 1] == before[len(before) - _DIGEST * (a - lo + 1) :][:_DIGEST]:
            lo -= 1
        while hi < len(lines) and hashes[hi] == after[_DIGEST * (hi - b) :][:_DIGEST]:
            hi += 1
        by.setdefault((x["id"], x["version"], a - x["at"]), []).append((lo, hi, n > 1))
    keep = [True] * len(lines)
    for spans in by.values():
        spans.sort()
        at = 0
        while at < len(spans):
            lo, hi, sure = spans[at]
            at += 1
            while at < len(spans) and spans[at][0] <= hi:
                hi, sure = max(hi, spans[at][1]), sure or spans[at][2]
                at += 1
            if sure or sum(words[lo:hi]) >= LONG:
                while lo < hi and not words[lo]:  # blank lines around it stay
                    lo += 1
                while hi > lo and not words[hi - 1]:
                    hi -= 1
                keep[lo:hi] = [False] * (hi - lo)
    return keep, words


def _found(documents: DataFrame, keyed: DataFrame, key: str, name: str) -> DataFrame:
    """``key``, ``name``: for each key of a document with repeated units, these units with their owners; a unit's hash has one text."""
    again = cut(documents.sparkSession, repeated(documents))
    met = _units(documents.select(*_key(documents), "text")).drop("before", "after").join(again, "h")
    lists = met.groupBy(F.struct("id", "version").alias(key)).agg(F.collect_set(F.struct("h", "pos")).alias(name))

    def spelled(block: Block):
        found, out = column(block, name).to_pylist(), []
        for i in range(block.n):
            lines, hashes, words = _lines(block.bytes_of(i))
            size = {(a, _unit_hash(hashes, a, b)): b - a for a, b in units(hashes, words)}
            out += {(x["h"], b"\n".join(lines[x["pos"] : x["pos"] + size[x["pos"], x["h"]]])) for x in found[i]}
        yield {"h": [h for h, _ in out], "unit": [t for _, t in out]}

    # all columns are read, so that the exchange of the texts is the one that shortens them later
    texts = map_rows(keyed.join(lists, key), spelled, "h binary, unit binary", read=[*keyed.columns, name])
    same = texts.groupBy("h", "unit").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n")).where("n = 1").select("h")
    mine = met.where("owner.id != id OR owner.version != version OR owner.pos != pos").join(same, "h", "left_semi")
    unit = F.struct("h", "pos", "owner.id", "owner.version", F.col("owner.pos").alias("at"), "owner.before", "owner.after")
    return mine.groupBy(F.struct("id", "version").alias(key)).agg(F.collect_set(unit).alias(name))


def remove_repeats(documents: DataFrame, names: tuple[str, str, str] | None = None) -> DataFrame:
    """``documents`` with shortened texts; with ``names``, columns for lines, removed lines and removed words."""
    repeats, key = fresh(documents, "repeats"), fresh(documents, "doc_key")
    keyed = documents.withColumn(key, F.struct(*_key(documents)))
    both = keyed.join(_found(documents, keyed, key, repeats), key, "left").drop(key)
    new = fresh(both, "kept_text")
    counts = names or tuple(fresh(both, n) for n in ("n_lines", "removed_lines", "removed_words"))

    def made(block: Block) -> dict[str, object]:
        found, texts, stats = column(block, repeats).to_pylist(), [], []
        nulls = column(block, "text").is_null().to_pylist()
        for i in range(block.n):
            text = block.bytes_of(i)
            keep, words = passages(text, found[i] or [])
            if not all(keep):
                text = b"\n".join(x for x, k in zip(text.split(b"\n"), keep, strict=True) if k)
            texts.append(None if nulls[i] else text.decode("utf-8", "replace"))
            stats.append((len(keep), keep.count(False), sum(n for n, k in zip(words, keep, strict=True) if not k)))
        return {new: texts} | {c: [s[j] for s in stats] for j, c in enumerate(counts)}

    out = map_blocks(both, made, f"`{new}` string, " + ", ".join(f"`{c}` long" for c in counts), keep=[c for c in both.columns if c != "text"])
    return out.withColumnRenamed(new, "text").select(*documents.columns, *(names or ()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ("n_lines", "removed_lines", "removed_words"))
