"""Best-fit packing with exact-complement hashing.

Documents become token ids and an end id; longer ones are cut. A task looks up all white-space pieces of
a block at once, by their first and last eight bytes and their length, in a hash table of what it has
encoded before; the bytes are compared, not only hashes. What it does not know is encoded once, together.
This gives the tokenizer's own ids, as its pieces never span white space, nor a letter and a full stop
or comma.

Only the histogram of lengths (at most ``size`` numbers, whatever the table) goes to the driver. There,
largest first, a length's gap is looked up in indexes of the sums of one, two and three available lengths;
an exact combination is consumed as often as its availability allows, else the largest length that fits
stays in the gap and the search goes on with the rest: best fit.

The patterns make slots: a length's first to last piece, sequences from a number on, a place. A pattern
ends when one of its lengths, x, has fewer pieces left than the pattern takes, which is at most size / x;
the next time x ends a pattern, that takes fewer. So there are at most the sum of size / x over all x, or
17 000 patterns of at most 63 different lengths each, however large the table: this bounds the broadcast.
Pieces get numbers within their length without a large window: counts per length and partition are summed
first, and rows are numbered within a partition's share.

Defined cases: null and empty texts are the end id alone; repeated rows are pieces of their own; null
ids stay null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import Block, mix, word_table, words
from .common import column, cut, map_rows, table

SIZE = 2048
END = 0
#: Pieces whose ids a task keeps; when there are more, those that fewest blocks had go.
KEPT = 700_000
#: Bytes of the pieces that are kept, and of text that is looked up at once; bits of a place in the hash table.
LONGEST, AT_ONCE, SLOT_BITS = 16, 2 << 20, 21


#: What stands between pieces; A-Z are lower-cased, as the tokenizer does.
PIECES = word_table([0x20, *range(0x09, 0x0E)])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, each text's with the end id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = np.zeros(256, np.uint32)
        self.marks[list(b".,")] = np.concatenate(self._ids([".", ","]))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # of each kept piece: its bytes and length, where its ids are, how many, how many blocks had it
        self.head = self.tail = np.zeros(0, np.uint64)
        self.size = self.at = self.count = self.seen = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded together, and how many each has; the last of them ends the word."""
        made = self._ids([" ".join(texts)])[0]
        last = np.flatnonzero(self.ends[made])
        if len(last) != len(texts):
            return self._apart(texts)
        return made, np.diff(last, prepend=-1)

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(texts)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = np.array([t.isalpha() for t in texts], bool)
        count, ids = np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        at = np.zeros(len(texts), np.int64)
        for some, encode in ((np.flatnonzero(plain), self._words), (np.flatnonzero(~plain), self._apart)):
            if len(some):
                made, count[some] = encode([texts[i] for i in some])
                at[some] = len(ids) + np.cumsum(count[some]) - count[some]
                ids = np.concatenate([ids, made])
        return ids[_spans(at, count)], count

    def _enter(self, first: int) -> None:
        """Enter the kept pieces from number ``first`` on in the hash table."""
        i = np.arange(first, len(self.head), dtype=np.int32)
        slot = _slot(self.head[first:], self.tail[first:], self.size[first:])
        while len(i):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = i[free]
            more = self.slots[slot] != i
            i, slot = i[more], (slot[more] + 1) & ((1 << SLOT_BITS) - 1)

    def _find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of pieces, -1 for those that are not kept."""
        out = np.full(len(head), -1, np.int32)
        todo, slot = np.flatnonzero(size <= LONGEST), _slot(head, tail, size)
        while len(todo):
            at = self.slots[slot[todo]]
            todo, at = todo[at >= 0], at[at >= 0]
            same = (self.head[at] == head[todo]) & (self.tail[at] == tail[todo]) & (self.size[at] == size[todo])
            out[todo[same]] = at[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _learn(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray, pieces: list[bytes]) -> None:
        """Keep new pieces."""
        ids, count = self._encoded(pieces)
        if len(self.head) > KEPT:
            stay = np.flatnonzero(self.seen > max(1, np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2]))
            self.ids, self.seen = self.ids[_spans(self.at[stay].astype(np.int64), self.count[stay].astype(np.int64))], self.seen[stay] // 2
            for name in ("head", "tail", "size", "count"):
                setattr(self, name, getattr(self, name)[stay])
            self.at = (np.cumsum(self.count) - self.count).astype(np.int32)
            self.slots[:] = -1
            self._enter(0)
        old, at = len(self.head), len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        for name, new in (("head", head), ("tail", tail), ("size", size), ("at", at), ("count", count), ("seen", np.zeros(len(head)))):
            was = getattr(self, name)
            setattr(self, name, np.concatenate([was, new.astype(was.dtype)]))
        self._enter(old)

    def __call__(self, text: bytes) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit numbers."""
        return self.of(Block(None, np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0].astype("<u4").tobytes()

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the last one's end)."""
        w = words(block, PIECES)
        low, starts, ends = w.low, w.starts, w.ends
        last = low[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        # a full stop or comma after a letter (of ASCII or Latin-1) is a token of its own
        before = np.concatenate([np.zeros(2, np.uint8), low])
        one, two = before[ends], before[np.maximum(ends - 1, 0)]
        letter = (one >= 97) & (one <= 122) | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
        mark = (self.marks[last] > 0) & (ends - starts > 1) & letter
        ends = ends - mark
        size = ends - starts
        # the bytes of a piece, as two numbers
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)]), 8)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
        head = np.ascontiguousarray(eight[starts + 8]).view("<u8").ravel() & keep
        tail = np.where(size > 8, np.ascontiguousarray(eight[ends]).view("<u8").ravel(), np.uint64(0))
        place = self._find(head, tail, size)
        new = np.flatnonzero((place < 0) & (size <= LONGEST))
        if len(new):
            new = new[np.unique(_hash(head[new], tail[new], size[new]), return_index=True)[1]]
            self._learn(head[new], tail[new], size[new], [low[starts[i] : ends[i]].tobytes() for i in new.tolist()])
            place = self._find(head, tail, size)
        known = place >= 0
        at, count = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        at[known], count[known] = self.at[place[known]], self.count[place[known]]
        had = np.zeros(len(self.head), bool)
        had[place[known]] = True
        self.seen += had
        rest, pool = np.flatnonzero(~known), self.ids
        if len(rest):  # long pieces, and any of two new ones with one hash
            spelled: dict[bytes, int] = {}
            which = np.array([spelled.setdefault(low[starts[i] : ends[i]].tobytes(), len(spelled)) for i in rest])
            more, n = self._encoded(list(spelled))
            at[rest], count[rest] = (len(pool) + np.cumsum(n) - n)[which], n[which]
            pool = np.concatenate([pool, more])
        # a place for each piece's ids, its mark, and each text's end
        taken = count + mark
        sums = np.concatenate([[0], np.cumsum(taken)])
        text = w.text_of()
        to = sums[:-1] + text
        bounds = sums[w.first] + np.arange(block.n + 1)
        out = np.full(int(bounds[-1]), END, np.uint32)
        out[_spans(to, count)] = pool[_spans(at, count)]
        out[(to + count)[mark]] = self.marks[last[mark]]
        return out, bounds


def _hash(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(head * np.uint64(0x9E3779B97F4A7C15) + mix(tail + size.astype(np.uint64)))


def _slot(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (_hash(head, tail, size) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Kept from task to task of a worker."""
    return Encoder(path)


def pieces(documents: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def made(block: Block) -> Iterator[dict[str, object]]:
        ids, bounds = encoder(path).of(block)
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        n = np.diff(bounds)
        parts = -(-n // size)
        row = np.repeat(np.arange(block.n), parts)
        piece = _spans(np.zeros(block.n, np.int64), parts)
        start = piece * size
        length = np.minimum(size, n[row] - start)
        begin = (bounds[row] + start).tolist()
        crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(begin, length.tolist(), strict=True)]
        yield {"doc_id": column(block, "doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    return map_rows(documents, made, "doc_id long, piece int, start long, length long, ids_crc32 long", read=("doc_id",), most=AT_ONCE)


class Sums:
    """Sums of one, two and three available lengths, by the sum. Availability only falls, so what a sum's place has passed never comes back."""

    def __init__(self, there: list[int]):
        self.there = there
        self.pairs, self.triples = [max(0, s - 1) for s in range(len(there))], [max(0, s - 2) for s in range(len(there))]

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.there[total] else None

    def pair(self, total: int, less: int = 0) -> tuple[int, int] | None:
        """The two with the largest larger one; ``less``: a length of which one is taken."""
        there, a, passed = self.there, self.pairs[total], False
        while 2 * a >= total:
            b = total - a
            if b and there[a] and there[b] and (a != b or there[a] > 1):
                if there[a] > (a == less) and there[b] > (b == less) and (a != b or there[a] > 1 + (a == less)):
                    return a, b
                passed = True  # only because of the one that is taken
            a -= 1
            if not passed:
                self.pairs[total] = a
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        there, a = self.there, self.triples[total]
        while 3 * a >= total:
            if there[a] and (rest := self.pair(total - a, a)):
                return a, *rest
            a -= 1
            self.triples[total] = a
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        return self.single(total) or self.pair(total) or self.triple(total)


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Lengths that share a sequence, and how many such sequences; ``counts``: pieces of each length."""
    there = [counts.get(length, 0) for length in range(size + 1)]
    sums, out = Sums(there), []
    for first in range(size, 0, -1):
        while there[first]:
            took, gap = [first], size - first
            there[first] -= 1
            while gap:
                found = sums.exact(gap)
                if not found:
                    fits = next((x for x in range(gap, 0, -1) if there[x]), 0)
                    if not fits:
                        break
                    found = (fits,)
                took += found
                gap -= sum(found)
                for x in found:
                    there[x] -= 1
            used = Counter(took)
            more = min(there[x] // k for x, k in used.items())
            for x, k in used.items():
                there[x] -= more * k
            out.append((tuple(took), 1 + more))
    return out


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows: length, its first and (excluded) last piece, the first one's sequence, how many to a sequence, the first one's place."""
    at, sequence, out = Counter(), 0, []
    for took, n in found:
        offset = 0
        for length, k in sorted(Counter(took).items(), reverse=True):
            out.append((length, at[length], at[length] + k * n, sequence, k, offset))
            at[length] += k * n
            offset += k * length
        sequence += n
    return out


def pack(documents: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = documents.sparkSession
    made = cut(spark, pieces(documents, path or vocabulary(), size)).withColumn("part", F.spark_partition_id())
    shares = made.groupBy("length", "part").count()
    counts = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    placed = spark.createDataFrame(slots(patterns(counts, size)), "length long, lo long, hi long, first long, k long, offset long")
    before = shares.withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = made.join(before, ["length", "part"]).withColumn("n", F.col("before") + within)
    p, s = numbered.alias("p"), F.broadcast(placed).alias("s")
    both = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi")))
    i = F.col("n") - F.col("lo")
    place = (F.col("offset") + i % F.col("k") * F.col("p.length")).alias("offset")
    return both.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first") + F.floor(i / F.col("k"))).alias("sequence_id"), place)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
