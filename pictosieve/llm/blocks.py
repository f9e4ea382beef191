"""Vectorised access to the texts of Arrow batches: words, rolling hashes, bounded slices.

A ``Block`` holds the UTF-8 bytes of some consecutive texts in one array, with the offset of
each text. Words and hashes of a whole block come from a few numpy passes, so no Python code
runs per word. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, if no single text is longer.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


@dataclass
class Block:
    rows: pa.RecordBatch
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batches again, in slices of about ``most`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield Block(batch.slice(at, to - at), whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            at = to


def word_table(separators: Iterable[int]) -> np.ndarray:
    """For each byte what it counts as: 0 between words, else itself with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = word_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words of letters and of everything beyond ASCII.
LETTERS = word_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words of anything but blanks and tabs, line ends and form feeds.
SPACED = word_table([0x20, *range(0x09, 0x0E)])


@dataclass
class Words:
    """Words of a block. ``low``: its bytes by the table; ``first[i]``: the first word of text i."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block, table: np.ndarray) -> Words:
    low = table[block.buf]
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = low != 0
    cut = np.zeros(n + 1, bool)
    cut[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return Words(low, starts, ends, np.searchsorted(starts, block.offsets))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, BLOCK_BYTES + 1)
            up, down = np.full(m, _U(_BASE)), np.full(m, _U(pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if m > 8 * BLOCK_BYTES:  # of a giant text nothing is kept
                return up[:n], down[:n]
            cls.up, cls.down = up, down
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any spans of an array of bytes in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k numbers in a row of ``h``."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(0xC2B2AE3D27D4EB4F) + h[i : i + n]
    return mix(out)
