"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded, documented sample of labelled documents (``Bounds``): the rows of each
class whose hashed id is smallest. Their ids (bounded by the sample) are broadcast to find their
texts; features are made where the texts are, and one task runs FTRL over the sample. Per-coordinate
learning rates and L1 leave a few thousand weights of ``2**BITS``, which every scoring task gets.
Scoring is one pass over all documents without a shuffle; whole texts count.

Features: words, word pairs, pairs with one word between, and the first 4 to 9 bytes of longer words
(so that inflected words share weight). A feature counts once a document, and again as features of its
own if it makes up at least one in 400, 200, 100, 50 and 25 of the words, so that chance finds in long
texts weigh little. The bias is the log-odds of the classes plus an offset: a model of four fifths of
the sample scores the rest, and the offset is the one with the fewest errors there (a clean text that is
marked counts as ``ERROR`` toxic ones that are not).

Defined cases: null and empty texts score by the bias alone; rows stay as many as they are, repeated
rows get equal scores; ids may be null; labels without a document, or null, are ignored, of several
labels of an id the largest counts, and of several texts the least is learned from; without labels of both classes every score is the share
of class 1 (0 without labels). Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ALNUM, Block, Rolling, chained, mix, words
from .common import column, map_blocks, map_rows

BITS = 20
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A feature that is at least one in so many words counts as another one, too.
DENSE = (400, 200, 100, 50, 25)
#: What marking a clean text costs, in toxic texts that are missed; bounds of the bias' offset.
ERROR, OFFSET = 5, 3.0
#: Log-odds that the offset does not lift the bias above, so that a text without evidence is not marked.
NO_EVIDENCE = -1.0
_KINDS = {k: np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i, k in enumerate(("word", "pair", "skip", *PREFIXES))}


@dataclass(frozen=True)
class Bounds:
    """Limits of the training sample and FTRL's settings."""

    positives: int = 3000
    negatives: int = 9000
    epochs: int = 3
    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 7.0
    l2: float = 1.0


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays: text numbers and feature numbers, for each kind of feature; repeats included."""
    w = words(block, ALNUM)
    roll, text = Rolling(w.low), w.text_of().astype(np.int32)
    h = roll.spans(w.starts, w.ends)
    at = lambda x, kind: (mix(x ^ _KINDS[kind]) >> np.uint64(64 - BITS)).astype(np.int32)
    yield text, at(h, "word")
    same = text[1:] == text[:-1]
    yield text[1:][same], at(chained(h, 2), "pair")[same]
    same = text[2:] == text[:-2]
    yield text[2:][same], at(h[:-2] * np.uint64(0x9FB21C651E98DF25) + h[2:], "skip")[same]
    for n in PREFIXES:
        more = np.flatnonzero(w.ends - w.starts > n)
        yield text[more], at(roll.spans(w.starts[more], w.starts[more] + n), n)


def _distinct(text: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, times = np.unique((text.astype(np.int64) << BITS) | index, return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), times


def _as_dense(index: np.ndarray, one_in: int) -> np.ndarray:
    """The feature for one that is at least one in so many words."""
    return (mix(index.astype(np.uint64) + np.uint64(one_in << 32)) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers of all that counts, in order of the texts, each pair once."""
    parts, size = list(features(block)), np.maximum(words(block, ALNUM).counts, 1)
    text, index, times = _distinct(np.concatenate([t for t, _ in parts]), np.concatenate([i for _, i in parts]))
    dense = [times * n >= size[text] for n in DENSE]
    more = [_as_dense(index[x], n) for x, n in zip(dense, DENSE, strict=True)]
    text, index, _ = _distinct(np.concatenate([text, *(text[x] for x in dense)]), np.concatenate([index, *more]))
    return text, index


def _ftrl(rows: list[tuple[np.ndarray, int]], b: Bounds) -> tuple[np.ndarray, np.ndarray, float]:
    # the bias stays at the log-odds of the classes, so that a text without evidence gets their share
    size, share = 1 << BITS, (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    bias = float(np.log(share / (1 - share)))
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    l1 = np.float32(b.l1)

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((b.beta + np.sqrt(n[i])) / b.alpha + b.l2)
        w[np.abs(z[i]) <= l1] = 0
        return w

    for _ in range(b.epochs):
        for i, label in rows:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            was = n[i]
            z[i] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / b.alpha * w
            n[i] = was + g * g
    full = weights(np.arange(size))
    index = np.flatnonzero(full)
    return index, full[index], bias


def _offset(rows: list[tuple[np.ndarray, int]], b: Bounds) -> float:
    """What the bias should be more by, from a fifth of the sample that is left out."""
    index, weight, bias = _ftrl([r for i, r in enumerate(rows) if i % 5], b)
    dense = np.zeros(1 << BITS, np.float32)
    dense[index] = weight
    y = np.array([y for _, y in rows[::5]], bool)
    score = np.array([dense[f].sum() + bias for f, _ in rows[::5]], float)
    if y.all() or not y.any():
        return 0.0
    at = np.sort(score)
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    missed, marked = np.searchsorted(np.sort(score[y]), cuts), (~y).sum() - np.searchsorted(np.sort(score[~y]), cuts)
    cost = missed + ERROR * marked
    best = cuts[cost == cost.min()]
    return float(np.clip(-(best[0] + best[-1]) / 2, -OFFSET, min(OFFSET, max(0.0, NO_EVIDENCE - bias))))


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", bounds: Bounds = Bounds()) -> Model:
    """The model of the labelled documents' ``target`` (0 or 1)."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect() if r.y in (0, 1)}
    if len(totals) < 2:
        share = 1.0 if totals.get(1) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 35.0 if share else -35.0)
    order = F.xxhash64("doc_id")
    sample = None
    for y, most in ((1, bounds.positives), (0, bounds.negatives)):
        part = known.where(F.col("y") == y).select("doc_id", "y", order.alias("o")).orderBy("o", "doc_id").limit(most)
        sample = part if sample is None else sample.unionAll(part)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "o").agg(F.min("text").alias("text"))

    def made(block: Block):
        text, index = counted(block)
        at = np.searchsorted(text, np.arange(block.n + 1))
        index = index.astype(np.int32)
        yield {"y": column(block, "y"), "o": column(block, "o"), "f": [index[at[i] : at[i + 1]].tobytes() for i in range(block.n)]}

    rows = map_rows(texts, made, "y int, o long, f binary", read=("y", "o"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((o, f, y) for b in batches for y, o, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), key=lambda r: r[:2])
        learned = [(np.frombuffer(f, np.int32), y) for _, f, y in got]
        index, weight, bias = _ftrl(learned, bounds)
        bias += _offset(learned, bounds)
        seen = sum(y for _, _, y in got)
        yield pa.RecordBatch.from_pydict({"i": [index.astype(np.int32).tobytes()], "w": [weight.astype(np.float32).tobytes()], "b": [bias], "p": [seen], "n": [len(got) - seen]})

    # of the sample, which is bounded, one task learns
    out = rows.repartition(1).mapInArrow(train, "i binary, w binary, b double, p long, n long").first()
    if out is None or not out.p or not out.n:
        share = totals[1] / sum(totals.values())
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    shift = np.log(totals[1] / out.p) - np.log(totals[0] / out.n)  # the sample's share of class 1 is not the table's
    return Model(np.frombuffer(out.i, np.int32).astype(np.int64), np.frombuffer(out.w, np.float32), out.b + float(shift))


class Scorer:
    """The model as tables by feature: whether it can count, its weight, and its weight at each of ``DENSE``."""

    def __init__(self, model: Model):
        dense, every = model.dense(), np.arange(1 << BITS)
        self.bias, self.weight, self.more = model.bias, dense, [dense[_as_dense(every, n)] for n in DENSE]
        self.counts = np.any([w != 0 for w in (dense, *self.more)], axis=0)

    def __call__(self, block: Block) -> np.ndarray:
        texts, found = [], []
        for text, index in features(block):
            hit = self.counts[index]
            texts.append(text[hit])
            found.append(index[hit])
        text, index, times = _distinct(np.concatenate(texts), np.concatenate(found))
        size = np.maximum(words(block, ALNUM).counts, 1)
        total = self.bias + np.bincount(text, self.weight[index].astype(np.float64), block.n)
        for n, w in zip(DENSE, self.more, strict=True):
            x = times * n >= size[text]
            total += np.bincount(text[x], w[index[x]].astype(np.float64), block.n)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(documents: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with the probability of class 1 as the column ``name``."""
    kept: list[Scorer] = []

    def made(block: Block) -> dict[str, object]:
        if not kept:
            kept.append(Scorer(model))
        return {name: kept[0](block)}

    return map_blocks(documents, made, f"`{name}` double", keep=keep)


def reject(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all columns, whose score is under ``threshold``."""
    from .common import fresh

    name = fresh(documents, "toxic_score")
    return score(documents, model, name).where(F.col(name) < threshold).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc32_mod, table

    documents = table(spark, sf_dir, "documents")
    held = crc32_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = score(documents, fit(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
