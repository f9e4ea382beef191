"""Language identification with a linear-chain conditional random field over words.

Each word has features (first and last 1 to 4 bytes, byte pairs and triples, the word itself as a
lexicon entry; all hashed), each language a weight for each, and pairs of languages of neighbouring
words have learned transitions. Forward-backward gives each word's probabilities in its whole text, so
that code-switched passages are told apart; a document's language is the one with the largest sum.

Training takes a bounded, documented sample (``Bounds``): for each language, the documents whose hashed
id is smallest, of each one run of words. One task joins runs of several languages into code-switched
sequences and maximises their conditional likelihood with AdaGrad. Prediction is one pass over all
documents, without a shuffle. Forward-backward is exact however long a text is: it works on segments of
words side by side, whose transfer matrices are then chained text by text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text if no
language was learned; repeated rows get equal results; null ids are the empty id; nulls in ``lang`` take
no part in training; extra columns are ignored; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, LETTERS, Block, Rolling, Words, mix, words
from .common import column, crc32_mod, fresh, map_blocks, map_rows, table

BITS = 18
SEGMENT = 32
_AFFIXES = (1, 2, 3, 4)


@dataclass(frozen=True)
class Bounds:
    """Limits of the training sample, and how it is learned."""

    documents: int = 200
    words: int = 300
    sequences: int = 1500
    length: int = 96
    run: tuple[int, int] = (6, 60)
    epochs: int = 5
    rate: float = 0.3
    l2: float = 1e-6


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA0761D6478BD642F * kind & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _word_slots(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, features) for affixes and the lexicon."""
    roll, size = Rolling(w.low), w.ends - w.starts
    every = np.arange(len(size))
    out = [(every, _slots(roll.spans(w.starts, w.ends), 1))]
    for n in _AFFIXES:
        some = np.flatnonzero(size >= n)
        out.append((some, _slots(roll.spans(w.starts[some], w.starts[some] + n), 1 + n)))
        out.append((some, _slots(roll.spans(w.ends[some] - n, w.ends[some]), 11 + n)))
    return out


def _gram_slots(w: Words, n: int) -> np.ndarray:
    """The feature of the n bytes from each place on."""
    x = np.zeros(max(0, len(w.low) - n + 1), np.uint64)
    for i in range(n):
        x = x * np.uint64(256) + w.low[i : i + len(x)]
    return _slots(x, 20 + n)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w.starts), weights.shape[1]))
    for some, slot in _word_slots(w):
        out[some] += weights[slot]
    for n in (2, 3):
        sums = np.zeros((len(w.low) + 1, weights.shape[1]))
        slot = _gram_slots(w, n)
        np.cumsum(weights[slot], axis=0, out=sums[1 : len(slot) + 1])
        out += sums[np.maximum(w.ends - n + 1, w.starts)] - sums[w.starts]
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's probabilities, for texts whose words are ``first[i]`` to ``first[i + 1]``.

    Before a text stands a state with every label alike.
    """
    n, k = scores.shape
    if not n:
        return scores
    step = np.exp(transitions - transitions.max())
    lengths = np.diff(first)
    segs = -(-lengths // SEGMENT)
    base = np.concatenate([[0], np.cumsum(segs)])
    text = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(n) - first[text]
    seg, at = base[text] + inner // SEGMENT, inner % SEGMENT
    p = np.ones((base[-1], SEGMENT, k))
    p[seg, at] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
    there = np.zeros((base[-1], SEGMENT), bool)
    there[seg, at] = True
    # of each segment, what it makes of each label before it
    m = np.tile(np.eye(k), (base[-1], 1, 1))
    for t in range(SEGMENT):
        x = (m.reshape(-1, k) @ step).reshape(-1, k, k) * p[:, t, None, :]
        x /= x.sum(axis=(1, 2), keepdims=True)
        m = np.where(there[:, t, None, None], x, m)
    # from segment to segment, all texts side by side, longest first
    order = np.argsort(-segs, kind="stable")
    before, after = np.full((base[-1], k), 1 / k), np.ones((base[-1], k))
    for j in range(1, int(segs.max(initial=0))):
        i = base[order[: np.searchsorted(-segs[order], -j, "left")]] + j
        v = np.einsum("dk,dkl->dl", before[i - 1], m[i - 1])
        before[i] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(segs.max(initial=0)) - 2, -1, -1):
        i = base[order[: np.searchsorted(-segs[order], -(j + 1), "left")]] + j
        v = np.einsum("dkl,dl->dk", m[i + 1], after[i + 1])
        after[i] = v / v.sum(axis=1, keepdims=True)
    alpha, v = np.empty_like(p), before
    for t in range(SEGMENT):
        x = (v @ step) * p[:, t]
        v = np.where(there[:, t, None], x / x.sum(axis=1, keepdims=True), v)
        alpha[:, t] = v
    v = after
    for t in range(SEGMENT - 1, -1, -1):
        alpha[:, t] *= v
        x = (p[:, t] * v) @ step.T
        v = np.where(there[:, t, None], x / x.sum(axis=1, keepdims=True), v)
    out = alpha[seg, at]
    return out / out.sum(axis=1, keepdims=True)


def _learn(w: Words, label: np.ndarray, langs: tuple[str, ...], b: Bounds) -> Model:
    """``label``: of each text. Sequences are drawn with a fixed seed."""
    k, rng = len(langs), np.random.default_rng(7)
    parts = _word_slots(w)
    for n in (2, 3):
        size = np.maximum(w.ends - w.starts - n + 1, 0)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + w.starts[word]
        parts.append((word, _gram_slots(w, n)[place]))
    word, slot = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(word, kind="stable")
    slot = slot[order]
    ptr = np.searchsorted(word[order], np.arange(len(w.starts) + 1))
    texts = [np.flatnonzero((label == i) & (w.counts > 0)) for i in range(k)]
    usable = [i for i in range(k) if len(texts[i])]
    if usable and len(usable) < k:  # a language without words is not learned
        return _learn(w, np.array([usable.index(i) if i in usable else -1 for i in label.tolist()], np.int64), tuple(langs[i] for i in usable), b)
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_w, seen_t = np.full((1 << BITS, k), 1e-6), np.full((k, k), 1e-6)
    if not usable:
        return Model((), weights, trans)

    def sequence() -> tuple[np.ndarray, np.ndarray]:
        at, by, size = [], [], 0
        while size < b.length:
            lang = usable[rng.integers(len(usable))]
            text = rng.choice(texts[lang])
            n = min(int(rng.integers(*b.run)), int(w.counts[text]), b.length - size)
            start = w.first[text] + int(rng.integers(w.counts[text] - n + 1))
            at.append(np.arange(start, start + n))
            by.append(np.full(n, lang))
            size += n
        return np.concatenate(at), np.concatenate(by)

    made = [sequence() for _ in range(b.sequences)]
    for _ in range(b.epochs):
        for i in range(0, len(made), 50):
            at, gold = (np.stack([s[j] for s in made[i : i + 50]]) for j in (0, 1))
            s, t = at.shape
            flat = at.ravel()
            many = ptr[flat + 1] - ptr[flat]
            row = np.repeat(np.arange(len(flat)), many)
            f = slot[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + ptr[flat][row]]
            e = np.zeros((len(flat), k))
            for c in range(k):
                e[:, c] = np.bincount(row, weights[f, c], len(flat))
            p = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30)).reshape(s, t, k)
            step = np.exp(trans)
            a, beta = np.empty((t, s, k)), np.ones((t, s, k))
            v = np.full((s, k), 1 / k)
            for j in range(t):
                v = (v @ step) * p[:, j]
                v /= v.sum(axis=1, keepdims=True)
                a[j] = v
            for j in range(t - 1, 0, -1):
                v = (p[:, j] * beta[j]) @ step.T
                beta[j - 1] = v / v.sum(axis=1, keepdims=True)
            post = a * beta
            post /= post.sum(axis=2, keepdims=True)
            error = -post.transpose(1, 0, 2).reshape(-1, k)
            error[np.arange(len(flat)), gold.ravel()] += 1
            pair = np.einsum("jsk,kl,jsl->jskl", a[:-1], step, p.transpose(1, 0, 2)[1:] * beta[1:])
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            grad_t = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel(), minlength=k * k).reshape(k, k) - pair.sum(axis=(0, 1))
            for c in range(k):
                g = np.bincount(f, error[row, c], 1 << BITS) / s - b.l2 * weights[:, c]
                seen_w[:, c] += g * g
                weights[:, c] += b.rate * g / np.sqrt(seen_w[:, c])
            grad_t = grad_t / s
            seen_t += grad_t * grad_t
            trans += b.rate * grad_t / np.sqrt(seen_t)
    return Model(langs, weights, trans)


def fit(documents: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """The model of the documents' ``lang``."""
    known = documents.where(F.col("lang").isNotNull()).select("doc_id", "lang")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return Model((), np.zeros((1, 0)), np.zeros((0, 0)))
    spark = documents.sparkSession
    # of a language with many documents, those whose hash is under a share are enough to take the smallest from
    share = spark.createDataFrame([(x, i, min(1.0, 3 * bounds.documents / counts[x])) for i, x in enumerate(langs)], "lang string, y int, share double")
    o = F.xxhash64(F.lit("sample"), "doc_id")
    drawn = known.withColumn("o", o).join(F.broadcast(share), "lang").where(F.pmod("o", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    best = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("o", "doc_id"))).where(F.col("rank") <= bounds.documents).select("doc_id", "y", "o").distinct()

    def runs(block: Block):
        w = words(block, LETTERS)
        y, o, made = column(block, "y").to_pylist(), column(block, "o").to_pylist(), []
        for i in range(block.n):
            n = int(w.counts[i])
            at = w.first[i] + o[i] % max(1, n - bounds.words + 1)
            to = min(at + bounds.words, w.first[i + 1])
            made.append(b" ".join(w.low[s:e].tobytes() for s, e in zip(w.starts[at:to], w.ends[at:to], strict=True)))
        yield {"y": y, "o": o, "run": made}

    # of rows that repeat an id, one is learned from
    texts = documents.select("doc_id", "text").join(F.broadcast(best), "doc_id").groupBy("doc_id", "y", "o").agg(F.min("text").alias("text"))
    rows = map_rows(texts, runs, "y int, o long, run binary", read=("y", "o"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["o"], r["run"], r["y"]) for b in batches for r in b.to_pylist())
        data = b"".join(r for _, r, _ in got)
        block = Block(None, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(r) for _, r, _ in got])]).astype(np.int64))
        model = _learn(words(block, LETTERS), np.array([y for *_, y in got], np.int64), langs, bounds)
        used = np.flatnonzero(np.abs(model.weights).max(axis=1, initial=0) > 1e-3)
        yield pa.RecordBatch.from_pydict({"i": [used.astype(np.int32).tobytes()], "w": [model.weights[used].astype(np.float32).tobytes()], "t": [model.transitions.tobytes()], "n": [len(model.langs)], "l": [list(model.langs)]})

    # of the sample, which is bounded, one task learns
    out = rows.repartition(1).mapInArrow(train, "i binary, w binary, t binary, n long, l array<string>").first()
    if out is None or not out.n:
        return Model((), np.zeros((1, 0)), np.zeros((0, 0)))
    langs = tuple(out.l)
    weights = np.zeros((1 << BITS, len(langs)), np.float32)
    weights[np.frombuffer(out.i, np.int32)] = np.frombuffer(out.w, np.float32).reshape(-1, len(langs))
    return Model(langs, weights, np.frombuffer(out.t).reshape(len(langs), -1))


def _lettered(block: Block, w: Words) -> np.ndarray:
    """Whether each text has a letter; only texts without ASCII letters are looked at one by one."""
    ascii_letters = np.concatenate([[0], np.cumsum((w.low >= 97) & (w.low <= 122))])
    out = ascii_letters[block.offsets[1:]] > ascii_letters[block.offsets[:-1]]
    for i in np.flatnonzero(~out & (w.counts > 0)):
        out[i] = any(map(str.isalpha, block.bytes_of(i).decode("utf-8", "replace")))
    return out


def _share(model: Model):
    """The model as something small to send: weights that are not zero."""
    used = np.flatnonzero(np.abs(model.weights).max(axis=1, initial=0) > 0)
    return used, model.weights[used], model.langs, model.transitions


def _unshare(sent) -> Model:
    used, some, langs, transitions = sent
    weights = np.zeros((1 << BITS, max(1, len(langs))), np.float32)
    if len(used):
        weights[used] = some
    return Model(langs, weights, transitions)


def identify(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with lang_pred, score (mean probability of it over the words), and n_other: words that are likelier of another language; underscores before a name that a kept column has."""
    sent, kept = _share(model), []
    held = documents.select(*keep) if keep is not None else documents
    lang_pred, score_, n_other = (fresh(held, c) for c in ("lang_pred", "score", "n_other"))

    def made(block: Block) -> dict[str, object]:
        w = words(block, LETTERS)
        if not sent[2]:
            return {lang_pred: ["und"] * block.n, score_: np.zeros(block.n), n_other: np.zeros(block.n, np.int64)}
        if not kept:
            kept.append(_unshare(sent))
        m = kept[0]
        p = marginals(emissions(w, m.weights), w.first, m.transitions)
        sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        total = sums[w.first[1:]] - sums[w.first[:-1]]
        best = total.argmax(axis=1)
        ok = _lettered(block, w)
        score = np.where(ok, np.clip(total[np.arange(block.n), best] / np.maximum(1, w.counts), 0, 1), 0.0)
        text = w.text_of()
        other = np.bincount(text, p.argmax(axis=1) != best[text], block.n).astype(np.int64)
        return {lang_pred: [m.langs[j] if x else "und" for j, x in zip(best, ok, strict=True)], score_: score, n_other: np.where(ok, other, 0)}

    most = 4 * BLOCK_BYTES // max(4, len(model.langs))
    return map_blocks(documents, made, f"`{lang_pred}` string, `{score_}` double, `{n_other}` long", keep=keep, most=most)


def label_words(documents: DataFrame, model: Model) -> DataFrame:
    """Runs of words of one language: doc_id, first_word, n_words, lang."""
    sent, kept = _share(model), []

    def made(block: Block):
        if not sent[2]:
            return
        if not kept:
            kept.append(_unshare(sent))
        m, w = kept[0], words(block, LETTERS)
        lang, text = marginals(emissions(w, m.weights), w.first, m.transitions).argmax(axis=1), w.text_of()
        new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])])[: len(lang)])
        rows = text[new]
        yield {"doc_id": column(block, "doc_id").take(pa.array(rows)), "first_word": new - w.first[rows], "n_words": np.diff(np.append(new, len(lang))), "lang": [m.langs[j] for j in lang[new]]}

    return map_rows(documents, made, "doc_id long, first_word long, n_words long, lang string", read=("doc_id",))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc32_mod(F.col("doc_id"), 4) == 2
    out = identify(documents, fit(documents.where(~held)), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_other")
