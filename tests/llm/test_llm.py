"""The training-data operators on small hard cases, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pictosieve.llm import ann, html_extract, langid, licenses, line_dedup, lz_fingerprint, mixing, packing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, copies long, repeats string, mix int, fps string, n_words string"
WORDS = ["alpha", "beta", "gamma", "delta", "den", "und", "the", "of", "quick", "brown", "fox", "jumps", "Über", "été", "x1"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    passage = "\n".join(prose(rng, 14) for _ in range(6))
    texts = [None, "", " \n\t ", "word", "two words", base, base, base.replace("alpha", "omega", 1), "…—!", "12 34", "x" * 3000, prose(rng, 9000)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 20)}" for _ in range(4)] + [prose(rng, rng.randrange(1, 400)) for _ in range(40)]
    texts += ["Released under the MIT License.", "CC BY-NC cc by nc", "licensed under gnu general public license, version 3", "Apache License, Version 2.0"]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "É", None)[i % 4]) for i, t in enumerate(texts)]
    out += [out[5], out[20], (None, base, None, None), (None, None, "en", "a")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 3, 2, "r", 7, "f", "w") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is None, str(v)) for v in x)


def test_licenses(spark, docs, rows, none):
    got = sorted((tuple(r)[:6] for r in licenses.scan(spark, docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=key)
    want = []
    for i, t, *_ in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(j, label) for label, p in licenses.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=key)
    labels = {r.doc_id: r.labels for r in licenses.scan(spark, docs).collect()}
    assert labels[len(rows) - 4 - 2] == "gpl-3"  # with a word left out
    assert licenses.scan(spark, none).count() == 0


def test_language(spark, docs, rows, none):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwik", "kwoz", "wazk", "zkow"]}
    made = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.fit(train)
    mixed = " ".join(["lorem ipsum"] * 10 + ["zwik kwoz"] * 20)
    test = spark.createDataFrame([(1, mixed), (2, "amet"), (3, None), (4, "12 …"), (5, ""), (5, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(test, model).collect())
    assert got == [(1, "bb"), (2, "aa"), (3, "und"), (4, "und"), (5, "und"), (5, "und")]
    runs = sorted((r.first_word, r.n_words, r.lang) for r in langid.label_words(test.where("doc_id = 1"), model).collect())
    assert [(n, lang) for _, n, lang in runs] == [(20, "aa"), (40, "bb")]
    assert langid.identify(docs, langid.fit(docs), keep=["doc_id"]).count() == len(rows)
    assert langid.fit(none).langs == ()
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none), keep=["doc_id"]).collect()} == {"und"}


def test_language_of_odd_tables(spark):
    made = [(i % 20, "lorem ipsum dolor" if i % 2 else "zwik kwoz wazk", ("aa", "bb")[i % 2 == 0], 1) for i in range(200)] + [(900, "12 34", "cc", 1), (901, None, "cc", 1)]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string, score int")
    model = langid.fit(train)
    assert model.langs == ("aa", "bb")  # nothing can be learned of cc
    out = langid.identify(train, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score", "n_other"]
    assert all(r.lang_pred == (r.lang if r.lang != "cc" else "und") for r in out.collect())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    scores, trans, lengths = rng.normal(size=(150, 3)), rng.normal(size=(3, 3)), [0, 1, 33, 70, 0, 46]
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = langid.marginals(scores, first, trans)
    for a, b in zip(first, first[1:], strict=False):
        p, t = np.exp(scores[a:b]), np.exp(trans)
        alpha, v = [], np.full(3, 1 / 3)
        for x in p:
            v = (v @ t) * x
            v /= v.sum()
            alpha.append(v)
        v = np.ones(3)
        for i in range(b - a - 1, -1, -1):
            want = alpha[i] * v
            assert np.allclose(got[a + i], want / want.sum())
            v = t @ (p[i] * v)
            v /= v.sum()


def test_line_dedup(spark, docs, rows, none):
    out = line_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    before = {r[0]: r[1] for r in rows if r[0] is not None}
    passage = before[12].split("\n")[1:7]
    assert kept[12] == before[12]
    for i in (13, 14, 15):  # all of the passage is gone, the rest stays
        lines = before[i].split("\n")
        assert kept[i] == f"{lines[0]}\n{lines[-1]}" and passage == lines[1:7]
    assert kept[5] == before[5] and kept[6] == "" and kept[0] is None
    assert all(kept[i] == before[i] for i in before if i not in (6, 13, 14, 15))
    assert line_dedup.remove_repeats(none).count() == 0


def shortened(rows):
    """The texts without repeated passages, by comparing lines; ``rows``: (order, text), each order once."""
    D, parts = line_dedup, {}
    for k, t in rows:
        lines, hashes, words = D._lines(t.encode())
        parts[k] = (lines, words, D.units(hashes, words))
    first = {}
    for k, (lines, _, units) in sorted(parts.items()):
        for a, b in sorted(units):
            first.setdefault((b - a, tuple(lines[a:b])), (k, a))
    out = {}
    for k, (lines, words, units) in parts.items():
        spans = {}
        for a, b in units:
            o, at = first[b - a, tuple(lines[a:b])]
            if (o, at) == (k, a):
                continue
            theirs, lo, hi = parts[o][0], a, b
            while a - lo < D.BESIDE and lo > 0 and lo - 1 - a + at >= 0 and theirs[lo - 1 - a + at] == lines[lo - 1]:
                lo -= 1
            while hi - b < D.BESIDE and hi < len(lines) and hi - a + at < len(theirs) and theirs[hi - a + at] == lines[hi]:
                hi += 1
            spans.setdefault((o, a - at), []).append((set(range(lo, hi)), b - a > 1))
        gone = set()
        for some in spans.values():
            every = set().union(*(x for x, _ in some))
            while every:
                run = {min(every)}
                while max(run) + 1 in every and any({max(run), max(run) + 1} <= x or max(run) + 1 == min(x) for x, _ in some):
                    run.add(max(run) + 1)
                every -= run
                if any(sure and x <= run for x, sure in some) or sum(words[i] for i in run) >= D.LONG:
                    told = [i for i in run if words[i]]
                    gone |= {i for i in run if told and min(told) <= i <= max(told)}
        out[k] = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()
    return out


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(77)
    line = [prose(rng, rng.choice((1, 2, 4, 8, 11, 14, 30, 55))) for _ in range(60)] + ["", "  "]
    passages = [[rng.choice(line) for _ in range(rng.randrange(2, 9))] for _ in range(8)]
    texts = []
    for _ in range(120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(line) if rng.random() < 0.2 else prose(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = shortened(enumerate(texts))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(df).collect()}
    assert got == want and sum(want[i] != t for i, t in enumerate(texts)) > 40


def test_line_dedup_keeps_an_order_that_nobody_else_has(spark):
    rng = random.Random(78)
    owned = [prose(rng, 12) for _ in range(8)]
    rows = [(i, f"{prose(rng, 9)}\n{x}\n{prose(rng, 9)}") for i, x in enumerate(owned)] + [(100, "\n".join(owned)), (101, "\n".join(owned[::-1])), (102, f"{prose(rng, 9)}\n" + "\n".join(owned[2:7]))]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i, _ in rows[:-1]} == dict(rows[:-1])  # each line is somebody else's, but not in this order
    assert got[102] == rows[-1][1].split("\n")[0]


def test_line_dedup_rows_with_null_ids(spark):
    rng = random.Random(79)
    texts = ["\n".join(prose(rng, 15) for _ in range(6)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(7, texts[8]), (None, "own"), (None, "own"), ((1 << 63) - 1, texts[3])]
    got = [tuple(r) for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # of the rows with id 7, the one with text 8 is before document 8
    assert sorted(t for i, t in got if i is None) == sorted([""] * 300 + ["own"] * 2)
    assert {i: t for i, t in got if i not in (None, 7)} == {i: "" if i == 8 or i > 300 else t for i, t in rows if i not in (None, 7)}
    assert sorted(t for i, t in got if i == 7) == sorted([texts[7], texts[8]])


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, size=(900, 1))
    x[500:700] = x[500] + rng.normal(size=(200, 16)) * 1e-3
    made = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    made += [(60, None), (80, []), (100, [0.0] * 16), (120, [float("nan")] * 16), (140, [None] * 16), (160, [1.0]), (None, made[3][1]), made[7]]
    made = [r for r in made if not (r[0] in (60, 80, 100, 120, 140, 160) and r[0] == made.index(r))]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit("s"))
    fine = [(i, np.array(v)) for i, v in made if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    got = {}
    for r in sorted(ann.search(spark, df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    hit = total = 0
    for q, near in got.items():
        v = next(v for i, v in fine if i == q)
        want = sorted(((-float((w * v).sum()), i) for i, w in fine if i != q))[:20]
        assert len(near) == 20 and near == sorted(near, key=lambda r: (-r[1], r[0]))
        hit += len({i for _, i in want} & {i for i, _ in near})
        total += len({i for _, i in want})
    assert hit / total >= 0.9
    assert ann.search(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_ranks_few_of_many_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 45_000
    assert ann.VISITS * ann.CANDIDATES < 0.1 * n and n * ann.POSTS // ann.FILE > ann.VISITS  # less than a tenth, and not all files
    x = np.random.default_rng(11).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:15_000] = x[100]  # a third are copies
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/e.parquet")
    got = {}
    for r in ann.search(spark, spark.read.parquet(f"{tmp_path}/e.parquet"), F.col("vec_id") % 300 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, n, 300))
    for i, near in got.items():
        near = sorted(near)
        assert [r for r, *_ in near] == list(range(1, 21)) and all(s == pytest.approx(v[j] @ v[i], abs=1e-9) for _, j, s in near)
        score = np.round(np.where(np.arange(n) == i, -np.inf, v @ v[i]), 12)
        hit += len({j for _, j, _ in near} & set(np.lexsort((np.arange(n), -score))[:20].tolist()))
    assert 0.9 <= hit / 20 / len(got) < 1


def test_ann_shards_and_lists(spark):
    rng = np.random.default_rng(12)
    v, pivots = rng.normal(size=(600, 8)), rng.normal(size=(30, 9))
    u = np.hstack([v, np.zeros((600, 1))])
    shard = ann.Shard(u, v, np.arange(600), pivots, 10)
    for q in rng.normal(size=(20, 8)):
        order = ann._places(np.append(q, 0)[None], pivots, 10)[0]
        place = [{p: 10 - i for i, p in enumerate(o)} for o in ann._places(u, pivots, 10).tolist()]
        agree = np.array([sum(min(w.get(p, 0), 10 - i) for i, p in enumerate(order.tolist())) for w in place])
        few = np.flatnonzero(agree >= np.sort(agree)[-ann.CANDIDATES])
        want = sorted(few, key=lambda j: (-(v[j] * q).sum(), j))[:5]
        assert shard.nearest(q, order, 5)[0].tolist() == want


def fingerprint(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    got = sorted(((r.doc_id, r.fps[0] % (1 << 64), r.component_id) for r in simhash.link(spark, docs).collect()), key=key)
    fps = [(i, fingerprint(t)) for i, t, *_ in rows]
    root = list(range(len(fps)))
    for _ in fps:
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for r, (i, _) in zip(root, fps, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert got == sorted(((i, x, least.get(r)) for (i, x), r in zip(fps, root, strict=True)), key=key)
    assert simhash.link(spark, none).count() == 0
    kept = simhash.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 5 in ids and 6 not in ids and ids.count(20) == 2 and 30 in ids


def test_near_copies_with_edited_words(spark, monkeypatch):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (80, 150, 300, 600) for _ in range(15)]

    def edited(words, share):
        return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]

    texts = [*base, *(edited(w, rng.choice((0.005, 0.01, 0.02, 0.03))) for w in base for _ in range(2))]
    texts += [edited(base[20], 0.012) for _ in range(120)]  # one large group, many of whose pairs are less alike
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root, pairs = list(range(len(texts))), 0
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if len(x & y) >= 0.8 * len(x | y):
                old, new, pairs = max(root[a], root[b]), min(root[a], root[b]), pairs + 1
                root = [new if r == old else r for r in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for cell in (simhash.CELL, 16):  # whole buckets, and buckets dealt over cells
        monkeypatch.setattr(simhash, "CELL", cell)
        kept = {r.doc_id for r in simhash.deduplicate(spark, df).collect()}
        assert pairs > 1000 and kept == set(root)


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    rng = random.Random(41)
    # each shingle of the refrain is repeated, so it decides the bits, while the sets have less than 0.8 in common
    refrain = [f"r{i}" for i in range(31)] * 60
    texts = [" ".join(refrain + [f"w{rng.randrange(10**6)}" for _ in range(n)]) for n in (12, 13, 12)] + [prose(rng, 100)]
    bits = [fingerprint(t, 5) for t in texts]
    assert all((x ^ y).bit_count() <= 2 for x in bits[:3] for y in bits[:3]) and all((x ^ bits[3]).bit_count() > 2 for x in bits[:3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for link in (simhash._alike, lambda texts, shingle: np.arange(len(texts))):  # also without links by MinHashes
        monkeypatch.setattr(simhash, "_alike", link)
        assert sorted(r.doc_id for r in simhash.deduplicate(spark, df).collect()) == [0, 3]


def test_near_copies_go_row_by_row(spark):
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    near = a.replace(" ", " edited ", 1)
    rows = [(1, a), (2, near), (2, b), (None, near), (None, a), (None, c), (None, c), (3, d), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(spark, df).collect()), key=key) == sorted([(1, a), (2, b), (None, c), (3, d), (4, "")], key=key)


def test_simhash_links_all_close_pairs(spark, monkeypatch):
    rng = random.Random(9)
    xs = [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(60)]
    for x in list(xs):
        for d in (1, 2, 3):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            xs.append(y)
    xs = list(dict.fromkeys(xs))
    signed = [x - (1 << 64) if x >> 63 else x for x in xs]
    df = spark.createDataFrame([(0, s, i) for i, s in enumerate(signed)], "t int, fp long, rep long")
    from pictosieve.operators.components import components

    every = {(a, b) for a in range(len(xs)) for b in range(len(xs)) if a < b and (xs[a] ^ xs[b]).bit_count() <= 2}
    for dense in (64, 2):  # all pairs of small cells, stars of dense ones
        monkeypatch.setattr(simhash, "DENSE", dense)
        edges = {tuple(sorted(r)) for r in simhash.links(df).collect()}
        assert edges == every if dense == 64 else edges <= every
    roots = {r.v: r.root for r in components(spark, simhash.links(df)).collect()}
    want = list(range(len(xs)))
    for _ in range(8):
        for a in range(len(xs)):
            for b in range(len(xs)):
                if (xs[a] ^ xs[b]).bit_count() <= 2:
                    want[a] = want[b] = min(want[a], want[b])
    assert all(roots.get(i, i) == want[i] for i in range(len(xs)))


def test_simhash_points_bound_the_bits(spark):
    rng = random.Random(10)
    pairs = [(x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for x in (rng.getrandbits(64) for _ in range(200))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = df.select("a", "b", simhash._manhattan(simhash._grid(F.col("a")), simhash._grid(F.col("b"))).alias("d")).collect()
    for r in got:
        want = sum(abs((r.a >> 4 * j & 15).bit_count() - (r.b >> 4 * j & 15).bit_count()) for j in range(16))
        assert r.d == want <= ((r.a ^ r.b) % (1 << 64)).bit_count()


def test_lz_fingerprint(spark, docs, rows, none):
    def phrases(data):
        seen, at = set(), 0
        for i in range(1, len(data) + 1):
            if data[at:i] not in seen:
                seen.add(data[at:i])
                at = i
        return seen

    rng = random.Random(2)
    for _ in range(200):
        t, o = ("".join(rng.choice("abé ") for _ in range(rng.randrange(80))) for _ in range(2))
        tree = {}
        lz_fingerprint.feed(tree, 0, t.encode())
        assert len(tree) == len(phrases(t.encode()))
        text, signature = lz_fingerprint.Parsed(t).edited(o)
        half = len(t) // 2
        assert text == t[: len(t) - half] + o[:half] and signature == lz_fingerprint.Parsed(text).signature
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in lz_fingerprint.with_next(docs).collect()), key=key)
    order = sorted(((i, t or "", t is not None) for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    want = []
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), lz_fingerprint.fingerprint(t)))
    assert got == sorted(want, key=key)
    assert lz_fingerprint.with_next(none).count() == 0
    assert lz_fingerprint.with_next(docs.where("doc_id = 30")).count() == 1


def test_lz_ranges(spark):
    """The range of an id is the number of bounds not under it, for few and for very many bounds."""
    for n in (0, 1, 2, 7, 8, 5000):
        bounds = list(range(3 * n, 0, -3))
        posts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        ids = spark.range(-2, 3 * n + 5, 1 if n < 10 else 7)
        got = ids.select("id", lz_fingerprint._range(F.col("id"), posts, n).alias("p")).collect()
        assert all(r.p == sum(b >= r.id for b in bounds) for r in got)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><div id="main-menu"><ul><li><a href=1>Home</a></li></ul></div>
<div class="content"><h2>A headline</h2><p>The first   paragraph, with <a href="x">a link</a> &amp; more; so it goes on, and on.<br>A new line, too, of some length.<p>Unclosed <b>second</b> one, which has commas, as texts do.</div>
<div class="comments"><p>A comment, long enough to be taken for text, but it is not.</p></div><div class="cookie-notice">We use cookies, as all do.</div><form><label>Name</label></form><aside>More</aside><footer>&copy; us</footer><script>if (a<b) "<p>x</p>"</script></body></html>"""


def test_html_drops_named_parts_only():
    text = "The article says this, and that; it is long enough to be content of its own."
    p = f"<p>{text}</p>"
    for wrapper in ('div style="overflow:hidden"', 'div class="overflow-hidden"', 'div class="content with-sidebar"', 'div class="layout has-sidebar"', 'div class="sidebar-layout"', 'div title="The hidden city"', 'div data-x="class=ad"', 'div id="header"'):
        name = wrapper.split()[0]
        assert html_extract.main_text(f"<body><{wrapper}><article>{p}</article></{name}></body>") == text
        assert html_extract.main_text(f"<body><{wrapper}>{p}{p}</{name}>{p if wrapper[-8:] != '"header"' else ''}</body>").startswith(f"{text}\n{text}")
    for part in ("div hidden", "div HIDDEN=''", "div aria-hidden=true", 'div class="hidden"', 'div class="x site-footer"', 'div id="side-bar"', 'div role="navigation"', 'ol class="comment-list"', "aside"):
        name = part.split()[0]
        assert html_extract.main_text(f"<body>{p}{p}<{part}><p>{text} Not this.</p></{name}></body>") == f"{text}\n{text}"
    comments = f'<ol class="comment-list"><li><article class="comment-body">{p * 5}</article></li></ol>'
    assert html_extract.main_text(f"<body><article>{p}</article>{comments}</body>") == text


def test_html_keeps_lists_and_tables_between_paragraphs():
    def para(n, marks):
        return ("word " * (n // 5 // marks - 1) + "word, ") * marks

    for n, items, letters in ((600, 10, 40), (300, 15, 30), (2400, 8, 12)):
        item = [f"item{i} ".ljust(letters, "x") for i in range(items)]
        rows = "".join(f"<li>{x}</li>" for x in item)
        page = f"<div>{f'<p>{para(n, 10)}</p>' * 5}<ul>{rows}</ul>{f'<p>{para(n, 10)}</p>' * 5}</div>"
        menu = "<ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(8)) + "</ul>"
        got = html_extract.main_text(f"<body>{menu}{page}</body>").split("\n")
        assert got[5:-5] == item and len(got) == 10 + items
        assert html_extract.main_text(f"<body>{page.replace('<ul>' + rows + '</ul>', menu)}</body>").count("Link") == 0
    cells = [f"c{i:04d}" for i in range(300)]
    table = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in cells) + "</table>"
    for page in (f"<p>{para(800, 12)}</p>{table}", f"<p>{para(800, 12)}</p>{table}<p>{para(800, 12)}</p>"):
        assert html_extract.main_text(f"<article>{page}</article>").split("\n")[1:301] == cells


def test_html_scores_decide(monkeypatch):
    text = "The article says this, and that; it is long enough to be content of its own."
    short = "".join(f"<div>Entry {i}</div>" for i in range(8))
    page = f'<body><div class="promo">Buy this, now; and that, too.</div><div class="x">{short}</div><div class="c"><p>{text}</p><p>{text}</p></div></body>'
    assert html_extract.main_text(page) == f"{text}\n{text}"
    monkeypatch.setattr(html_extract, "SHARE", 0)
    monkeypatch.setattr(html_extract, "SHARE_IN_ARTICLE", 0)
    assert html_extract.main_text(page).split("\n") == ["Buy this, now; and that, too.", *(f"Entry {i}" for i in range(8)), text, text]


def test_html_names_are_a_prior_only():
    text = "The article says this, and that; it is long enough to be content of its own."
    for said in ("content has-sidebar", "content no-sidebar", "post related-topic", "search-result article-body", "hentry share-enabled"):
        assert html_extract.main_text(f'<body><nav>Home</nav><div class="{said}"><h1>Head</h1><p>{text}</p><p>{text}</p></div></body>') == f"Head\n{text}\n{text}"
    page = f"<article><header><h1>Title</h1></header><p>{text}</p><p>Let <math><mi>x</mi></math> be a number, as it is.</p></article><header>Site</header>"
    assert html_extract.main_text(page) == f"Title\n{text}\nLet x be a number, as it is."


def test_html_of_hostile_pages_takes_linear_time():
    import time

    for part, n in (("<p", 500_000), ("<div>x", 160_000), ('<p ">', 200_000), ("</script", 100_000), ("<a '>", 200_000)):
        began = time.time()
        html_extract.main_text(("<script>" if part == "</script" else "") + part * n)
        assert time.time() - began < 30, part
    began = time.time()
    html_extract.main_text("<p" * 500_000)
    assert time.time() - began < 1


def test_html_with_columns_of_the_same_names(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "x", 5)], "page_id long, html string, text string, n_chars int")
    assert html_extract.extract(pages).columns == ["page_id", "html", "text", "n_chars", "_text", "_n_chars"]


def test_html(spark):
    want = "A headline\nThe first paragraph, with a link & more; so it goes on, and on.\nA new line, too, of some length.\nUnclosed second one, which has commas, as texts do."
    assert html_extract.main_text(PAGE) == want
    cases = [None, "", "plain  text", "<p>a", "<p>a<!-- b", "<script>x", "<nav>a</nav>", "a < b", '<p title="a>b">c</p>', "<p" * 2000, "<div>" * 3000 + "deep"]
    made = [(i, "u", h, "x", 1) for i, h in enumerate([*cases, PAGE, PAGE])] + [(None, None, "<p>x</p>", None, None)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, other string, size int")
    got = {r.page_id: r for r in html_extract.extract(pages, keep=["page_id", "url"]).collect()}
    assert [got[i].text for i in range(9)] == ["", "", "plain text", "a", "a", "", "", "a < b", "c"]
    assert got[10].text == "deep" and got[12].text == want and got[None].text == "x" and all(r.n_chars == len(r.text) for r in got.values())


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, j, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for j, a in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.pack(none).count() == 0


def test_packing_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.vocabulary()), packing.encoder(packing.vocabulary())
    for t in ("It's a.b, it’s x., É. é, á. İSTANBUL. ΣΑΣ. 12, 3. <|endoftext|>. a<|endoftext|>b", "a b c\x1cd\x85e", "don't we're, I'LL...", "é ́x 中文。字", "Ⅷ ² ½, ǅ.", "😀.😀 a,, b.."):
        for _ in range(2):
            assert encode(t.encode()) == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes(), t


def test_packing_keeps_what_is_encoded(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary()), random.Random(3)
    monkeypatch.setattr(packing, "KEPT", 300)  # so that pieces go and come again
    said = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 22))) + rng.choice(["", "", ".", ",", "#", ".,"]) for _ in range(900)]
    for _ in range(12):
        texts = [" ".join(rng.choice(said) for _ in range(rng.randrange(60))) for _ in range(9)]
        data = [t.encode() for t in texts]
        ids, at = encode.of(packing.Block(None, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_packing_sums_against_search():
    rng = random.Random(14)
    for _ in range(20):
        there = [0] + [rng.choice((0, 0, 1, 2)) for _ in range(40)]
        sums = packing.Sums(there)
        for _ in range(60):
            total = rng.randrange(1, 41)
            got, want = sums.exact(total), None
            for k in (1, 2, 3):
                every = {t for a in range(total, 0, -1) if there[a] for t in ([(a,)] if k == 1 else [(a, b) for b in range(1, a + 1)] if k == 2 else [(a, b, c) for b in range(1, a + 1) for c in range(1, b + 1)])}
                fits = sorted((t for t in every if sum(t) == total and all(there[x] >= t.count(x) for x in t)), reverse=True)
                if fits:
                    want = fits[0]
                    break
            assert got == want
            for x in got or ():
                there[x] -= 1


def test_packing_slots_of_repeated_lengths():
    rows = packing.slots([((40, 12, 12), 3), ((12,), 2)])
    assert rows == [(40, 0, 3, 0, 1, 0), (12, 0, 6, 0, 2, 40), (12, 6, 8, 3, 1, 0)]


def test_packing_patterns_use_every_piece():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 9) for _ in range(12)}
        used = {}
        for took, n in packing.patterns(counts, 64):
            assert sum(took) <= 64
            for x in took:
                used[x] = used.get(x, 0) + n
        assert used == counts
    assert packing.patterns({40: 5, 24: 3, 10: 4, 14: 2}, 64) == [((40, 24), 3), ((40, 14, 10), 2), ((10, 10), 1)]


def test_toxicity(spark, docs, rows, none):
    rng = random.Random(8)
    made = [(i, prose(rng, 60) + (f" vile{rng.choice(WORDS)} vile{rng.choice(WORDS)}" if i % 4 == 0 else "")) for i in range(400)]
    train = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    assert 0 < len(model.index) < 20_000
    held = toxicity.score(train.where("doc_id >= 300"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    scored = toxicity.score(docs, model, "toxic_probability").collect()
    assert len(scored) == len(rows) and all(0 <= r.toxic_probability <= 1 for r in scored)
    kept = toxicity.reject(train, model)
    assert kept.columns == train.columns and 290 <= kept.count() <= 305
    assert toxicity.score(none, model, "p").count() == 0
    assert {r.p for r in toxicity.score(train, toxicity.fit(train, labels.limit(0)), "p").collect()} < {x / 1e15 for x in range(10)} | {r.p for r in toxicity.score(train, toxicity.fit(train, labels.where("toxic = 0")), "p").collect()}


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(15)
    rows = [(np.array(sorted(rng.sample(range(60), 12) + ([70] if i % 3 == 0 else [])), np.int32), int(i % 3 == 0)) for i in range(120)]
    b = toxicity.Bounds(epochs=2, alpha=0.3, l1=0.8)
    index, weight, bias = toxicity._ftrl(rows, b)
    z, n = {}, {}

    def w(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= b.l1 else -(x - math.copysign(b.l1, x)) / ((b.beta + math.sqrt(n[i])) / b.alpha + b.l2)

    for _ in range(b.epochs):
        for f, y in rows:
            g = 1 / (1 + math.exp(-(sum(w(i) for i in f.tolist()) + bias))) - y
            for i, was in [(i, w(i)) for i in f.tolist()]:
                more = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / b.alpha
                z[i], n[i] = z.get(i, 0) + g - more * was, n.get(i, 0) + g * g
    got = dict(zip(index.tolist(), weight.tolist(), strict=True))
    assert set(got) == {i for i in z if w(i)} and got[70] == max(got.values())
    assert all(got[i] == pytest.approx(w(i), abs=1e-3) for i in got)


def test_toxicity_features_and_scores_by_hand(spark):
    text = "bad word " * 3 + "plain " * 200
    block = toxicity.Block(None, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    _, index = toxicity.counted(block)
    word = int(next(toxicity.features(block))[1][0])
    assert [int(toxicity._as_dense(np.array([word]), n)[0]) in index for n in toxicity.DENSE] == [3 * n >= 206 for n in toxicity.DENSE]
    model = toxicity.Model(np.array([word, *(toxicity._as_dense(np.array([word]), n)[0] for n in toxicity.DENSE)]), np.array([1, 2, 4, 8, 16, 32], np.float32), -3.0)
    assert toxicity.Scorer(model)(block)[0] == pytest.approx(1 / (1 + math.exp(-(1 + 2 + 4 + 8 - 3))))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("quality = 1").collect()  # junk texts are marked by chance
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.8 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.02


def test_mixing(spark, docs, rows, none):
    planned = mixing.plan(docs.select("doc_id", "text", "source")).select("doc_id", "source", "mix.*").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in planned), key=key) == sorted(((i, size(t)) for i, t, *_ in rows), key=key)
    totals = {}
    for _, t, _, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    names = sorted((s for s in totals if s is not None)) + [None]
    weight, target, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(totals.values())
    while len(target) < len(names):
        share = left / sum(weight[s] for s in names if s not in target)
        over = [s for s in names if s not in target and weight[s] * share > 2 * totals[s]]
        for s in over or [s for s in names if s not in target]:
            target[s] = 2 * totals[s] if over else weight[s] * share
        left = 1.5 * sum(totals.values()) - sum(target.values())
    for s in names:
        mine = [r for r in planned if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == totals[s] and 0 <= r.copies <= 2 for r in mine)
        assert abs(sum(r["size"] * r.copies for r in mine) - target[s]) <= max(r["size"] for r in mine)
    again = mixing.plan(docs.select("doc_id", "text", "source").repartition(5)).select("doc_id", "source", "mix.*").collect()
    assert sorted(planned, key=key) == sorted(again, key=key)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(docs.where("text is null")).count() == 0


def test_mixing_with_any_column_names(spark, docs):
    odd = docs.select("*", *(F.lit(1).alias(c) for c in ("r", "s", "rank", "slice", "of", "target", "lambda", "x", "key", "low", "width", "_mix", "before")))
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == mixing.mix(docs).count()


def test_mixing_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, mixing.op10_mixing(spark, sf).collect())) == sorted(con.execute(mixing.ORACLE).fetchall())


def test_newton_solves_tilted_rates(spark):
    rng = random.Random(6)
    made = [(i, prose(rng, rng.randrange(1, 200)), "ab"[i % 2], rng.uniform(0.5, 2)) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, t double")
    out = mixing.plan(df, tilt="t").select("source", "mix.*").collect()
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) <= 200


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    base = [prose(rng, 150) for _ in range(40)]
    rows = [(i, t, "en", "s" + str(i % 3), len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "  ", 1), "en", "s1", 1) for i in range(5)]  # near copies that are not equal lines
    rows += [(200, "vile1 vile2 vile3 " + prose(rng, 20), "en", "s0", 1), (300, None, None, None, None), (301, "", "en", "s0", 0)]
    rows += [(400 + i, f"{prose(rng, 40)} vile{i} vile{i + 1} vile1", "en", "s2", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(400 + i, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert set(ids[0]) == {*range(40), *range(100, 105), 300, 301}
    assert sorted(ids[1]) == sorted(ids[0])
    assert set(ids[2]) == {*range(40), 300}  # the null text and the empty one are alike
    assert set(ids[3]) <= set(range(40)) and set(ids[4]) == set(ids[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).select(*docs.columns)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
