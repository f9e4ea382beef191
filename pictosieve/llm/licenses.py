"""License scans by diagonal voting.

Every text gives its rolling word 3-gram hashes with their positions; they meet the 3-grams of all
license templates in a broadcast join (the templates are fixed and few: ``MOST_GRAMS``). Each match
votes for the diagonal (position in the text less position in the template). Diagonals of a template
that lie near one another are merged, so that added or dropped words do not break a span, and a span
counts if enough of the template's 3-grams take part, and all of the phrases that tell it from its likes. Votes are exact: the join compares the words as
well as the hashes. A base phrase is found where one diagonal holds all of its 3-grams.

Before the join, hashes that no template has are dropped (a runtime filter on the low bits, without
false negatives), so the join and the one shuffle carry only matches and a short row a document.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows each get their
row; a null id is an id of its own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import ALNUM, Block, Rolling, chained, words
from .common import column, map_rows, table

K = 3
#: Diagonals of at most this many words apart belong to one span.
SLACK = 3
#: Share of a template's 3-grams that a span must hold.
COVER = 0.5
#: Bound of the broadcast table.
MOST_GRAMS = 5000

#: The phrases whose places are reported, with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Notices of public licenses, as words, and phrases that tell each from its likes.
NOTICES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general", "license version 3"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license", "the bsd license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-nc", "creative commons attribution noncommercial", "commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike", "commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public", "license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public", "license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def _grams(phrase: str) -> list[str]:
    w = phrase.split()
    return [" ".join(w[j : j + K]) for j in range(len(w) - K + 1)]


def templates() -> list[tuple[int, bool, str, int, int, int, str]]:
    """Rows: template, whether it is a base phrase, label, its 3-grams' number, those it needs (as bits), place, the 3-gram."""
    out = []
    for i, (base, (label, phrase, *keys)) in enumerate([*((True, x) for x in BASE), *((False, x) for x in NOTICES)]):
        grams = _grams(phrase)
        assert 0 < len(grams) <= 62, phrase
        need = sum(1 << grams.index(g) for g in {g for key in keys for g in _grams(key)})
        out += [(i, base, label, len(grams), need, j, g) for j, g in enumerate(grams)]
    assert len(out) <= MOST_GRAMS
    return out


def _hashed(block: Block):
    w = words(block, ALNUM)
    grams = chained(Rolling(w.low).spans(w.starts, w.ends), K)
    return w, grams


def _gram_hash(gram: str) -> int:
    data = np.frombuffer(gram.encode(), np.uint8)
    _, h = _hashed(Block(None, data, np.array([0, len(data)])))
    return int(h.view(np.int64)[0])


def _votes(documents: DataFrame) -> DataFrame:
    """A row for each document with its number of words, and one for each 3-gram that a template may have."""
    known = np.zeros(1 << 16, bool)
    known[[_gram_hash(g) & 0xFFFF for *_, g in templates()]] = True

    def made(block: Block):
        w, grams = _hashed(block)
        ids = column(block, "doc_id")
        whole = Rolling(block.buf).spans(block.offsets[:-1], block.offsets[1:]).view(np.int64)
        yield {"doc_id": ids, "th": whole, "n_words": w.counts, "gram": [None] * block.n, "words": [None] * block.n, "pos": [None] * block.n}
        text = w.text_of()
        at = np.flatnonzero(known[grams & np.uint64(0xFFFF)] & (text[: len(grams)] == text[K - 1 :])) if len(grams) else np.zeros(0, np.int64)
        said = [b" ".join(w.low[w.starts[i + j] : w.ends[i + j]].tobytes() for j in range(K)).decode("utf-8", "replace") for i in at]
        rows = text[at]
        yield {"doc_id": ids.take(rows.tolist()) if len(at) else ids.slice(0, 0), "th": whole[rows], "n_words": [None] * len(at), "gram": grams[at].view(np.int64), "words": said, "pos": at - w.first[rows]}

    return map_rows(documents, made, "doc_id long, th long, n_words long, gram long, words string, pos long", read=("doc_id",))


def scan(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """For each document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = [(_gram_hash(g), g, i, base, label, n, need, j) for i, base, label, n, need, j, g in templates()]
    posted = spark.createDataFrame(rows, "gram long, words string, template int, base boolean, label string, n_grams int, need long, tpos int")
    doc = ["doc_id", "th"]
    met = _votes(documents).join(F.broadcast(posted), ["gram", "words"], "left")
    met = met.where(F.col("template").isNotNull() | F.col("n_words").isNotNull()).repartition(*doc)
    diagonals = met.groupBy(*doc, "template", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"),
        F.first("base").alias("base"), F.first("label").alias("label"), F.first("n_grams").alias("n_grams"), F.first("need").alias("need"),
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
    )
    along = W.partitionBy(*doc, "template").orderBy("diag")
    new = F.coalesce(F.col("diag") - F.lag("diag").over(along) > SLACK, F.lit(True)).cast("int")
    numbered = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(along))
    whole = F.col("base") & (F.bit_count("mask") == F.col("n_grams"))
    spans = numbered.groupBy(*doc, "template", "span").agg(
        F.first("base").alias("base"), F.first("label").alias("label"), (F.bit_count(F.bit_or("mask")) / F.first("n_grams")).alias("cover"),
        (F.bit_or("mask").bitwiseAND(F.first("need")) == F.first("need")).alias("own"),
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("diag"))).alias("first_word"), F.max(F.when(whole, F.col("diag"))).alias("last_word"),
        F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"),
    )
    kept = (F.col("n_base") > 0) | ~F.col("base") & F.col("own") & (F.col("cover") >= COVER)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        listed(F.when(F.col("n_base") > 0, F.col("label"))).alias("base_labels"), listed(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.round("cover", 6))), F.lit(0.0)).alias("score"), F.sum("copies").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("th", "copies", "copy")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def oracle() -> str:
    values = ", ".join(f"({i}, {str(base).lower()}, '{label}', {n}, {need}::BIGINT, {j}, '{g}')" for i, base, label, n, need, j, g in templates())
    return f"""
WITH t(template, base, label, n_grams, need, tpos, gram) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS pos FROM d),
v AS (SELECT r, template, any_value(base) AS base, any_value(label) AS label, any_value(n_grams) AS n_grams, any_value(need) AS need, pos - tpos AS diag, bit_or(1::BIGINT << tpos) AS mask
      FROM (SELECT r, pos, {" || ' ' || ".join(f"w[pos + {i + 1}]" for i in range(K))} AS gram FROM g) JOIN t USING (gram) GROUP BY r, template, pos - tpos),
m AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diag) AS span
      FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, template ORDER BY diag) <= {SLACK} THEN 0 ELSE 1 END AS new FROM v)),
s AS (SELECT r, any_value(base) AS base, any_value(label) AS label, bit_count(bit_or(mask)) / any_value(n_grams) AS cover, (bit_or(mask) & any_value(need)) = any_value(need) AS own,
      count(*) FILTER (base AND bit_count(mask) = n_grams) AS n_base, min(diag) FILTER (base AND bit_count(mask) = n_grams) AS first_word, max(diag) FILTER (base AND bit_count(mask) = n_grams) AS last_word
      FROM m GROUP BY r, template, span),
a AS (SELECT r, sum(n_base) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0 OR NOT base AND own AND cover >= {COVER}) AS labels,
      max(round(cover, 6)) FILTER (n_base > 0 OR NOT base AND own AND cover >= {COVER}) AS score FROM s GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
