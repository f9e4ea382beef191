"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document has a rate, the expected number of its copies in the mix. Among all rates of at most
``MOST`` whose taken words meet each source's target, those nearest to 1 in relative entropy, each
document counting alike, are min(MOST, exp(lambda * size)), with one lambda a source: the dual of the
token constraints is convex, and separate for each source. Newton iterations solve it for all sources at
once: an iteration sums the words taken, and their derivative, over the (source, size) cells, which are the
documents summed once; a step that leaves the interval known to hold lambda becomes a bisection. Sizes are
taken in units of the source's mean. A column may be named to take the place of the size (``tilt``). A
source whose target is ``MOST`` times its words is taken whole so often.

Rates become whole copies: floor(r), and one more for some documents, in a hashed order that prefers
large remainders, until the source's taken words are as near its target as whole documents allow. The
running sums go over (source, slice of the order), with the slices' sums added before: no window over a
whole source. A source's slices divide the range its order really has, by its number of documents, so a
slice holds two times ``SLICE`` at most on average.

Targets: sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a
target stops at ``MOST`` times its source's words and what is over goes to the others by weight.

Defined cases: null and empty texts have size 0 and no copies; a null source is a source; repeated rows
count as often as they are there, and those with one id and one size are alike; null ids are ordered by a
hash of the text; an empty table gives no rows; if all sizes are 0 so are the targets. Extra columns, of
whatever name, are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Fixed values of the mix.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton stops at this relative distance from the targets, or after so many iterations; its longest step.
NEAR, ITERATIONS, STEP = 1e-12, 80, 2.0
#: Iterations of one job.
CHAIN = 4
#: Documents that share a slice of a source's order, about.
SLICE = 5000
#: Sources up to which their table is broadcast.
FEW = 10_000

_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: source, source_size; one row a source. Adds rank, target."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("cap", MOST * F.col("source_size"))
    every = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    # words per weight if this source, and all that are full before it, were not full
    left = SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))).select("source", "source_size", "rank", "target")


def _few(df: DataFrame, n: int) -> DataFrame:
    """A table of a row a source, broadcast if there are few sources."""
    return F.broadcast(df) if n < FEW else df


def solve(spark: SparkSession, cells: DataFrame, aims: DataFrame, sources: int) -> DataFrame:
    """``cells``: rank, x (what lambda multiplies), words; ``aims``: rank, target, source_size. Gives aims with lambda."""
    none = F.lit(None).cast("double")
    free = (F.col("target") < MOST * F.col("source_size")) & (F.col("target") > 0)
    state = cut(spark, aims.where(free).select("rank", F.col("target").alias("aim"), F.lit(0.0).alias("lambda"), none.alias("lo"), none.alias("hi"), none.alias("off")))
    at, most = F.col("lambda"), float(MOST)

    def improved(state: DataFrame) -> DataFrame:
        rate = F.exp(F.least(at * F.col("x"), F.lit(50.0)))
        sums = cells.join(_few(state.drop("off"), sources), "rank").groupBy("rank", "aim", "lambda", "lo", "hi").agg(
            F.sum(F.col("words") * F.least(F.lit(most), rate)).alias("f"), F.sum(F.when(rate < most, F.col("words") * F.col("x") * rate).otherwise(0.0)).alias("df")
        )
        lo, hi = F.when(F.col("f") < F.col("aim"), at).otherwise(F.col("lo")), F.when(F.col("f") >= F.col("aim"), at).otherwise(F.col("hi"))
        # Newton's step on the logarithm of the taken words; in the known interval, or its middle
        step = F.log(F.col("aim") / F.col("f")) * F.col("f") / F.col("df")
        next_ = at + F.greatest(F.lit(-STEP), F.least(F.lit(STEP), F.when(F.col("df") > 0, step).otherwise(F.signum(F.col("aim") - F.col("f")) * STEP)))
        bounded = F.when((next_ <= F.col("lo")) | (next_ >= F.col("hi")), (F.col("lo") + F.col("hi")) / 2).otherwise(next_)
        off = F.abs(F.col("f") / F.col("aim") - 1)
        return sums.withColumn("lo", lo).withColumn("hi", hi).select("rank", "aim", F.when(off < NEAR, at).otherwise(F.coalesce(bounded, next_)).alias("lambda"), "lo", "hi", off.alias("off"))

    for _ in range(ITERATIONS // CHAIN):
        for _ in range(CHAIN):
            state = improved(state)
        state = cut(spark, state)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < NEAR:
            break
    return aims.join(state.select("rank", "lambda"), "rank", "left")


def plan(documents: DataFrame, tilt: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``documents``' columns ``keep`` (all if None) and a struct ``mix`` (with underscores before it if there is one): size, source_size, target, copies.

    Texts that are not kept are read once; else once for the sums and once for the rows.
    """
    spark, name = documents.sparkSession, fresh(documents, "mix")
    side = f"_{name}"
    m, of = (lambda c: F.col(f"{name}.{c}")), (lambda c: F.col(f"{side}.{c}"))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))).cast("binary"))
    drawn = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / 4294967296.0
    size = size_of(F.col("text"))
    x = size.cast("double") if tilt is None else F.coalesce(F.col(tilt).cast("double"), F.lit(1.0))
    sized = documents.withColumn(name, F.struct(size.alias("size"), x.alias("x"), drawn.alias("drawn")))
    needed = ["doc_id", "source", name]
    if keep is not None:
        sized = sized.select(*dict.fromkeys([*keep, *needed]))
    slim = cut(spark, sized if "text" not in sized.columns else sized.select(*needed))
    if "text" not in sized.columns:
        sized = slim

    cells = cut(spark, slim.groupBy("source", m("x").alias("x")).agg(F.sum(m("size")).alias("words"), F.count("*").alias("n")))
    totals = cut(spark, cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"), F.greatest(F.lit(1e-9), F.abs(F.sum(F.col("x") * F.col("n")) / F.sum("n"))).alias("mean")))
    sources = totals.count()
    known = targets(totals.select("source", "source_size")).alias("a").join(totals.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "n", "mean")
    known = cut(spark, known.withColumnRenamed("source", "of"))
    by_rank = cells.join(_few(known, sources), F.col("source").eqNullSafe(F.col("of")))
    found = solve(spark, cut(spark, by_rank.select("rank", (F.col("x") / F.col("mean")).alias("x"), "words")), known, sources)

    def keyed(rows: DataFrame, found: DataFrame, slice_: Column | None = None) -> DataFrame:
        """Rows with their whole copies, and their key in the order of those that may have one more."""
        rate = F.exp(F.least(of("lambda") * (m("x") / of("mean")), F.lit(50.0)))
        rate = F.when(of("target") >= MOST * of("source_size"), F.lit(float(MOST))).when(of("target") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(MOST)), rate))
        base = F.floor(rate + 1e-9).cast("long")
        key = m("drawn") - F.greatest(F.lit(0.0), rate - base)
        out = rows.join(_few(found.select(F.struct("*").alias(side)), sources), F.col("source").eqNullSafe(of("of")))
        parts = [m("size").alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), of("rank").alias("rank"), base.alias("base"), F.when(base < MOST, m("size")).otherwise(0).alias("open"), key.alias("key")]
        if slice_ is not None:
            parts.append(F.floor((key - of("low")) / of("width")).alias("slice"))
        return out.withColumn(name, F.struct(*parts)).drop(side)

    span = keyed(slim, found).groupBy(m("rank").alias("rank")).agg(F.min(m("key")).alias("low"), F.max(m("key")).alias("high"))
    # the slices of a source are of one width
    width = F.greatest(F.lit(1e-12), (F.col("high") - F.col("low")) * F.lit(float(SLICE)) / F.col("n"))
    found = cut(spark, found.join(span, "rank").withColumn("width", width).drop("high"))
    sums = keyed(slim, found, m("slice")).groupBy(m("rank").alias("rank"), m("slice").alias("slice")).agg(F.sum(m("open")).alias("words"), F.sum(m("size") * m("base")).alias("taken"))
    order = W.partitionBy("rank").orderBy("slice")
    before, sure = (F.sum("words").over(order) - F.col("words")).alias("before"), F.sum("taken").over(W.partitionBy("rank")).alias("sure")
    sums = sums.select("rank", "slice", before, sure).select(F.struct("*").alias(side))
    both = keyed(sized, found, m("slice")).join(sums, (m("rank") == of("rank")) & (m("slice") == of("slice")))
    along = W.partitionBy(m("rank"), m("slice")).orderBy(m("key"), "doc_id", m("size")).rowsBetween(W.unboundedPreceding, 0)
    till = of("before") + F.sum(m("open")).over(along)
    more = (m("base") < MOST) & (m("size") > 0) & (till - m("size") / 2 <= m("target") - of("sure"))
    copies = F.when(m("size") > 0, m("base") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    return both.withColumn(name, F.struct(m("size").alias("size"), m("source_size").alias("source_size"), m("target").alias("target"), copies.alias("copies"))).drop(side)


def mix(documents: DataFrame) -> DataFrame:
    """The documents' rows, each as often as the mix takes it, with their columns."""
    name = fresh(documents, "mix")
    planned = plan(documents)
    copy = fresh(planned, "copy")
    return planned.where(F.col(f"{name}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies")))).select(*documents.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {MOST} * source_size AS cap, [{", ".join(map(str, WEIGHTS))}][(rank % {len(WEIGHTS)} + 1)::INT] AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
      WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= level * weight AS filled FROM l),
t AS (SELECT source, source_size, rank, CASE WHEN filled THEN cap::DOUBLE ELSE (SELECT level FROM f WHERE NOT filled ORDER BY cap / weight, rank LIMIT 1) * weight END AS target FROM f),
h AS (SELECT rank, any_value(target) AS target, avg(size)::DOUBLE AS mean FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY rank HAVING any_value(target) > 0 AND any_value(target) < {MOST} * any_value(source_size)),
e AS (SELECT rank, size / mean AS x, sum(size) AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN h USING (rank) GROUP BY rank, size, mean),
g AS (SELECT rank, list(x) AS xs, list(words) AS ws FROM e GROUP BY rank),
b AS (SELECT rank, target, -4096::DOUBLE AS lo, 4096::DOUBLE AS hi, 0 AS step FROM h
      UNION ALL
      SELECT rank, target, CASE WHEN f < target THEN mid ELSE lo END, CASE WHEN f < target THEN hi ELSE mid END, step + 1
      FROM (SELECT b.rank, b.target, lo, hi, step, (lo + hi) / 2 AS mid, list_sum(list_transform(list_zip(xs, ws), lambda p: p[2] * least({MOST}, exp(least(50, p[1] * (lo + hi) / 2)))))::DOUBLE AS f FROM b JOIN g USING (rank) WHERE step < 100)),
n AS (SELECT rank, (lo + hi) / 2 AS dual, mean FROM b JOIN h USING (rank) WHERE step = 100),
o AS (SELECT doc_id, size, source_size, target, rank, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS drawn,
        CASE WHEN target >= {MOST} * source_size THEN {MOST} WHEN target <= 0 THEN 0 ELSE least({MOST}, exp(least(50, dual * (size / mean)))) END::DOUBLE AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n USING (rank)),
r AS (SELECT *, floor(rate + 1e-9)::BIGINT AS base, drawn - greatest(0, rate - floor(rate + 1e-9)) AS key FROM o),
c AS (SELECT *, sum(CASE WHEN base < {MOST} THEN size ELSE 0 END) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS till, sum(size * base) OVER (PARTITION BY rank) AS took FROM r)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN base < {MOST} AND till - size / 2 <= target - took THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
