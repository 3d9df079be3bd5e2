"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix, never more than ``MOST`` times its words; what
exceeds this is shared again by weight. The target over the source's words is the number of
copies expected of each of its documents: the whole copies are certain, and for the rest
documents are ranked by the odds of a random number over the odds of inclusion, and taken in
that order until the words left are reached (to within half of the last document).

The prefix sum over a source's ranking is taken over ``BINS`` bins of the rank first, so only
the documents of the one bin that holds the cut are ever ordered; a source with a third of
all documents is never sorted as a whole. What a document gets then follows from its rank and
its source's cut alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barwright.llm.common import documents, stored, word_count

NAME = "op9_mix_sources"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
BINS = 4096


def chance(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that follows from doc_id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); weights repeat along the sources by code point, NULL last.

    Works on one row for each source. Capped sources are those of the smallest cap over
    weight: in that order the level of the others is the words left over the weights left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    # The first source in that order that its level leaves below its cap sets the level of all that follow.
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole)
    return per.select("source", "source_size", F.coalesce(F.least("cap", held["level"] * F.col("weight")), F.col("cap")).alias("target"))


def rank(u: Column, rest: Column) -> Column:
    """Odds of the random number over odds of inclusion; NULL where nothing is left to include."""
    return u / (1 - u) * (1 - rest) / F.nullif(rest, F.lit(0.0))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies): how often each row of ``docs`` enters the mix.

    Size is the number of words (NULL text: 0). Documents without words are never taken. Rows
    that repeat a doc_id have the same random number and are ordered by size. The same rows
    and seed give the same mix; an empty table gives none.
    """
    return _copies(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "copies")


def _copies(docs, weights, share, most, seed) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stored(sized, "mix-sizes")
    cuts = stored(_cuts(sized, weights, share, most, seed), "mix-cuts")
    return _placed(sized, cuts, seed)


def _cuts(sized, weights, share, most, seed) -> DataFrame:
    """(source, source_size, target, sure, rest, cut_rank, cut_id, cut_size): the last document that each source takes."""
    per = targets(sized, weights, share, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("sure", F.floor(expected).cast("long")).withColumn("rest", expected - F.floor(expected))
    per = per.withColumn("left", F.col("target") - F.col("sure") * F.col("source_size"))
    ranked = _ranked(sized, per, seed).where("rest > 0 and size > 0")
    bins = ranked.withColumn("bin", _bin(F.col("rank"))).groupBy("source", "bin").agg(F.sum("size").alias("size"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("until", F.sum("size").over(up)).join(
        per.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))
    )
    # The bin with the cut: the first whose words reach what is left.
    edge = bins.where(F.col("until") >= F.col("left")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("until") - F.col("size")).alias("before")), "bin").alias("e"))
    edge = edge.select(F.col("source").alias("s"), "e.bin", "e.before")
    inside = ranked.withColumn("bin", _bin(F.col("rank"))).alias("r").join(
        edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.s")) & (F.col("r.bin") == F.col("e.bin"))
    )
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("source", "rank", "doc_id", "size", "left", "before").withColumn("until", F.col("before") + F.sum("size").over(order))
    last = inside.where(F.col("until") - F.col("size") / 2 <= F.col("left")).groupBy("source").agg(
        F.max(F.struct("rank", F.col("doc_id").isNull().alias("none"), "doc_id", "size")).alias("last")
    )
    # No document of the bin fits: all before it are taken, all of it are not.
    out = per.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    last = last.withColumnRenamed("source", "s")
    return out.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left", "before")


def _bin(value: Column) -> Column:
    return F.floor(value / (1 + value) * BINS).cast("int")


def _ranked(sized, per, seed) -> DataFrame:
    p = per.select(F.col("source").alias("s"), *[c for c in per.columns if c != "source"])
    joined = sized.join(p, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("rank", rank(chance(F.col("doc_id"), seed), F.col("rest")))


def _placed(sized, cuts, seed) -> DataFrame:
    rows = _ranked(sized, cuts, seed)
    here = F.struct("rank", F.col("doc_id").isNull().alias("none"), "doc_id", "size")
    inside = F.coalesce(here <= F.col("last"), F.lit(False))
    drawn = F.col("bin").isNull() | (_bin(F.col("rank")) < F.col("bin")) | ((_bin(F.col("rank")) == F.col("bin")) & inside)
    extra = F.when((F.col("rest") > 0) & (F.col("size") > 0) & drawn, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("sure") + extra).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Texts do not move: the cuts come to them."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    cuts = stored(_cuts(sized, weights, share, most, seed), "mix-cuts")
    own = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = _placed(rows, cuts, seed).where("copies > 0")
    return taken.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / {float(1 << 52)}::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT level AS held FROM l WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT held FROM h) * weight), cap) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS rest,
         target - floor(expected) * source_size AS left_words, d.source,
         u / (1 - u) * (1 - (expected - floor(expected))) / nullif(expected - floor(expected), 0) AS rank
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), c AS (
  SELECT *, sum(CASE WHEN rest > 0 THEN size ELSE 0 END)
            OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS until
  FROM r
)
SELECT doc_id, size, source_size, target,
       CAST(size * (sure + CASE WHEN rest > 0 AND until - size / 2.0 <= left_words THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
