"""Mixing sources to target weights.

Words are summed per source, every source gets a target share of all words, and each document is
emitted ``floor(rate)`` times plus one Bernoulli copy whose probability is the fraction of the rate
(``rate = target / source size``).  The coin is a hash of the document id and the seed, so reruns agree.

Targets: the sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; no target may pass
``max_repeat`` times its source's size.  What a capped source cannot take is shared by weight among the
others until none is above.  That fixed point has a closed form: with the sources sorted by ``cap / weight``
and the first k capped, the level is ``(total - caps) / rest of the weights``; the largest of these levels
is the final one, and ``target = min(cap, level * weight)``.

Edge cases: a null or empty text has size 0 and takes 0 words; null sources form one source of their own; a
source without words has target 0; repeated rows are mixed one by one (equal ids flip the same coin); an empty
table gives an empty result; other columns of the caller are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_column

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def coin(doc_id: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from 52 bits of an MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: the windows see as many rows as there are sources.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.select(
        "source", "source_size",
        F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).alias("w"),
        (F.col("source_size") * F.lit(max_repeat)).cast("double").alias("cap"))
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("w").over(onward))
    per = per.withColumn("top", F.max("level").over(everything))
    return per.select("source", "source_size", F.least("cap", F.col("top") * F.col("w")).alias("target"))


def mixed(docs: DataFrame, seed: int = 42, max_repeat: int = 3) -> DataFrame:
    """Every document with its part in the mix: ``row`` (the whole input row), ``size, source_size, target, copies``.

    ``docs`` needs ``doc_id, text, source``.  The source table is worked out first and counted: up to
    ``BROADCAST_SOURCES`` rows it is broadcast, so that no row of ``docs`` moves; beyond that it is joined by shuffle.
    """
    d = docs.select(F.struct(F.col("*")).alias("row"), F.col("`source`").alias("source"),
                    word_count(text_column("`text`")).alias("size"))
    t = source_targets(d.select("source", "size"), max_repeat)
    t = saved(t.select(F.col("source").alias("of_source"), "source_size", "target"))
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (coin(F.col("row.doc_id"), seed) < (rate - F.floor(rate))).cast("long")
    return (d.join(t, d["source"].eqNullSafe(t["of_source"]), "left")
            .select("row", "size", "source_size", "target",
                    F.least(F.floor(rate) + extra, F.lit(max_repeat)).cast("long").alias("copies")))


def mix(docs: DataFrame, seed: int = 42, max_repeat: int = 3) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` repeated as often as the mix takes it."""
    return (mixed(docs, seed, max_repeat).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
            .select("row.*"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                              (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
        ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
-- the level solves: sum of least(cap, level * w) = all words; try each number of capped sources
l AS (SELECT a.source, ((SELECT sum(source_size) FROM w)::DOUBLE
        - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.w < a.cap / a.w), 0.0))
        / sum(b.w) FILTER (WHERE b.cap / b.w >= a.cap / a.w) AS level
      FROM w a CROSS JOIN w b GROUP BY a.source),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
