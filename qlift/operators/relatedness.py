"""Weighted relatedness of query pairs (G2), and chains of related follow-ups.

Words are weighted by how few queries hold them, so that a common word says nothing: the weight is ``1000 ln(N / df)``, rounded to a whole
number, and 0 for a word that more than ``COMMON`` of all queries hold.  Two queries are related by the cosine of their word
sets under these weights.

The document-frequency table is ranked by ``dense_index``.  Its ``HEAD`` most frequent words, the hot keys, are looked up by a
broadcast join, the rest by shuffle (the look-up of the vocabularies).  Rank and weight of a word are packed into one number, so that a query becomes an array of
numbers and the common part of two queries one ``array_intersect`` in the JVM, linear in their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import SUBSUMED_AT, followup_pairs, subsumption_overlap, word_set
from .ordering import dense_index
from .scans import segmented_scan
from .tokens import looked_up

# Derived (ours): words that more than this share of the queries hold weigh nothing; the one cut-off for "related".
COMMON = 0.1
RELATED_COSINE = 0.02
_WEIGHT_BITS = 15  # a weight is below 1000 ln(2 ** 47)


def word_weights(queries: DataFrame, text: str = "query", common: float = COMMON) -> DataFrame:
    """``token, id, n, weight``: every word with its rank by the number of queries that hold it (most first, ties by word)."""
    n = queries.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    counts = queries.select(F.explode(word_set(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = dense_index(counts, ["-n", "token"], "id")
    weight = F.when(F.col("n") > F.lit(common * n), 0).otherwise(F.round(F.log(F.lit(float(n)) / F.col("n")) * 1000))
    return ranked.select("token", "id", "n", weight.cast("bigint").alias("weight"))


def query_vectors(queries: DataFrame, weights: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """``key, words, norm2``: the packed words with a weight, and the sum of the squared weights.  ``key`` must be unique."""
    packed = weights.select("token", "id", (F.col("id") * (1 << _WEIGHT_BITS) + F.col("weight")).alias("packed"))
    items = queries.select(key, F.posexplode(word_set(text)).alias("pos", "token"))
    found = looked_up(items, packed, "token", "packed", [key]).where(_weight(F.col("packed")) > 0)
    v = found.groupBy(key).agg(F.collect_list("packed").alias("words"))  # the words of one query
    return v.withColumn("norm2", _squares(F.col("words")))


def _weight(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _WEIGHT_BITS) - 1))


def _squares(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, p: acc + _weight(p) * _weight(p))


def weighted_relatedness(pairs: DataFrame, vectors: DataFrame, cutoff: float = RELATED_COSINE) -> DataFrame:
    """G2 (derived): ``conv_id, prev_query_id, query_id, cosine, related`` of G1's pairs; no weighted word on a side: not related."""
    a = vectors.select(F.col("query_id").alias("prev_query_id"), F.col("words").alias("_qx_a"), F.col("norm2").alias("_qx_na"))
    b = vectors.select("query_id", F.col("words").alias("_qx_b"), F.col("norm2").alias("_qx_nb"))
    j = pairs.select("conv_id", "prev_query_id", "query_id").join(a, "prev_query_id", "left").join(b, "query_id", "left")
    dot = _squares(F.array_intersect("_qx_a", "_qx_b"))
    cosine = F.round(dot / F.sqrt(F.col("_qx_na").cast("double") * F.col("_qx_nb").cast("double")), 6)
    return j.select("conv_id", "prev_query_id", "query_id", cosine.alias("cosine"), (F.coalesce(cosine, F.lit(0.0)) >= cutoff).alias("related"))


def followup_chains(queries: DataFrame, related: DataFrame) -> DataFrame:
    """G6 (derived): every query with its chain, a longest run of turns of one conversation in which each is related to the one before:
    ``conv_id, turn, query_id, query, chain_id`` (the first query's id), ``chain_pos`` (0-based)."""
    q = queries.select("conv_id", "turn", "query_id", "query").join(related.where("related").select("query_id", F.lit(True).alias("_qx_on")), "query_id", "left")
    s = segmented_scan(q, ["conv_id", "turn"], F.col("_qx_on").isNull(), firsts={"chain_id": F.col("query_id")})
    return s.select("conv_id", "turn", "query_id", "query", "chain_id", F.col("seg_pos").alias("chain_pos"))


def chain_report(chains: DataFrame, drafts: DataFrame, threshold: float = SUBSUMED_AT) -> DataFrame:
    """G6 (derived): per chain its first turn, length, and the first draft (lowest level, then model) of its first query that covers it: every
    follow-up of the chain shares ``threshold`` of its words with the draft.  Chains of one query have no follow-up to cover."""
    per = chains.groupBy("conv_id", "chain_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("length"))
    follow = chains.where("chain_pos > 0").select("conv_id", F.col("chain_id").alias("prev_query_id"), "query_id", "query")
    shares = subsumption_overlap(follow, drafts)
    covers = (shares.groupBy(F.col("prev_query_id").alias("chain_id"), "model_id", "level").agg(F.min(F.coalesce("overlap", F.lit(0.0))).alias("least"))
              .where(F.col("least") >= threshold).groupBy("chain_id").agg(F.min(F.struct("level", "model_id")).alias("_qx_d")))
    return (per.join(covers, "chain_id", "left")
            .select("conv_id", "chain_id", "first_turn", "length", F.col("_qx_d.level").alias("covered_level"), F.col("_qx_d.model_id").alias("covered_model")))


def chains_of(queries: DataFrame, cutoff: float = RELATED_COSINE) -> DataFrame:
    """G1, G2 and G6 in one: the chains of a query table."""
    vectors = query_vectors(queries, word_weights(queries))
    return followup_chains(queries, weighted_relatedness(followup_pairs(queries), vectors, cutoff))
