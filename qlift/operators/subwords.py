"""Sub-word merges learned from the corpus (C1 re-aimed, C13).

The corpus is counted once into a table of different words, so the rounds that follow depend on its vocabulary and not on its length.  A
word is written as its symbols, each between two spaces (`` l  o  w  </w> ``), which makes a merge a literal ``replace``.  The most
frequent pair of neighbours is the one row a round brings to the driver; the words never leave Spark.

Pair counts are a table of their own.  A merge changes the pairs of the words that hold it and of no other, so a round takes the
old pairs of these words away and adds their new ones; the rest of the counts stands as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .tokens import tokenize

WORD_END = "</w>"  # fixed value: the symbol that ends a word


def word_table(df: DataFrame, text: str) -> DataFrame:
    """``word, n, seg``: the different words with their counts, cut into characters and the end sign."""
    words = df.select(F.explode(tokenize(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    symbols = F.concat(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)), F.array(F.lit(WORD_END)))
    return words.withColumn("seg", F.concat(F.lit(" "), F.array_join(symbols, "  "), F.lit(" ")))


def _pairs(words: DataFrame, seg: str, n: Column) -> DataFrame:
    """``left, right, n`` per pair of neighbours of every word, a pair as often as it stands there."""
    s = words.select(F.split(F.substring(seg, 2, 1 << 30), "  ").alias("s"), n.alias("n"))
    s = s.select(F.transform("s", lambda x: F.rtrim(x)).alias("s"), "n")  # the last symbol's closing space
    pairs = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return s.select(F.explode(pairs).alias("p"), "n").where("p.right IS NOT NULL").select("p.left", "p.right", "n")


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n <> 0")


def learn_merges(df: DataFrame, text: str, k: int) -> DataFrame:
    """The first ``k`` merges: ``rank`` (1-based), ``left``, ``right``, ``n`` (the pair's count when it was merged).

    Each is the most frequent pair of neighbouring symbols in the words as merged so far, ties by left, then right symbol (code point
    order).  Fewer rows if no pair is left.  Of three equal symbols the first two merge.
    """
    spark = df.sparkSession
    word_tables, pair_tables = Stored(spark, "words"), Stored(spark, "pairs")
    words = word_tables.put(word_table(df, text))
    pairs = pair_tables.put(_summed(_pairs(words, "seg", F.col("n"))))
    merges = []
    for rank in range(1, k + 1):
        top = pairs.orderBy(F.col("n").desc(), "left", "right").limit(1).collect()
        if not top:
            break
        left, right, n = top[0]["left"], top[0]["right"], top[0]["n"]
        merges.append((rank, left, right, n))
        if rank == k:
            break
        pair, merged = F.lit(f" {left}  {right} "), F.lit(f" {left}{right} ")
        held = F.contains(F.col("seg"), pair)
        touched = words.where(held).select("n", "seg", F.replace("seg", pair, merged).alias("new"))
        delta = _pairs(touched, "new", F.col("n")).unionByName(_pairs(touched, "seg", -F.col("n")))
        pairs = pair_tables.put(_summed(pairs.unionByName(delta)))
        words = word_tables.put(words.withColumn("seg", F.when(held, F.replace("seg", pair, merged)).otherwise(F.col("seg"))))
        word_tables.forget(1)
        pair_tables.forget(1)
    return spark.createDataFrame(merges, "rank bigint, left string, right string, n bigint")
