"""Placeholder analytics over drafts.

Per-draft work is column expressions; per model/level reports are partial aggregates
(map-side combine), so a hot model or level never concentrates raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placeholders import fill_first, has_placeholder, options, placeholders
from ..functions.text import normalize, strip_ws

GROUP = ["model_id", "level"]

# Derived thresholds for the draft/query length ratio (ours, not published).
BRIEF_BELOW, VERBOSE_ABOVE = 0.5, 3.0


def extract(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row per placeholder: ``pos`` (0-based) and ``body``."""
    return df.select(*keys, F.posexplode(placeholders(text_col)).alias("pos", "body"))


def explode_options(ph: DataFrame, keys: list[str]) -> DataFrame:
    """One row per option of each placeholder, ``opt_rank`` 0 = most probable."""
    return ph.select(*keys, "pos", F.posexplode(options("body")).alias("opt_rank", "option"))


def n_options(body) -> Column:
    return F.size(F.split(body, "/", -1))


def conforms(level, text) -> Column:
    """E5: L1 none; L2/L3 no body with '/'; L4 every body has two or more options."""
    bodies = placeholders(text)
    return (F.when(level == 1, F.size(bodies) == 0)
            .when(level.isin(2, 3), ~F.exists(bodies, lambda b: b.contains("/")))
            .when(level == 4, F.forall(bodies, lambda b: n_options(b) >= 2))
            .otherwise(F.lit(False)))


def level_conformance(df: DataFrame, text_col: str = "draft", group=GROUP) -> DataFrame:
    c = conforms(F.col("level"), F.col(text_col))
    return (df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(c).alias("conforming"))
            .withColumn("share", F.round(F.col("conforming") / F.col("n"), 6)))


def unresolved(df: DataFrame, text_col: str = "final_query", group=GROUP) -> DataFrame:
    """Final queries still holding a placeholder, per group."""
    return (df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(has_placeholder(text_col)).alias("unresolved"))
            .withColumn("share", F.round(F.col("unresolved") / F.col("n"), 6)))


def placeholder_stats(df: DataFrame, text_col: str = "draft", group=GROUP) -> DataFrame:
    """Share of drafts with any placeholder, mean placeholders per draft, mean options per placeholder."""
    ph = placeholders(text_col)
    n_ph = F.size(ph)
    n_opt = F.aggregate(F.transform(ph, n_options), F.lit(0), lambda a, b: a + b)
    return (df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((n_ph > 0).cast("double")), 6).alias("share_any"),
        F.round(F.avg(n_ph.cast("double")), 6).alias("mean_placeholders"),
        F.round(F.try_divide(F.sum(n_opt).cast("double"), F.sum(n_ph).cast("double")), 6).alias("mean_options")))


def repeated_detail(ph: DataFrame, queries: DataFrame, key: str = "query_id", query_col: str = "query") -> DataFrame:
    """Placeholders whose (stripped) text already occurs in the original query (case-insensitive)."""
    j = ph.join(queries.select(key, query_col), key)
    body = F.lower(strip_ws("body"))
    return j.filter((body != "") & F.lower(F.col(query_col)).contains(body)).drop(query_col)


def word_count(c) -> Column:
    n = normalize(c, lower=False)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ", -1)))


def length_ratio(drafts: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """words(draft) / words(query), labelled brief / ok / verbose."""
    j = drafts.join(queries.select(key, word_count("query").alias("_qx_n")), key)  # counted once per query
    ratio = F.try_divide(word_count("draft").cast("double"), F.col("_qx_n").cast("double"))
    label = (F.when(ratio.isNull(), F.lit(None)).when(ratio < BRIEF_BELOW, "brief")
             .when(ratio > VERBOSE_ABOVE, "verbose").otherwise("ok"))
    return j.select(*[c for c in drafts.columns if c != "draft"], F.round(ratio, 6).alias("ratio"), label.alias("label"))


def vacuous_output(drafts: DataFrame, queries: DataFrame, key: str = "query_id", group=GROUP) -> DataFrame:
    """Empty drafts and drafts equal to the query after normalisation, per group."""
    j = drafts.withColumn("_qx_d", normalize("draft")).join(queries.select(key, normalize("query").alias("_qx_q")), key)
    empty = F.col("_qx_d") == ""
    same = F.col("_qx_d") == F.col("_qx_q")
    return (j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("empty"),
                                  F.count_if(same & ~empty).alias("echo"))
            .withColumn("share_vacuous", F.round((F.col("empty") + F.col("echo")) / F.col("n"), 6)))


def fill(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """E3 as a DataFrame step."""
    return df.withColumn(out_col, fill_first(text_col))
