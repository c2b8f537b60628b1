"""Conversations and follow-ups.

"Previous turn" is not computed with a window partitioned by conversation: one
conversation may hold a large share of all rows, and a window would sort it in one task.
Instead turns get a global dense index (range partitioning splits even a single hot
conversation) and the previous ``j``-th turn is an equi-join on ``idx - j`` with the same
conversation id: unique keys on both sides, so no join key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, truncate_tail
from .ordering import dense_index

# Derived thresholds (ours): word-set Jaccard for "related", overlap for "subsumed".
RELATED_AT = 0.2
SUBSUMED_AT = 0.5


def previous_rows(df: DataFrame, group: str, order: str, k: int, cols: list[str], keep: list[str] | None = None,
                  how: str = "inner") -> DataFrame:
    """Every row with its up to ``k`` predecessors in ``group`` ordered by ``order``.

    Output: ``group, order, keep..., j, prev_<col>...``; with ``how="left"`` every row keeps
    ``k`` entries (nulls where no predecessor exists), so no join back to the input is needed.
    """
    keep = list(keep or [])
    need = list(dict.fromkeys([group, order, *cols, *keep]))
    idx = dense_index(df.select(*need), [group, order], "_qx_i")
    cur = (idx.select(group, order, *keep, "_qx_i").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k))))
           .withColumn("_qx_p", F.col("_qx_i") - F.col("j")).alias("c"))
    prev = idx.select(F.col("_qx_i").alias("_qx_q"), F.col(group).alias("_qx_g"),
                      *[F.col(c).alias(f"prev_{c}") for c in cols]).alias("p")
    cond = (F.col("c._qx_p") == F.col("p._qx_q")) & (F.col(f"c.{group}") == F.col("p._qx_g"))
    j = cur.join(prev, cond, how)
    return j.select(F.col(f"c.{group}").alias(group), F.col(f"c.{order}").alias(order),
                    *[F.col(f"c.{c}").alias(c) for c in keep], "j", *[f"prev_{c}" for c in cols])


def followup_pairs(queries: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """G1: (previous, current) user queries within a conversation."""
    p = previous_rows(queries, conv, turn, 1, ["query_id", "turn", "query"], keep=["query_id", "query"])
    return p.select(conv, "prev_turn", turn, "prev_query_id", "query_id", "prev_query", "query")


def word_set(c) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(c), " ", -1), lambda w: w != ""))


def jaccard(a, b) -> Column:
    A, B = word_set(a), word_set(b)
    inter = F.size(F.array_intersect(A, B))
    union = F.size(F.array_distinct(F.concat(A, B)))
    return F.try_divide(inter.cast("double"), union.cast("double"))


def lexical_relatedness(pairs: DataFrame, threshold: float = RELATED_AT) -> DataFrame:
    """G2 (derived): word-set Jaccard of the pair and the related / unrelated label."""
    jac = jaccard("prev_query", "query")
    return pairs.select("conv_id", "prev_query_id", "query_id", F.round(jac, 6).alias("jaccard"),
                        (F.coalesce(jac, F.lit(0.0)) >= threshold).alias("related"))


def subsumption_overlap(pairs: DataFrame, drafts: DataFrame) -> DataFrame:
    """G3 (derived): share of the follow-up's words already in the draft made from the previous query."""
    # word sets are made once per query and once per draft, before the join
    d = drafts.select(F.col("query_id").alias("prev_query_id"), "model_id", "level", word_set("draft").alias("_qx_d"))
    j = pairs.select("conv_id", "prev_query_id", "query_id", word_set("query").alias("_qx_q")).join(d, "prev_query_id")
    share = F.try_divide(F.size(F.array_intersect("_qx_q", "_qx_d")).cast("double"), F.size("_qx_q").cast("double"))
    return j.select("conv_id", "prev_query_id", "query_id", "model_id", "level", F.round(share, 6).alias("overlap"))


def followup_reduction(related: DataFrame, overlaps: DataFrame, threshold: float = SUBSUMED_AT) -> DataFrame:
    """G4 (derived): of related follow-ups, the share a draft would have covered, per model and level."""
    j = overlaps.join(related.filter("related").select("query_id"), "query_id")
    return (j.groupBy("model_id", "level")
            .agg(F.count(F.lit(1)).alias("related"), F.count_if(F.col("overlap") >= threshold).alias("subsumed"))
            .withColumn("share", F.round(F.col("subsumed") / F.col("related"), 6)))


def session_context(rows: DataFrame, conv: str, turn: str, text: str, k: int, words: int = 40,
                    sep: str = " | ") -> DataFrame:
    """Up to ``k`` earlier rows (oldest first), each normalised, joined by ``sep``, tail-truncated.

    A group holds the ``k`` candidate predecessors of one row (bounded by ``k``)."""
    p = previous_rows(rows, conv, turn, k, [text], how="left")
    item = F.when(F.col(f"prev_{text}").isNotNull(), F.struct(F.negative("j").alias("o"), normalize(f"prev_{text}").alias("t")))
    return (p.groupBy(conv, turn).agg(F.array_sort(F.collect_list(item)).alias("_c"))
            .select(conv, turn, truncate_tail(F.array_join(F.transform("_c", lambda s: s["t"]), sep), words).alias("context")))


CONTEXT_TYPES = ("last_user", "suggestions", "both", "prefix")


def typed_context(queries: DataFrame, drafts: DataFrame, kind: str, conv: str = "conv_id", turn: str = "turn",
                  sep: str = " | ", words: int = 40) -> DataFrame:
    """The context a generator gets beside the current query, by type.

    ``last_user``: the previous user query; ``suggestions``: the level-1 drafts made for it, by
    model; ``both``: the two joined; ``prefix``: nothing but the query itself.  Normalised and
    tail-truncated; empty where there is no earlier turn.
    """
    if kind not in CONTEXT_TYPES:
        raise ValueError(f"context type {kind!r}: one of {', '.join(CONTEXT_TYPES)}")
    q = queries.select(conv, turn, "query_id")
    if kind == "prefix":
        return q.select("query_id", F.lit("").alias("context"))
    pairs = followup_pairs(queries, conv, turn).select("query_id", "prev_query_id", normalize("prev_query").alias("_qx_u"))
    if kind == "last_user":
        text = pairs.select("query_id", F.col("_qx_u").alias("_qx_c"))
    else:
        said = (drafts.filter("level = 1").groupBy(F.col("query_id").alias("prev_query_id"))
                .agg(F.array_sort(F.collect_list(F.struct("model_id", normalize("draft").alias("d")))).alias("_qx_s")))
        listed = F.array_join(F.transform("_qx_s", lambda s: s["d"]), sep)
        both = pairs.join(said, "prev_query_id", "left")
        text = both.select("query_id", (F.concat_ws(sep, "_qx_u", listed) if kind == "both" else F.coalesce(listed, F.lit(""))).alias("_qx_c"))
    return (q.join(text, "query_id", "left")
            .select("query_id", truncate_tail(F.coalesce("_qx_c", F.lit("")), words).alias("context")))
