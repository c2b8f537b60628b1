"""Flagship report: quality leaderboard per model and enhancement level.

fx_queries -> clean + generate (rule-based model) -> placeholders; fx_lrqi -> parse ->
scores -> mean overall; fx_drafts -> placeholder usage and level conformance.  All inputs
are reduced to (model, level) aggregates before they meet, so the final joins are between
tables of models x levels rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.placeholders import placeholders
from ..operators import inference as INF
from ..operators import judging as J
from ..operators import placeholders as PH
from .judging_q import _MEANS, _parsed
from .placeholders_q import _CONF, _PH
from .registry import dtrunc, query
from .standins import enhancer_factory


def leaderboard(spark, sf):
    t = Tables(spark, sf)
    means = J.overall_means(J.score_labels(J.parse_review(t.fx_lrqi)))
    stats = PH.placeholder_stats(t.fx_drafts).select("model_id", "level", "share_any")
    conf = PH.level_conformance(t.fx_drafts).select("model_id", "level", F.col("share").alias("conformance"))
    gen = INF.generate(t.fx_queries, enhancer_factory, batch_size=16, profile="gpt2")
    gen_share = gen.agg(F.round(F.avg((F.size(placeholders("enhanced_query")) > 0).cast("double")), 6).alias("gen_share"))
    board = (means.join(stats, ["model_id", "level"], "left").join(conf, ["model_id", "level"], "left")
             .select("model_id", "level", F.round("mean_score", 6).alias("mean_overall"), F.col("n").alias("n_verdicts"),
                     "share_any", "conformance"))
    return board.withColumn("gen_placeholder_share", gen_share.scalar())


@query("leaderboard", ["fx_queries", "fx_drafts", "fx_lrqi"], _parsed("fx_lrqi") + _MEANS + f"""
, st AS (SELECT model_id, level, round(avg(CASE WHEN len({_PH}) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_any,
           round(count(*) FILTER (WHERE coalesce({_CONF}, true)) / count(*), 6) AS conformance
         FROM fx_drafts GROUP BY model_id, level),
g AS (SELECT round(avg(CASE WHEN len(regexp_extract_all('Explain ' || {dtrunc('lower(query)', 400)} || ' for <Audience>',
        '<([^<>]+)>', 1)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS gen_placeholder_share FROM fx_queries)
SELECT m.model_id, m.level, round(m.mean_score, 6) AS mean_overall, m.n AS n_verdicts, st.share_any, st.conformance,
       g.gen_placeholder_share
FROM means m LEFT JOIN st USING (model_id, level), g""")
def leaderboard_q(spark, sf):
    return leaderboard(spark, sf)
