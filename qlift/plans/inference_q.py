"""H1-H4: batch inference jobs with the deterministic rule-based models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import inference as INF
from .registry import dnorm, dtrunc, query
from .standins import enhancer_factory, responder_factory

_GPT2_CLEAN = dtrunc("lower(query)", 400)

CHECKPOINTS = ["ckpt-1000", "ckpt-2000", "ckpt-3000"]


@query("h01_generate", ["fx_queries"], f"""
SELECT query_id, {_GPT2_CLEAN} AS query, 'Explain ' || {_GPT2_CLEAN} || ' for <Audience>' AS enhanced_query FROM fx_queries""")
def h01(spark, sf):
    return INF.generate(Tables(spark, sf).fx_queries, enhancer_factory, batch_size=16, profile="gpt2")


_RESP = f"'Answer: ' || {dtrunc(dnorm('draft', lower=False), 40)}"


@query("h02_respond", ["fx_drafts"], f"""
SELECT query_id, model_id, level, draft, {_RESP} AS response,
  CAST(len(string_split({dnorm(_RESP, lower=False)}, ' ')) AS BIGINT) AS gen_tokens
FROM fx_drafts""")
def h02(spark, sf):
    return INF.respond(Tables(spark, sf).fx_drafts, responder_factory, text_col="draft", batch_size=12)


@query("h03_sweep", ["fx_queries", "fx_tsv"], f"""
SELECT c.checkpoint, q.query_id, {_GPT2_CLEAN} AS query,
  'Explain ' || {_GPT2_CLEAN} || ' for <Audience> [' || c.checkpoint || ']' AS enhanced_query
FROM fx_queries q, (VALUES {", ".join(f"('{c}')" for c in CHECKPOINTS)}) AS c(checkpoint)
WHERE NOT EXISTS (SELECT 1 FROM fx_tsv t WHERE t.split = 'val' AND c.checkpoint = '{CHECKPOINTS[0]}'
                  AND t.query_id = q.query_id)""")
def h03(spark, sf):
    t = Tables(spark, sf)
    # results already exist for the first checkpoint on the validation split
    done = t.fx_tsv.filter(F.col("split") == "val").select(F.lit(CHECKPOINTS[0]).alias("checkpoint"), "query_id")
    out = INF.sweep(t.fx_queries, CHECKPOINTS, done, enhancer_factory)
    return out.select("checkpoint", "query_id", "query", "enhanced_query")


@query("h04_run_summary", [], """
SELECT coalesce(event_type, 'all') AS event_type, rows, trimmed, ratio,
  printf('%02d:%02d:%05.2f', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s % 3600) / 60) AS INTEGER), s % 60) AS elapsed
FROM (SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE value >= 25) AS trimmed,
        round(CAST(count(*) FILTER (WHERE value >= 25) AS DOUBLE) / count(*), 6) AS ratio,
        date_diff('microsecond', min(ts), max(ts)) / 1e6 AS s
      FROM events GROUP BY ROLLUP (event_type)) AS x""")
def h04(spark, sf):
    e = Tables(spark, sf).events
    return INF.run_summary(e, "event_type", "ts", F.col("value") >= 25)
