"""Placeholder analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.placeholders import fill_first
from ..operators import placeholders as PH
from .registry import dnorm, dstrip, query

K = ["query_id", "model_id", "level"]
_PH = "regexp_extract_all(draft, '<([^<>]+)>', 1)"

_E1 = f""", ph AS (
  SELECT query_id, model_id, level, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS pos, unnest(b) AS body
  FROM (SELECT query_id, model_id, level, {_PH} AS b FROM fx_drafts) AS x)
"""


@query("e01_extract_placeholders", ["fx_drafts"], _E1 + "SELECT * FROM ph")
def e01(spark, sf):
    d = PH.extract(Tables(spark, sf).fx_drafts, "draft", K)
    return d.withColumn("pos", F.col("pos").cast("bigint"))


@query("e02_options", ["fx_drafts"], _E1 + f"""
SELECT query_id, model_id, level, pos, CAST(generate_subscripts(o, 1) - 1 AS BIGINT) AS opt_rank,
       {dstrip('unnest(o)')} AS option
FROM (SELECT query_id, model_id, level, pos, string_split(body, '/') AS o FROM ph) AS y""")
def e02(spark, sf):
    ph = PH.extract(Tables(spark, sf).fx_drafts, "draft", K)
    out = PH.explode_options(ph, K)
    return out.select(*K, F.col("pos").cast("bigint").alias("pos"), F.col("opt_rank").cast("bigint").alias("opt_rank"), "option")


@query("e03_fill_first", ["fx_drafts"], """
SELECT query_id, model_id, level, regexp_replace(draft, '<([^<>/]+)(?:/[^<>]*)?>|<(?:/[^<>]*)>', '\\1', 'g') AS filled
FROM fx_drafts""")
def e03(spark, sf):
    d = Tables(spark, sf).fx_drafts
    return d.select(*K, fill_first("draft").alias("filled"))


@query("e04_unresolved", ["fx_finals"], """
SELECT model_id, level, count(*) AS n, count(*) FILTER (WHERE regexp_matches(final_query, '<([^<>]+)>')) AS unresolved,
  round(count(*) FILTER (WHERE regexp_matches(final_query, '<([^<>]+)>')) / count(*), 6) AS share
FROM fx_finals GROUP BY model_id, level""")
def e04(spark, sf):
    return PH.unresolved(Tables(spark, sf).fx_finals)


_CONF = f"""CASE WHEN level = 1 THEN len({_PH}) = 0
  WHEN level IN (2, 3) THEN NOT list_bool_or(list_transform({_PH}, lambda b: contains(b, '/')))
  WHEN level = 4 THEN list_bool_and(list_transform({_PH}, lambda b: len(string_split(b, '/')) >= 2))
  ELSE false END"""


@query("e05_level_conformance", ["fx_drafts"], f"""
SELECT model_id, level, count(*) AS n, count(*) FILTER (WHERE coalesce({_CONF}, true)) AS conforming,
  round(count(*) FILTER (WHERE coalesce({_CONF}, true)) / count(*), 6) AS share
FROM fx_drafts GROUP BY model_id, level""")
def e05(spark, sf):
    return PH.level_conformance(Tables(spark, sf).fx_drafts)


@query("e06_placeholder_stats", ["fx_drafts"], f"""
SELECT model_id, level, count(*) AS n, round(avg(CASE WHEN len({_PH}) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_any,
  round(avg(len({_PH})), 6) AS mean_placeholders,
  round(CAST(sum(list_sum(list_transform({_PH}, lambda b: len(string_split(b, '/'))))) AS DOUBLE)
        / nullif(sum(len({_PH})), 0), 6) AS mean_options
FROM fx_drafts GROUP BY model_id, level""")
def e06(spark, sf):
    return PH.placeholder_stats(Tables(spark, sf).fx_drafts)


@query("e07_repeated_detail", ["fx_queries", "fx_drafts"], _E1 + f"""
SELECT ph.query_id, ph.model_id, ph.level, ph.pos, ph.body FROM ph JOIN fx_queries q USING (query_id)
WHERE lower({dstrip('ph.body')}) <> '' AND contains(lower(q.query), lower({dstrip('ph.body')}))""")
def e07(spark, sf):
    t = Tables(spark, sf)
    ph = PH.extract(t.fx_drafts, "draft", K).withColumn("pos", F.col("pos").cast("bigint"))
    return PH.repeated_detail(ph, t.fx_queries)


def _dwords(x: str) -> str:
    n = dnorm(x, lower=False)
    return f"CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END"


@query("e08_length_ratio", ["fx_queries", "fx_drafts"], f"""
SELECT query_id, model_id, level, round(r, 6) AS ratio,
  CASE WHEN r IS NULL THEN NULL WHEN r < 0.5 THEN 'brief' WHEN r > 3.0 THEN 'verbose' ELSE 'ok' END AS label
FROM (SELECT d.query_id, d.model_id, d.level,
        CAST({_dwords('d.draft')} AS DOUBLE) / nullif({_dwords('q.query')}, 0) AS r
      FROM fx_drafts d JOIN fx_queries q USING (query_id)) AS x""")
def e08(spark, sf):
    t = Tables(spark, sf)
    return PH.length_ratio(t.fx_drafts, t.fx_queries)


@query("e09_vacuous_output", ["fx_queries", "fx_drafts"], f"""
SELECT model_id, level, count(*) AS n, count(*) FILTER (WHERE nd = '') AS empty,
  count(*) FILTER (WHERE nd = nq AND nd <> '') AS echo,
  round((count(*) FILTER (WHERE nd = '') + count(*) FILTER (WHERE nd = nq AND nd <> '')) / count(*), 6) AS share_vacuous
FROM (SELECT d.model_id, d.level, {dnorm('d.draft')} AS nd, {dnorm('q.query')} AS nq
      FROM fx_drafts d JOIN fx_queries q USING (query_id)) AS x GROUP BY model_id, level""")
def e09(spark, sf):
    t = Tables(spark, sf)
    return PH.vacuous_output(t.fx_drafts, t.fx_queries)
