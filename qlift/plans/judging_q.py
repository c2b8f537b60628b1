"""F1-F16: judge requests, verdict parsing, score reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions import templates as TP
from ..operators import conversations as CV
from ..operators import judging as J
from .registry import dnorm, dstrip, query
from .text_q import _d_render

K = ["query_id", "model_id", "level"]


def _rid(metric: str, a: str) -> str:
    return f"md5(concat_ws(':', '{metric}', {a}.query_id, {a}.model_id, {a}.level))"


_NO_MODEL = "CAST(NULL AS BIGINT) AS model_id, CAST(NULL AS BIGINT) AS level"


@query("f01_judge_requests", ["fx_queries", "fx_drafts", "fx_finals"], f"""
, pairs AS (SELECT * FROM (SELECT query_id, query, lag(query_id) OVER w AS prev_query_id, lag(query) OVER w AS prev_query
     FROM fx_queries WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE prev_query_id IS NOT NULL),
rel AS (SELECT query_id, {_NO_MODEL}, prev_query, query FROM pairs),
sub AS (SELECT p.query_id, d.model_id, d.level, p.prev_query, p.query, d.draft FROM pairs p JOIN fx_drafts d ON d.query_id = p.prev_query_id),
ans AS (SELECT q.query_id, {_NO_MODEL}, q.query, c.text AS response FROM fx_queries q
        JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1 AND c.role = 'assistant')
SELECT {_rid('eqdq', 'd')} AS request_id, 'eqdq' AS metric, d.query_id, d.model_id, d.level,
  {_d_render(TP.JUDGE_TEMPLATES['eqdq'], {'query': 'q.query', 'draft': 'd.draft'})} AS prompt
FROM fx_drafts d JOIN fx_queries q USING (query_id)
UNION ALL
SELECT {_rid('aue', 'd')}, 'aue', d.query_id, d.model_id, d.level,
  {_d_render(TP.JUDGE_TEMPLATES['aue'], {'draft': 'd.draft', 'final': 'f.final_query'})}
FROM fx_drafts d JOIN fx_finals f USING (query_id, model_id, level)
UNION ALL
SELECT {_rid('ha', 'd')}, 'ha', d.query_id, d.model_id, d.level,
  {_d_render(TP.JUDGE_TEMPLATES['ha'], {'query': 'q.query', 'draft': 'd.draft'})}
FROM fx_drafts d JOIN fx_queries q USING (query_id)
UNION ALL
SELECT {_rid('lrqi', 'a')}, 'lrqi', a.query_id, a.model_id, a.level,
  {_d_render(TP.JUDGE_TEMPLATES['lrqi'], {'query': 'a.query', 'response': 'a.response'})} FROM ans a
UNION ALL
SELECT {_rid('rel', 'r')}, 'rel', r.query_id, r.model_id, r.level,
  {_d_render(TP.JUDGE_TEMPLATES['rel'], {'previous': 'r.prev_query', 'current': 'r.query'})} FROM rel r
UNION ALL
SELECT {_rid('sub', 's')}, 'sub', s.query_id, s.model_id, s.level,
  {_d_render(TP.JUDGE_TEMPLATES['sub'], {'previous': 's.prev_query', 'draft': 's.draft', 'current': 's.query'})} FROM sub s""")
def f01(spark, sf):
    t = Tables(spark, sf)
    qd = t.fx_drafts.join(t.fx_queries.select("query_id", "query"), "query_id")
    df_ = t.fx_drafts.join(t.fx_finals, K)
    none = {"model_id": F.lit(None).cast("bigint"), "level": F.lit(None).cast("bigint")}
    pairs = CV.followup_pairs(t.fx_queries).select("query_id", "query", "prev_query_id", "prev_query")
    drafts = t.fx_drafts.select(F.col("query_id").alias("prev_query_id"), "model_id", "level", "draft")
    replies = (t.conversations.filter(F.col("role") == "assistant")
               .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")))
    answers = t.fx_queries.join(replies, ["conv_id", "turn"])
    return (J.judge_requests("eqdq", qd, {"query": "query", "draft": "draft"})
            .unionByName(J.judge_requests("aue", df_, {"draft": "draft", "final": "final_query"}))
            .unionByName(J.judge_requests("ha", qd, {"query": "query", "draft": "draft"}))
            .unionByName(J.judge_requests("lrqi", answers.withColumns(none), {"query": "query", "response": "response"}))
            .unionByName(J.judge_requests("rel", pairs.withColumns(none), {"previous": "prev_query", "current": "query"}))
            .unionByName(J.judge_requests("sub", pairs.join(drafts, "prev_query_id"), {"previous": "prev_query", "draft": "draft", "current": "query"})))


def _ord(x: str) -> str:
    b = f"regexp_replace(lower({dstrip(x)}), ' effort$', '')"
    return (f"CAST(CASE {b} WHEN 'very low' THEN 1 WHEN 'low' THEN 2 WHEN 'high' THEN 3 "
            f"WHEN 'very high' THEN 4 END AS BIGINT)")


def _status(x: str) -> str:
    b = f"regexp_replace(lower({dstrip(x)}), ' effort$', '')"
    return f"CASE WHEN {b} IN ('very low', 'low', 'high', 'very high') THEN 'ok' WHEN {b} = 'na' THEN 'na' ELSE 'invalid' END"


def _jf(field: str) -> str:
    return f"CASE WHEN json_valid(raw) AND starts_with(ltrim(raw), '{{') AND json_type(raw, '$.{field}') = 'VARCHAR' THEN json_extract_string(raw, '$.{field}') END"


_EFFORT = f""", effort AS (
  SELECT query_id, model_id, level, explanation, comprehension, modification,
         {_ord('comprehension')} AS comprehension_score, {_ord('modification')} AS modification_score
  FROM (SELECT query_id, model_id, level, {_jf('explanation')} AS explanation,
          {_jf('comprehension_score')} AS comprehension, {_jf('modification_score')} AS modification FROM fx_aue) AS a)
"""


@query("f02_parse_effort", ["fx_aue"], _EFFORT + "SELECT * FROM effort")
def f02(spark, sf):
    return J.parse_effort(Tables(spark, sf).fx_aue)


_LINE_OK = "regexp_matches(l, '^- [^:]+:') AND NOT starts_with(l, '- Review ')"
_CRIT = lambda l: dstrip(f"regexp_extract({l}, '^- ([^:]+):(.*)$', 1)")
_LAB = lambda l: dstrip(f"regexp_extract({l}, '^- ([^:]+):(.*)$', 2)")


def _parsed(table: str) -> str:
    return f""", lines AS (
  SELECT query_id, model_id, level, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS l
  FROM (SELECT query_id, model_id, level, regexp_split_to_array(raw, '\\r?\\n') AS ls FROM {table}) AS x),
parsed AS (SELECT query_id, model_id, level, line_no, {_CRIT('l')} AS criterion, {_LAB('l')} AS label
  FROM lines WHERE {_LINE_OK}),
scored AS (SELECT *, {_ord('label')} AS score, {_status('label')} AS status FROM parsed)
"""


@query("f03_parse_review", ["fx_lrqi"], _parsed("fx_lrqi") + "SELECT query_id, model_id, level, line_no, criterion, label FROM parsed")
def f03(spark, sf):
    return J.parse_review(Tables(spark, sf).fx_lrqi)


@query("f04_parse_binary", ["fx_binary"], f"""
SELECT query_id, model_id, level,
  CASE {_jf('Score')} WHEN 'Highly Likely' THEN true WHEN 'Highly Unlikely' THEN false END AS verdict,
  {_jf('Explanation')} AS explanation
FROM fx_binary""")
def f04(spark, sf):
    return J.parse_binary(Tables(spark, sf).fx_binary)


@query("f05_ordinal", ["fx_lrqi"], _parsed("fx_lrqi") + "SELECT * FROM scored")
def f05(spark, sf):
    return J.score_labels(J.parse_review(Tables(spark, sf).fx_lrqi))


_EXPECTED = "[" + ", ".join(f"'{c}'" for c in J.LRQI_CRITERIA) + "]"


@query("f06_judge_validity", ["fx_lrqi"], f"""
SELECT model_id, level, count(*) AS verdicts, count(*) FILTER (WHERE len(ls) = 0) AS unparsable,
  CAST(sum(CASE WHEN len(ls) > 0 THEN {len(J.LRQI_CRITERIA)} - len(list_filter(list_distinct(list_transform(ls, lambda l: {_CRIT('l')})),
       lambda c: list_contains({_EXPECTED}, c))) ELSE 0 END) AS BIGINT) AS missing_criteria,
  CAST(sum(len(list_filter(ls, lambda l: ({_status(_LAB('l'))}) = 'invalid'))) AS BIGINT) AS unknown_labels
FROM (SELECT model_id, level, list_filter(regexp_split_to_array(raw, '\\r?\\n'), lambda l: {_LINE_OK}) AS ls FROM fx_lrqi) AS x
GROUP BY model_id, level""")
def f06(spark, sf):
    return J.judge_validity(Tables(spark, sf).fx_lrqi, J.LRQI_CRITERIA)


def _dwords(x: str) -> str:
    n = dnorm(x, lower=False)
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END"


@query("f07_explanation_limit", ["fx_aue", "fx_binary"], _EFFORT + f"""
SELECT 'aue' AS source, query_id, model_id, level, CAST({_dwords('explanation')} AS BIGINT) AS n_words
FROM effort WHERE {_dwords('explanation')} >= {J.EFFORT_WORD_LIMIT}
UNION ALL
SELECT 'binary', query_id, model_id, level, CAST({_dwords(_jf('Explanation'))} AS BIGINT)
FROM fx_binary WHERE {_dwords(_jf('Explanation'))} >= {J.BINARY_WORD_LIMIT}""")
def f07(spark, sf):
    t = Tables(spark, sf)
    return (J.explanation_limit(J.parse_effort(t.fx_aue), "aue", J.EFFORT_WORD_LIMIT)
            .unionByName(J.explanation_limit(J.parse_binary(t.fx_binary), "binary", J.BINARY_WORD_LIMIT)))


@query("f08_na_consistency", ["fx_eqdq", "fx_drafts"], f"""
SELECT model_id, level, count(*) AS n, count(*) FILTER (WHERE is_na = has_ph) AS inconsistent
FROM (SELECT e.model_id, e.level,
        lower({dstrip("regexp_extract(e.raw, '(?m)^- Placeholder Choices Quality:(.*)$', 1)")}) = 'na' AS is_na,
        regexp_matches(d.draft, '<([^<>]+)>') AS has_ph
      FROM fx_eqdq e JOIN fx_drafts d USING (query_id, model_id, level)) AS x
GROUP BY model_id, level""")
def f08(spark, sf):
    t = Tables(spark, sf)
    return J.na_consistency(t.fx_eqdq, t.fx_drafts)


def _scored(t: Tables):
    return J.score_labels(J.parse_review(t.fx_lrqi))


@query("f09_metric_rollup", ["fx_lrqi"], _parsed("fx_lrqi") + """
SELECT model_id, level, criterion, CAST(GROUPING(model_id, level, criterion) AS BIGINT) AS gid, count(*) AS n,
       round(avg(score), 6) AS mean_score
FROM scored WHERE score IS NOT NULL GROUP BY ROLLUP (model_id, level, criterion)""")
def f09(spark, sf):
    return J.metric_rollup(_scored(Tables(spark, sf)))


@query("f10_score_distribution", ["fx_lrqi"], _parsed("fx_lrqi") + """
SELECT model_id, level, criterion, label, n, round(n / sum(n) OVER (PARTITION BY model_id, level, criterion), 6) AS share
FROM (SELECT model_id, level, criterion, regexp_replace(lower(label), ' effort$', '') AS label, count(*) AS n
      FROM parsed GROUP BY ALL) AS c""")
def f10(spark, sf):
    return J.score_distribution(J.parse_review(Tables(spark, sf).fx_lrqi))


_MEANS = """, means AS (SELECT model_id, level, avg(score) AS mean_score, count(*) AS n FROM scored
  WHERE criterion = 'Overall score' AND score IS NOT NULL GROUP BY model_id, level)
"""


@query("f11_uplift", ["fx_lrqi"], _parsed("fx_lrqi") + _MEANS + """
SELECT m.model_id, m.level, round(m.mean_score, 6) AS mean_score, round(b.mean_score, 6) AS base_score,
       round((m.mean_score - b.mean_score) / nullif(b.mean_score, 0), 6) AS uplift
FROM means m LEFT JOIN (SELECT model_id, mean_score FROM means WHERE level = 0) b USING (model_id) WHERE m.level > 0""")
def f11(spark, sf):
    return J.uplift(_scored(Tables(spark, sf)))


@query("f12_intent_rate", ["fx_binary"], f"""
SELECT model_id, level, count(*) AS n, count(verdict) AS n_valid, round(avg(CAST(verdict AS DOUBLE)), 6) AS rate
FROM (SELECT model_id, level, CASE {_jf('Score')} WHEN 'Highly Likely' THEN true WHEN 'Highly Unlikely' THEN false END AS verdict
      FROM fx_binary) AS b GROUP BY model_id, level""")
def f12(spark, sf):
    return J.intent_rate(J.parse_binary(Tables(spark, sf).fx_binary))


@query("f13_effort_summary", ["fx_aue"], _EFFORT + """
SELECT model_id, level, count(comprehension_score) AS n_valid, round(avg(comprehension_score), 6) AS mean_comprehension,
       round(avg(modification_score), 6) AS mean_modification
FROM effort GROUP BY model_id, level""")
def f13(spark, sf):
    return J.effort_summary(J.parse_effort(Tables(spark, sf).fx_aue))


@query("f13b_effort_crosstab", ["fx_aue"], _EFFORT + "SELECT level, comprehension_score, " + ", ".join(
    f"count(*) FILTER (WHERE modification_score = {i}) AS mod_{i}" for i in range(1, 5)) + """
FROM effort WHERE comprehension_score IS NOT NULL AND modification_score IS NOT NULL
GROUP BY level, comprehension_score""")
def f13b(spark, sf):
    return J.effort_crosstab(J.parse_effort(Tables(spark, sf).fx_aue))


# Code-point Levenshtein in DuckDB (its built-in one counts bytes): rows of the DP table by
# list_reduce; inside a row, new[j] = j + min_{k<=j}(t[k] - k) with t[0] = i and
# t[k] = min(prev[k] + 1, prev[k-1] + cost), which needs no left-to-right scan.
_LEV = """list_reduce(list_transform(range(1, length(a) + 1), lambda i: i),
    lambda prev, i: list_transform(range(0, length(b) + 1), lambda j:
        j + list_min(list_transform(range(0, j + 1), lambda k:
            CASE WHEN k = 0 THEN i ELSE least(prev[k + 1] + 1, prev[k] + CASE WHEN substr(a, i, 1) = substr(b, k, 1)
                 THEN 0 ELSE 1 END) END - k))),
    list_transform(range(0, length(b) + 1), lambda j: j))[length(b) + 1]"""


@query("f14_edit_distance", ["fx_drafts", "fx_finals"], f"""
SELECT query_id, model_id, level, CAST(CASE WHEN a = b THEN 0 WHEN strlen(a) = length(a) AND strlen(b) = length(b) THEN levenshtein(a, b)
       ELSE {_LEV} END AS BIGINT) AS levenshtein,
  CAST(len(list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains(string_split(a, ' '), w))) AS BIGINT) AS words_added,
  CAST(len(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains(string_split(b, ' '), w))) AS BIGINT) AS words_removed
FROM (SELECT d.query_id, d.model_id, d.level, d.draft AS a, f.final_query AS b
      FROM fx_drafts d JOIN fx_finals f USING (query_id, model_id, level)) AS x""")
def f14(spark, sf):
    t = Tables(spark, sf)
    return J.edit_distance(t.fx_drafts, t.fx_finals)


@query("f15_model_ranking", ["fx_lrqi"], _parsed("fx_lrqi") + _MEANS + """
SELECT model_id, level, round(mean_score, 6) AS mean_score,
  CAST(rank() OVER (PARTITION BY level ORDER BY mean_score DESC) AS BIGINT) AS rank,
  CAST(dense_rank() OVER (PARTITION BY level ORDER BY mean_score DESC) AS BIGINT) AS dense_rank,
  rank() OVER (PARTITION BY level ORDER BY mean_score DESC) = 1 AS is_best
FROM means""")
def f15(spark, sf):
    return J.model_ranking(_scored(Tables(spark, sf)))


@query("f16_pairwise_wins", ["fx_lrqi"], _parsed("fx_lrqi") + """
, ov AS (SELECT query_id, model_id, level, score FROM scored WHERE criterion = 'Overall score' AND score IS NOT NULL)
SELECT a.level, a.model_id AS model_a, b.model_id AS model_b, count(*) FILTER (WHERE a.score > b.score) AS wins,
  count(*) FILTER (WHERE a.score = b.score) AS ties, count(*) FILTER (WHERE a.score < b.score) AS losses
FROM ov a JOIN ov b ON a.query_id = b.query_id AND a.level = b.level AND a.model_id < b.model_id
GROUP BY a.level, a.model_id, b.model_id""")
def f16(spark, sf):
    return J.pairwise_wins(_scored(Tables(spark, sf)))


# The table of the longest common subsequence row by row; inside a row the running maximum.
_LCS = """list_reduce(list_transform(range(1, len(a) + 1), lambda i: i),
    lambda prev, i: list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
        CASE WHEN k = 0 THEN 0 WHEN a[i] = b[k] THEN prev[k] + 1 ELSE prev[k + 1] END))),
    list_transform(range(0, len(b) + 1), lambda j: 0))[len(b) + 1]"""


@query("f14b_word_edits", ["fx_drafts", "fx_finals"], f"""
SELECT query_id, model_id, level, kept, shared - kept AS moved, len(b) - shared AS added, len(a) - shared AS removed
FROM (SELECT *, CAST(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {_LCS} END AS BIGINT) AS kept,
    CAST(coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS BIGINT) AS shared
  FROM (SELECT d.query_id, d.model_id, d.level, list_filter(string_split(d.draft, ' '), lambda w: w <> '') AS a,
      list_filter(string_split(f.final_query, ' '), lambda w: w <> '') AS b
    FROM fx_drafts d JOIN fx_finals f USING (query_id, model_id, level)) AS x) AS y""")
def f14b(spark, sf):
    t = Tables(spark, sf)
    return J.word_edits(t.fx_drafts, t.fx_finals)


_POISSON = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535))


@query("f17_bootstrap_uplift", ["fx_lrqi"], _parsed("fx_lrqi") + _MEANS + f"""
, ov AS (SELECT query_id, model_id, level, CAST(score AS BIGINT) AS score FROM scored WHERE criterion = 'Overall score' AND score IS NOT NULL),
wt AS (SELECT query_id, r, {_POISSON} AS w FROM (
    SELECT query_id, r, CAST('0x' || substr(md5('1:' || query_id || ':' || (r // 8)), CAST(4 * (r % 8) + 1 AS INTEGER), 4) AS INTEGER) AS u
    FROM (SELECT DISTINCT query_id FROM ov) AS q, range(0, 200) AS g(r)) AS x),
bm AS (SELECT model_id, level, r, CAST(sum(w * score) AS DOUBLE) / nullif(sum(w), 0) AS mean FROM ov JOIN wt USING (query_id) GROUP BY model_id, level, r),
ups AS (SELECT a.model_id, a.level, (a.mean - b.mean) / nullif(b.mean, 0) AS u FROM bm a JOIN bm b ON b.model_id = a.model_id AND b.r = a.r AND b.level = 0 WHERE a.level > 0),
bs AS (SELECT model_id, level, count(u) AS n_replicates, round(avg(u), 6) AS boot_mean, round(quantile_cont(u, 0.025), 6) AS low, round(quantile_cont(u, 0.975), 6) AS high
  FROM ups GROUP BY model_id, level)
SELECT m.model_id, m.level, round((m.mean_score - z.mean_score) / z.mean_score, 6) AS uplift, n_replicates, boot_mean, low, high
FROM means m LEFT JOIN means z ON z.model_id = m.model_id AND z.level = 0 LEFT JOIN bs ON bs.model_id = m.model_id AND bs.level = m.level WHERE m.level > 0""")
def f17(spark, sf):
    return J.bootstrap_uplift(_scored(Tables(spark, sf)))


@query("f18_model_rating", ["fx_lrqi"], _parsed("fx_lrqi") + """
, ov AS (SELECT query_id, model_id, level, score FROM scored WHERE criterion = 'Overall score' AND score IS NOT NULL),
g AS (SELECT a.level, a.model_id AS i, b.model_id AS j, count(*) AS n, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS won
  FROM ov a JOIN ov b ON a.query_id = b.query_id AND a.level = b.level AND a.model_id <> b.model_id GROUP BY a.level, a.model_id, b.model_id),
p AS (SELECT level, i, sum(won) AS points, CAST(sum(n) AS BIGINT) AS n_games FROM g GROUP BY level, i),
ms AS (SELECT x.level, x.i, list(coalesce(g.n, 0) ORDER BY y.i) AS ns FROM p x JOIN p y ON y.level = x.level LEFT JOIN g ON g.level = x.level AND g.i = x.i AND g.j = y.i GROUP BY x.level, x.i),
t AS (SELECT level, list(i ORDER BY i) AS ids, list(points ORDER BY i) AS won, list(ns ORDER BY i) AS ns FROM ms JOIN p USING (level, i) GROUP BY level)
SELECT level, model_id, points, n_games, round(rating, 6) AS rating, component FROM (
  WITH RECURSIVE r AS (
    SELECT level, 0 AS step, list_transform(ids, lambda i: 1.0::DOUBLE) AS r, 1.0::DOUBLE AS moved FROM t
    UNION ALL
    SELECT level, step + 1, new, list_max(list_transform(range(1, len(new) + 1), lambda i: abs(new[i] - r[i])))
    FROM (SELECT level, step, r, list_transform(raw, lambda x: x * len(raw) / list_sum(raw)) AS new FROM (
      SELECT r.level, step, r.r, list_transform(range(1, len(ids) + 1), lambda i: won[i] / list_sum(list_transform(range(1, len(ids) + 1),
        lambda j: CASE WHEN ns[i][j] = 0 THEN 0.0 ELSE ns[i][j] / (r.r[i] + r.r[j]) END))) AS raw
      FROM r JOIN t ON t.level = r.level WHERE step < 2000 AND moved > 1e-9) AS x) AS y)
  SELECT e.level, unnest(t.ids) AS model_id, unnest(e.r) AS rating, list_min(t.ids) AS component
  FROM (SELECT level, max_by(r, step) AS r FROM r GROUP BY level) AS e JOIN t ON t.level = e.level) AS z
JOIN (SELECT level, i AS model_id, points, n_games FROM p) AS q USING (level, model_id)""")
def f18(spark, sf):
    return J.model_rating(J.pairwise_wins(_scored(Tables(spark, sf))))
