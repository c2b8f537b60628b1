"""Relational operators over query tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import grouping as GR
from ..operators import tables as TB
from ..session import Stored
from .registry import dnorm, dstrip, query


@query("d01_unpivot_levels", ["fx_drafts"], """
SELECT query_id, model_id, level, draft AS enhanced_query FROM fx_drafts
""")
def d01(spark, sf):
    t = Tables(spark, sf)
    wide = TB.pivot_levels(t.fx_drafts, ["query_id", "model_id"], "draft")
    return TB.unpivot_levels(wide, ["query_id", "model_id"])


_REASONS = f""", r AS (SELECT query_id, split, line, string_split({dstrip('line')}, chr(9)) AS parts FROM fx_tsv),
c AS (SELECT query_id, split, parts[1] AS head, parts[2] AS tail,
  CASE WHEN line IS NULL OR {dstrip('line')} = '' THEN 'blank'
       WHEN len(parts) < 2 THEN 'missing_column'
       WHEN parts[1] IS NULL OR {dstrip('parts[1]')} = '' THEN 'empty_query'
       WHEN parts[2] IS NULL OR {dstrip('parts[2]')} = '' THEN 'empty_target' ELSE 'loaded' END AS reason FROM r),
pairs AS (SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY query_id) - 1 AS BIGINT) AS idx,
  head, tail, query_id FROM c WHERE reason = 'loaded')
"""

_KEY = ("CASE split WHEN 'train' THEN 't' WHEN 'val' THEN 'v' ELSE left(split, 1) END "
        "|| ':' || CAST(idx AS VARCHAR)")


@query("d02_index_pairs", ["fx_tsv"], _REASONS + f"SELECT split, idx, {_KEY} AS key, head, tail, query_id FROM pairs")
def d02(spark, sf):
    return TB.index_pairs(Tables(spark, sf).fx_tsv, "query_id")


@query("d03_ingest_stats", ["fx_tsv"], _REASONS + """
SELECT split, count(*) FILTER (WHERE reason <> 'blank') AS seen, count(*) FILTER (WHERE reason = 'loaded') AS loaded,
  count(*) FILTER (WHERE reason = 'empty_query') AS skipped_empty_query,
  count(*) FILTER (WHERE reason = 'empty_target') AS skipped_empty_target,
  count(*) FILTER (WHERE reason = 'missing_column') AS skipped_missing_column,
  round(CAST(count(*) FILTER (WHERE reason = 'loaded') AS DOUBLE) / count(*) FILTER (WHERE reason <> 'blank'), 6) AS ratio,
  count(*) FILTER (WHERE reason = 'loaded') AS dataset_len
FROM c GROUP BY split""")
def d03(spark, sf):
    return TB.ingest_stats(Tables(spark, sf).fx_tsv)


@query("d04_split_assign", [], """
SELECT doc_id, bucket, CASE WHEN bucket < 8 THEN 'train' WHEN bucket = 8 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::INTEGER % 10 AS BIGINT) AS bucket
      FROM documents) AS d""")
def d04(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    return TB.split_assign(d, "doc_id")


@query("d05_keyed_lookup", ["fx_tsv", "fx_queries"], _REASONS + f"SELECT split, idx, {_KEY} AS key, head, tail FROM pairs JOIN (SELECT CASE WHEN turn % 4 = 0 THEN 'val' ELSE 'train' END AS split, query_id % 211 AS idx FROM fx_queries) r USING (split, idx)")
def d05(spark, sf):
    t = Tables(spark, sf)
    pairs = TB.index_pairs(t.fx_tsv, "query_id")
    # what a loader asks for: indices by user turn, some of them twice, some beyond the data
    requests = t.fx_queries.select(F.when(F.col("turn") % 4 == 0, "val").otherwise("train").alias("split"), (F.col("query_id") % 211).alias("idx"))
    return TB.keyed_lookup(pairs, requests).select("split", "idx", "key", "head", "tail")


@query("d06_align_outputs", ["fx_queries", "fx_drafts"], """
, e AS (SELECT q.query_id, CAST(m.range AS BIGINT) AS model_id, CAST(l.range AS BIGINT) AS level
        FROM fx_queries q, range(0, 7) m, range(1, 5) l),
o AS (SELECT query_id, model_id, level, count(*) AS n FROM fx_drafts WHERE draft <> '' GROUP BY ALL),
j AS (SELECT coalesce(e.model_id, o.model_id) AS model_id, coalesce(e.level, o.level) AS level,
             e.query_id IS NOT NULL AS has_e, o.n FROM e FULL OUTER JOIN o USING (query_id, model_id, level))
SELECT model_id, level, count(*) FILTER (WHERE has_e) AS n_expected, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_outputs,
  count(*) FILTER (WHERE has_e AND n IS NULL) AS missing, count(*) FILTER (WHERE NOT has_e) AS extra,
  count(*) FILTER (WHERE n > 1) AS duplicated
FROM j GROUP BY model_id, level""")
def d06(spark, sf):
    t = Tables(spark, sf)
    expected = (t.fx_queries.select("query_id")
                .withColumn("model_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))))
                .withColumn("level", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")))))
    outputs = t.fx_drafts.filter(F.col("draft") != "")
    keys = ["query_id", "model_id", "level"]
    return TB.align_outputs(expected, outputs, keys, ["model_id", "level"])


@query("d07_explode_suggestions", ["fx_drafts"], """
SELECT query_id, level, model_id AS rank, draft AS suggestion FROM fx_drafts
""")
def d07(spark, sf):
    t = Tables(spark, sf)
    # one flat prediction list per query: 4 inputs (levels) x 7 beams (models), in order
    flat = (t.fx_drafts.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("level", "model_id", "draft"))).alias("_p"))
            .select("query_id", F.transform("_p", lambda s: s["draft"]).alias("flat")))
    out = TB.explode_suggestions(flat, "flat", 4, num_seq=7, beam=7)
    return out.select("query_id", (F.col("input_pos") + 1).cast("bigint").alias("level"),
                      F.col("rank").cast("bigint").alias("rank"), "suggestion")


@query("d07b_suggestion_records", ["fx_queries", "fx_drafts"], """
SELECT q.query_id, d.level, q.query AS prefix, to_json(list(d.draft ORDER BY d.model_id)) AS suggestions, 'l' || (q.conv_id % 3) AS lang
FROM fx_queries q JOIN fx_drafts d USING (query_id) WHERE d.model_id < 5 GROUP BY q.query_id, d.level, q.query, q.conv_id""")
def d07b(spark, sf):
    t = Tables(spark, sf)
    # seven beams per input, five wanted: the list holds the first five of each
    flat = (t.fx_drafts.filter("model_id < 5").groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("level", "model_id", "draft"))).alias("_p"))
            .select("query_id", F.transform("_p", lambda s: s["draft"]).alias("flat")))
    ranked = TB.explode_suggestions(flat, "flat", 4, num_seq=5, beam=7).withColumn("level", (F.col("input_pos") + 1).cast("bigint"))
    q = t.fx_queries.select("query_id", "query", F.concat(F.lit("l"), (F.col("conv_id") % 3).cast("string")).alias("lang"))
    out = TB.suggestion_records(ranked.join(q, "query_id"), "query", "lang", "suggestion", "rank", ["query_id", "level"])
    return out.select("query_id", "level", "prefix", F.to_json("suggestions").alias("suggestions"), "lang")


@query("d08_pivot_models", ["fx_drafts"], "SELECT model_id, " + ", ".join(
    f'count(*) FILTER (WHERE level = {n}) AS "{n}_n", round(avg(length(draft)) FILTER (WHERE level = {n}), 6) AS "{n}_mean_len"'
    for n in TB.LEVELS) + " FROM fx_drafts GROUP BY model_id")
def d08(spark, sf):
    return TB.pivot_models(Tables(spark, sf).fx_drafts, "model_id", "level", TB.LEVELS, "draft")


_WORDS = f"list_filter(string_split({dnorm('text')}, ' '), lambda w: w <> '')"
_RUNS = f"""runs AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 8, 0) + 2),
    lambda i: array_to_string(w[i:i + 7], ' ')) END) AS run FROM (SELECT doc_id, {_WORDS.replace('lower(text)', "lower(coalesce(text, ''))")} AS w FROM documents) AS x),
held AS (SELECT run, min(doc_id) AS head FROM runs GROUP BY run HAVING count(*) > 1 AND count(*) <= 0.02 * (SELECT count(*) FROM documents)),
links AS (SELECT DISTINCT head AS a, doc_id AS b FROM runs JOIN held USING (run) WHERE doc_id <> head),
grp AS (SELECT doc_id, coalesce(label, doc_id) AS group_id FROM documents LEFT JOIN (
  WITH RECURSIVE reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT DISTINCT b, b FROM links
    UNION SELECT r.a, x.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) AS x ON x.a = r.b)
  SELECT a AS doc_id, min(b) AS label FROM reach GROUP BY a) AS l USING (doc_id)),
sz AS (SELECT group_id, count(*) AS n, count(*) > 0.005 * (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS large FROM grp GROUP BY group_id),
pr AS (SELECT least(0.5, 0.1 / nullif(1.0 - coalesce(sum(n) FILTER (WHERE large), 0) / CAST(sum(n) AS DOUBLE), 0)) AS p FROM sz),
spl AS (SELECT group_id, CASE WHEN large THEN 'train' WHEN u < p THEN 'test' WHEN u < p * 2 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, CAST(CAST('0x' || substr(md5(CAST(group_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM sz) AS s, pr)"""


@query("d09_grouped_split", [], f"WITH {_RUNS} SELECT doc_id, group_id, split FROM grp JOIN spl USING (group_id)")
def d09(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    return GR.grouped_split(d, "doc_id", "text").select("doc_id", "group_id", "split")


def _leaks(name: str, assigned: str) -> str:
    return f"""{name} AS (SELECT split, count(*) AS rows, count(*) FILTER (WHERE shared > 0) AS leaking, round(max(CASE WHEN n > 0 THEN shared / CAST(n AS DOUBLE) ELSE 0 END), 6) AS max_containment
  FROM (SELECT a.doc_id, a.split, count(r.run) AS n, count(t.run) AS shared FROM {assigned} a LEFT JOIN runs r USING (doc_id)
    LEFT JOIN (SELECT DISTINCT run FROM runs JOIN held USING (run) JOIN {assigned} x USING (doc_id) WHERE x.split = 'train') AS t ON t.run = r.run
    WHERE a.split <> 'train' GROUP BY a.doc_id, a.split) AS y GROUP BY split)"""


@query("d09b_leak_report", [], f"""WITH {_RUNS},
grouped AS (SELECT doc_id, split FROM grp JOIN spl USING (group_id)),
plain AS (SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 10 AS b FROM documents) AS z),
{_leaks('lg', 'grouped')},
{_leaks('lp', 'plain')}
SELECT 'grouped' AS kind, * FROM lg UNION ALL SELECT 'plain', * FROM lp""")
def d09b(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    tables = Stored(spark, "d09b")
    shared = tables.put(GR.shared_runs(d, "doc_id", "text"))  # the runs are cut and exchanged once for the split and both reports
    tables.tidy()
    held, runs = shared.where("block IS NOT NULL"), shared.where("block IS NULL").select("node", F.col("weight").alias("runs"))
    grouped = tables.put(GR.grouped_split(d, "doc_id", "text", held=held).select("doc_id", "split"))  # no text is exchanged
    plain = TB.split_assign(d, "doc_id").select("doc_id", "split")
    return (GR.leak_report(grouped, "doc_id", "text", held=held, runs=runs).select(F.lit("grouped").alias("kind"), "*")
            .unionByName(GR.leak_report(plain, "doc_id", "text", held=held, runs=runs).select(F.lit("plain").alias("kind"), "*")))
