"""Sources, sinks, row ranges, shards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import Tables
from ..operators import sharding
from ..operators.ordering import first_n, row_range
from ..session import scratch_path
from ..sources import files, line_index
from .registry import query


@query("a01_read_jsonl", ["fx_queries"], """
SELECT query_id, conv_id, turn, query FROM fx_queries
""")
def a01(spark, sf):
    t = Tables(spark, sf)
    path = files.write_jsonl(t.fx_queries, scratch_path(spark, "a01"))
    return files.read_queries(spark, path, strict=True)


@query("a02_read_tsv", ["fx_tsv"], r"""
SELECT CASE WHEN split_part(line, chr(9), 1) = '' THEN NULL ELSE split_part(line, chr(9), 1) END AS query,
       CASE WHEN strpos(line, chr(9)) = 0 OR split_part(line, chr(9), 2) = '' THEN NULL
            ELSE split_part(line, chr(9), 2) END AS enhanced_query
FROM fx_tsv WHERE trim(line, ' ' || chr(9)) <> ''
""")
def a02(spark, sf):
    t = Tables(spark, sf)
    path = files.write_lines(t.fx_tsv, "line", scratch_path(spark, "a02"))
    return files.read_pairs(spark, path, header=False)


@query("a03_read_lines", ["fx_tsv"], """
SELECT line FROM fx_tsv
""")
def a03(spark, sf):
    t = Tables(spark, sf)
    path = files.write_lines(t.fx_tsv, "line", scratch_path(spark, "a03"))
    return files.read_lines(spark, path)


@query("a04_row_range", [], """
SELECT idx, doc_id, text FROM (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, text FROM documents) AS d
WHERE idx >= 100 AND idx < 600
""")
def a04(spark, sf):
    t = Tables(spark, sf)
    return row_range(t.documents.select("doc_id", "text"), "doc_id", 100, 600).select("idx", "doc_id", "text")


_FOLDER = "lpad(CAST(query_id // 20000 AS VARCHAR), 9, '0')"


@query("a04b_line_range", ["fx_tsv"], f"""
SELECT idx, folder, line_no, line FROM (
  SELECT CAST(row_number() OVER (ORDER BY {_FOLDER}, query_id) - 1 AS BIGINT) AS idx, {_FOLDER} AS folder,
    CAST(row_number() OVER (PARTITION BY {_FOLDER} ORDER BY query_id) - 1 AS BIGINT) AS line_no, line FROM fx_tsv) AS x
WHERE idx >= 60 AND idx < 160""")
def a04b(spark, sf):
    # a folder of files whose lines stand by query id; more files as the table grows
    folder = F.lpad(F.floor(F.col("query_id") / 20000).cast("string"), 9, "0")
    root = scratch_path(spark, "a04b")
    lines = Tables(spark, sf).fx_tsv.withColumn("folder", folder).repartition("folder").sortWithinPartitions("folder", "query_id")
    lines.select("folder", F.col("line").alias("value")).write.partitionBy("folder").text(root)
    found = line_index.line_range(spark, root, 60, 160, line_index.file_index(spark, root))
    return found.select("idx", F.regexp_extract("file", "folder=([0-9]+)/", 1).alias("folder"), "line_no", "line")


@query("a05_first_n", [], """
SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 250
""")
def a05(spark, sf):
    t = Tables(spark, sf)
    return first_n(t.documents.select("doc_id", "text"), "doc_id", 250)


@query("a06_write_jsonl", ["fx_queries"], """
SELECT query_id, conv_id, turn, query FROM fx_queries
""")
def a06(spark, sf):
    t = Tables(spark, sf)
    path = files.write_jsonl(t.fx_queries, scratch_path(spark, "a06"))
    return spark.read.schema(files.QUERY_SCHEMA).json(path)


@query("a06b_rows_written", ["fx_queries"], "SELECT count(*) AS rows_written FROM fx_queries")
def a06b(spark, sf):
    t = Tables(spark, sf)
    n = files.write_jsonl_counted(t.fx_queries, scratch_path(spark, "a06b"))
    return spark.range(1).select(F.lit(n).cast("bigint").alias("rows_written"))


@query("a07b_shard_headers", [], """
SELECT shard, line_no, line FROM (
  SELECT CAST(i % 8 AS BIGINT) AS shard, CAST((i - 1) // 8 + 1 AS BIGINT) AS line_no, line FROM (
    SELECT row_number() OVER (ORDER BY doc_id) AS i, CAST(doc_id AS VARCHAR) || chr(9) || source AS line FROM documents) a
  UNION ALL SELECT CAST(range AS BIGINT), CAST(0 AS BIGINT), 'doc_id' || chr(9) || 'source' FROM range(0, 8)) x
""")
def a07b(spark, sf):
    t = Tables(spark, sf)
    lines = t.documents.select("doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), "source").alias("line"))
    sharded = sharding.shard_round_robin(lines, "doc_id", 8, header=True, keep_index=True)
    return sharding.with_header(sharded, "doc_id\tsource", "line", 8)


@query("a07_shard_round_robin", [], """
SELECT shard, count(*) AS n_rows FROM (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) % 8 AS BIGINT) AS shard FROM documents) AS s
GROUP BY shard
""")
def a07(spark, sf):
    t = Tables(spark, sf)
    sharded = sharding.shard_round_robin(t.documents.select("doc_id", "text"), "doc_id", 8, header=True)
    path = sharding.write_shards(sharded, scratch_path(spark, "a07"))
    back = spark.read.json(path)
    return back.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"))


_A8_SQL = """
SELECT p.worker, p.start_idx, p.end_idx, p.n_rows, CAST(coalesce(c.assigned, 0) AS BIGINT) AS assigned
FROM (
  SELECT w AS worker, least(w * sz, n) AS start_idx, least((w + 1) * sz, n) AS end_idx,
         least((w + 1) * sz, n) - least(w * sz, n) AS n_rows
  FROM (SELECT CAST(range AS BIGINT) AS w FROM range(0, 6)) AS k,
       (SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / 6.0)) AS BIGINT) AS sz FROM documents) AS s) AS p
LEFT JOIN (
  SELECT worker, count(*) AS assigned FROM (
    SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // sz AS BIGINT) AS worker
    FROM documents, (SELECT CAST(greatest(1, ceil(count(*) / 6.0)) AS BIGINT) AS sz FROM documents) AS s3) AS a
  GROUP BY worker) AS c ON c.worker = p.worker
"""


@query("a08_contiguous_buckets", [], _A8_SQL)
def a08(spark, sf):
    t = Tables(spark, sf)
    assigned, plan = sharding.contiguous_buckets(t.documents.select("doc_id"), "doc_id", 6)
    counts = assigned.groupBy("worker").agg(F.count(F.lit(1)).alias("assigned"))
    # the plan has one row per worker (bounded by the worker count): broadcast it
    return (F.broadcast(plan).join(counts, "worker", "left")
            .select("worker", "start_idx", "end_idx", "n_rows",
                    F.coalesce("assigned", F.lit(0)).cast("bigint").alias("assigned")))


@query("a09_merge_shards", [], """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS merged_idx, doc_id, text FROM documents
""")
def a09(spark, sf):
    t = Tables(spark, sf)
    assigned, _ = sharding.contiguous_buckets(t.documents.select("doc_id", "text"), "doc_id", 6)
    root = scratch_path(spark, "a09")
    assigned.write.mode("overwrite").partitionBy("worker").parquet(root)
    back = spark.read.parquet(root)  # one folder per worker, as worker processes would leave them
    return sharding.merge_shards(back).select("merged_idx", "doc_id", "text")


_DRAFT_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("draft", T.StringType())])


@query("a10_read_output_tree", ["fx_drafts"], """
SELECT 'm' || CAST(model_id AS VARCHAR) AS model, level, query_id, draft FROM fx_drafts
""")
def a10(spark, sf):
    t = Tables(spark, sf)
    out = t.fx_drafts.select(F.concat(F.lit("m"), F.col("model_id").cast("string")).alias("model"),
                             "level", "query_id", "draft")
    root = files.write_output_tree(out, scratch_path(spark, "a10"))
    return files.read_output_tree(spark, root, _DRAFT_SCHEMA).select("model", "level", "query_id", "draft")


@query("a11_pending_outputs", ["fx_queries", "fx_drafts"], """
SELECT i.query_id, i.model_id, i.level
FROM (SELECT q.query_id, CAST(m.model_id AS BIGINT) AS model_id, CAST(l.level AS BIGINT) AS level
      FROM fx_queries q CROSS JOIN (SELECT range AS model_id FROM range(0, 7)) m
      CROSS JOIN (SELECT range AS level FROM range(1, 5)) l) AS i
WHERE NOT EXISTS (SELECT 1 FROM fx_drafts d WHERE d.draft <> '' AND d.query_id = i.query_id
                  AND d.model_id = i.model_id AND d.level = i.level)
""")
def a11(spark, sf):
    t = Tables(spark, sf)
    items = (t.fx_queries.select("query_id")
             .withColumn("model_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))))
             .withColumn("level", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")))))
    done = t.fx_drafts.filter(F.col("draft") != "")
    return sharding.pending(items, done, ["query_id", "model_id", "level"])
