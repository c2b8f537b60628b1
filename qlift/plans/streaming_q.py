"""Streaming jobs run to completion with ``availableNow``, results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import runlogs as RL
from ..session import scratch_path
from ..streaming import jobs as ST
from .inference_q import _GPT2_CLEAN
from .registry import query
from .runlogs_q import _LOSSES
from .standins import enhancer_factory


@query("j01_stream_enhance", ["fx_queries"], f"""
SELECT query_id, {_GPT2_CLEAN} AS query, 'Explain ' || {_GPT2_CLEAN} || ' for <Audience>' AS enhanced_query FROM fx_queries""")
def j01(spark, sf):
    t = Tables(spark, sf)
    src = scratch_path(spark, "j01-src")
    t.fx_queries.repartition(4).write.json(src)
    out = ST.stream_enhance(spark, src, scratch_path(spark, "j01-out"), scratch_path(spark, "j01-ckpt"), enhancer_factory,
                            max_files_per_trigger=2)
    return out.select("query_id", "query", "enhanced_query")


@query("j02_stream_pending", [], "SELECT DISTINCT event_id FROM events")
def j02(spark, sf):
    t = Tables(spark, sf)
    src = scratch_path(spark, "j02-src")
    ev = t.events.select("event_id", "ts")
    # every id delivered twice (two copies of the stream), both inside the watermark
    ev.unionByName(ev).repartition(4).write.parquet(src)
    out = ST.stream_pending(spark, src, scratch_path(spark, "j02-out"), scratch_path(spark, "j02-ckpt"), ev.schema)
    return out.select("event_id")


@query("j03_stream_log_levels", ["fx_log"], """
, p AS (SELECT nullif(regexp_extract(line, '\\[([A-Z]+)\\]', 1), '') AS level,
          try_strptime(regexp_extract(line, '^(\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2} [AP]M) ', 1), '%m/%d/%Y %I:%M:%S %p') AS ts
        FROM fx_log WHERE regexp_extract(line, '^(\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2} [AP]M) ', 1) <> '')
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS window_end, level, count(*) AS n
FROM p GROUP BY time_bucket(INTERVAL 1 hour, ts), level
HAVING time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM p) - INTERVAL 1 hour""")
def j03(spark, sf):
    t = Tables(spark, sf)
    src = scratch_path(spark, "j03-src")
    t.fx_log.select("line").repartition(4).write.text(src)
    out = ST.stream_log_levels(spark, src, scratch_path(spark, "j03-out"), scratch_path(spark, "j03-ckpt"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select(F.date_format("window_start", fmt).alias("window_start"),
                      F.date_format("window_end", fmt).alias("window_end"), "level", "n")


@query("j04_stream_early_stop", ["fx_log"], _LOSSES + """
, s AS (SELECT split, epoch, mean_loss, min(mean_loss) OVER (PARTITION BY split ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM losses),
g AS (SELECT split, epoch, sum(CASE WHEN best_before IS NULL OR mean_loss < best_before THEN 1 ELSE 0 END)
    OVER (PARTITION BY split ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM s),
st AS (SELECT split, epoch, row_number() OVER (PARTITION BY split, grp ORDER BY epoch) - 1 AS stale FROM g)
SELECT d.split AS run, x.stop_epoch FROM (SELECT DISTINCT split FROM losses) d
LEFT JOIN (SELECT split, min(epoch) AS stop_epoch FROM st WHERE stale = 4 GROUP BY split) x USING (split)""")
def j04(spark, sf):
    losses = RL.epoch_losses(RL.parse_log(Tables(spark, sf).fx_log)).select(F.col("split").alias("run"), "epoch", F.col("mean_loss").alias("loss"))
    src, out, ckpt = (scratch_path(spark, f"j04-{x}") for x in ("src", "out", "ckpt"))
    for part in ("epoch < 3", "epoch >= 3"):  # the stream is stopped and started again in between
        losses.where(part).write.mode("append").parquet(src)
        stops = ST.stream_early_stop(spark, src, out, ckpt, 4)
    return stops
