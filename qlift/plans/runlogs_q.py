"""Run-log analytics over ``fx_log`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import runlogs as RL
from .registry import query

_LVL = "CAST(CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RL.LEVELS.items()) + " END AS BIGINT)"

_PARSED = f""", p0 AS (SELECT event_id, regexp_extract(line, '{RL.TS_RE}', 1) AS t,
    nullif(regexp_extract(line, '{RL.LEVEL_RE}', 1), '') AS level, CASE WHEN regexp_matches(line, '{RL.MSG_RE}') THEN regexp_extract(line, '{RL.MSG_RE}', 1) END AS msg FROM fx_log),
parsed AS (SELECT event_id, CASE WHEN t <> '' THEN strftime(try_strptime(t, '%m/%d/%Y %I:%M:%S %p'), '%Y-%m-%d %H:%M:%S') END AS ts,
    level, {_LVL} AS level_no, msg FROM p0)
"""

_LOSSES = _PARSED + f""", m AS (SELECT regexp_extract(msg, '{RL.LOSS_RE}', 1) AS e, regexp_extract(msg, '{RL.LOSS_RE}', 2) AS split,
    regexp_extract(msg, '{RL.LOSS_RE}', 3) AS v FROM parsed),
losses AS (SELECT split, CAST(e AS BIGINT) AS epoch, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 6) AS mean_loss
    FROM m WHERE e <> '' GROUP BY split, CAST(e AS BIGINT))
"""


def _parsed(t: Tables):
    p = RL.parse_log(t.fx_log)
    return p


def _report(p):
    return p.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("i01_parse_log", ["fx_log"], _PARSED + "SELECT * FROM parsed")
def i01(spark, sf):
    return _report(_parsed(Tables(spark, sf)))


@query("i02_level_filter", ["fx_log"], _PARSED + "SELECT * FROM parsed WHERE level_no >= 3")
def i02(spark, sf):
    return _report(RL.level_filter(_parsed(Tables(spark, sf)), "WARN"))


@query("i03_epoch_loss", ["fx_log"], _LOSSES + "SELECT * FROM losses")
def i03(spark, sf):
    return RL.epoch_losses(_parsed(Tables(spark, sf)))


@query("i04_best_epoch", ["fx_log"], _LOSSES + """
SELECT split, epoch AS best_epoch, mean_loss AS best_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY mean_loss, epoch) AS r FROM losses) AS x WHERE r = 1""")
def i04(spark, sf):
    return RL.best_epoch(RL.epoch_losses(_parsed(Tables(spark, sf))))


PATIENCE = 3


@query("i05_early_stop", ["fx_log"], _LOSSES + f"""
, s AS (SELECT split, epoch, mean_loss, min(mean_loss) OVER (PARTITION BY split ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM losses),
g AS (SELECT split, epoch, sum(CASE WHEN best_before IS NULL OR mean_loss < best_before THEN 1 ELSE 0 END)
          OVER (PARTITION BY split ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM s),
st AS (SELECT split, epoch, row_number() OVER (PARTITION BY split, grp ORDER BY epoch) - 1 AS stale FROM g)
SELECT d.split, x.stop_epoch FROM (SELECT DISTINCT split FROM losses) d
LEFT JOIN (SELECT split, min(epoch) AS stop_epoch FROM st WHERE stale = {PATIENCE} GROUP BY split) x USING (split)""")
def i05(spark, sf):
    return RL.early_stop(RL.epoch_losses(_parsed(Tables(spark, sf))), PATIENCE)


def _files(t: Tables):
    e = t.events
    d = F.concat(F.lit("runs/"), F.col("event_type"))
    path = F.concat(d, F.lit("/epoch="), F.col("event_id").cast("string"),
                    F.when(F.col("value") >= 25, F.lit(".ckpt")).otherwise(F.lit(".log")))
    return e.select(d.alias("dir"), path.alias("path"), F.col("ts").alias("mtime"))


@query("i06_latest_checkpoint", [], """
WITH f AS (SELECT 'runs/' || event_type AS dir,
             'runs/' || event_type || '/epoch=' || CAST(event_id AS VARCHAR) || CASE WHEN value >= 25 THEN '.ckpt' ELSE '.log' END AS path,
             ts AS mtime FROM events)
SELECT d.dir, x.latest FROM (SELECT DISTINCT dir FROM f) d LEFT JOIN (
  SELECT dir, path AS latest FROM (SELECT dir, path, row_number() OVER (PARTITION BY dir ORDER BY mtime DESC, path DESC) AS r
                                   FROM f WHERE ends_with(path, 'ckpt')) AS y WHERE r = 1) x USING (dir)""")
def i06(spark, sf):
    return RL.latest_checkpoint(_files(Tables(spark, sf)))
