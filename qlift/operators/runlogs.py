"""Run-log analytics (I1-I6): parse log lines, filter by level, epoch losses, best epoch,
early stopping and the newest checkpoint file.

Parsing is per-row column work.  Loss curves are first reduced to one row per
(run, epoch); the windows used for best epoch and early stopping run over those small
per-run series, never over raw log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Log line layout and level numbers (CRITICAL sits below ERROR).
LOG_TS_FORMAT = "MM/dd/yyyy hh:mm:ss a"
LEVELS = {"DEBUG": 1, "INFO": 2, "WARN": 3, "CRITICAL": 4, "ERROR": 5}
TS_RE = r"^(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AP]M) "
LEVEL_RE = r"\[([A-Z]+)\]"
MSG_RE = r"\] (.*)$"
LOSS_RE = r"epoch : (\d+) - average_(\w+)_loss : (-?[0-9.]+)"


def level_no(level) -> Column:
    out = F.lit(None).cast("bigint")
    for name, n in LEVELS.items():
        out = F.when(level == name, F.lit(n).cast("bigint")).otherwise(out)
    return out


def parse_log(df: DataFrame, line: str = "line", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``(ts, level, level_no, msg)``; lines without a timestamp (or with an
    impossible one), a level or a message keep nulls there."""
    ts_text = F.regexp_extract(line, TS_RE, 1)
    lvl = F.nullif(F.regexp_extract(line, LEVEL_RE, 1), F.lit(""))
    ts = F.when(ts_text != "", F.try_to_timestamp(ts_text, F.lit(LOG_TS_FORMAT)).cast("timestamp_ntz"))
    return df.select(*keys, ts.alias("ts"), lvl.alias("level"), level_no(lvl).alias("level_no"),
                     F.when(F.col(line).rlike(MSG_RE), F.regexp_extract(line, MSG_RE, 1)).alias("msg"))


def level_filter(parsed: DataFrame, threshold: str | int = "WARN") -> DataFrame:
    """Keep lines at or above a level (by number)."""
    n = LEVELS[threshold] if isinstance(threshold, str) else threshold
    return parsed.filter(F.col("level_no") >= n)


def epoch_losses(parsed: DataFrame) -> DataFrame:
    """Mean loss per split and epoch from ``epoch : e - average_<split>_loss : v`` lines."""
    m = parsed.select(F.regexp_extract("msg", LOSS_RE, 1).alias("e"), F.regexp_extract("msg", LOSS_RE, 2).alias("split"),
                      F.regexp_extract("msg", LOSS_RE, 3).alias("v")).filter(F.col("e") != "")
    return (m.groupBy("split", F.col("e").cast("bigint").alias("epoch"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean_loss")))


def best_epoch(losses: DataFrame, run: str = "split") -> DataFrame:
    """I4: epoch with the lowest loss per run (earliest on ties)."""
    w = Window.partitionBy(run).orderBy("mean_loss", "epoch")
    return (losses.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(run, F.col("epoch").alias("best_epoch"), F.col("mean_loss").alias("best_loss")))


def early_stop(losses: DataFrame, patience: int, run: str = "split") -> DataFrame:
    """First epoch after which ``patience`` epochs passed without a new strict minimum.

    ``improved`` = loss below every earlier loss; epochs are grouped by the running count of
    improvements, and the position inside a group counts the epochs without improvement.
    """
    w = Window.partitionBy(run).orderBy("epoch")
    best_before = F.min("mean_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = losses.withColumn("improved", best_before.isNull() | (F.col("mean_loss") < best_before))
    s = s.withColumn("grp", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("stale", F.row_number().over(Window.partitionBy(run, "grp").orderBy("epoch")) - 1)
    stop = s.filter(F.col("stale") == patience).groupBy(run).agg(F.min("epoch").alias("stop_epoch"))
    return losses.select(run).distinct().join(stop, run, "left")


def latest_checkpoint(files: DataFrame, dir_col: str = "dir", path_col: str = "path", mtime_col: str = "mtime",
                      suffix: str = "ckpt") -> DataFrame:
    """Newest file ending in ``suffix`` per directory; null when a directory has none."""
    ck = files.filter(F.col(path_col).endswith(suffix))
    best = ck.groupBy(dir_col).agg(F.max_by(path_col, F.struct(mtime_col, path_col)).alias("latest"))
    return files.select(dir_col).distinct().join(best, dir_col, "left")
