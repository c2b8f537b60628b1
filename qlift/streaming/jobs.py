"""Structured Streaming jobs.

The batch workflow's resumable file loop becomes a file-source stream with a checkpoint:
each input file is processed exactly once across restarts, and ``availableNow`` runs the
backlog in as many micro-batches as configured, then stops.  Checkpoints and sinks live
under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.inference import generate
from ..operators.runlogs import parse_log
from ..session import ship_package
from ..sources.files import QUERY_SCHEMA


def _run(stream_writer, path: str, checkpoint: str):
    q = (stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def stream_enhance(spark: SparkSession, src: str, out: str, checkpoint: str, factory: Callable,
                   batch_size: int = 16, profile: str = "gpt2", max_files_per_trigger: int | None = None) -> DataFrame:
    """New JSONL query files -> cleaned, generated records (JSON sink), exactly once after restart."""
    reader = spark.readStream.schema(QUERY_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src_df = reader.json(src)
    gen = generate(src_df, factory, batch_size, profile)
    _run(gen.writeStream.format("json").outputMode("append"), out, checkpoint)
    return spark.read.schema(gen.schema).json(out)


def stream_pending(spark: SparkSession, src: str, out: str, checkpoint: str, schema: T.StructType,
                   key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop re-delivered ids across micro-batches; state only for ids inside the watermark.

    A re-delivery that arrives after the watermark passed is processed again (state for it
    was already dropped) or, if older than the watermark, dropped as late.
    """
    s = spark.readStream.schema(schema).parquet(src)
    s = s.withColumn("_qx_ts", F.col(ts).cast("timestamp")).withWatermark("_qx_ts", delay)
    d = s.dropDuplicatesWithinWatermark([key]).drop("_qx_ts")
    _run(d.writeStream.format("parquet").outputMode("append"), out, checkpoint)
    return spark.read.parquet(out)


def stream_log_levels(spark: SparkSession, src: str, out: str, checkpoint: str, window: str = "1 hour",
                      delay: str = "1 hour") -> DataFrame:
    """Tumbling-window line counts per log level; lines later than the watermark are dropped."""
    lines = spark.readStream.schema("line string").text(src).withColumnRenamed("value", "line")
    parsed = parse_log(lines, keys=())
    tz = spark.conf.get("spark.sql.session.timeZone")
    # log times are wall-clock (timestamp_ntz); read them as UTC instants so windows align to
    # wall-clock hours whatever the session time zone is, and turn the bounds back after
    ev = (parsed.filter(F.col("ts").isNotNull())
          .withColumn("ets", F.to_utc_timestamp(F.col("ts").cast("timestamp"), tz)))
    agg = (ev.withWatermark("ets", delay).groupBy(F.window("ets", window), "level")
           .agg(F.count(F.lit(1)).alias("n")))

    def wall(c):
        return F.from_utc_timestamp(c, tz).cast("timestamp_ntz")

    flat = agg.select(wall(F.col("window.start")).alias("window_start"), wall(F.col("window.end")).alias("window_end"),
                      "level", "n")
    _run(flat.writeStream.format("parquet").outputMode("append"), out, checkpoint)
    return spark.read.parquet(out)


STOP_SCHEMA = "run string, seen_epoch bigint, stop_epoch bigint"
_STOP_STATE = "last_epoch bigint, best_loss double, stale bigint, stop_epoch bigint"


def _watch(patience: int):
    """State per run: the last epoch judged, the best loss, the epochs since then, and where the run stopped (or -1)."""

    def step(key, frames, state):
        import pandas as pd

        seen = pd.concat(list(frames)).dropna(subset=["epoch", "loss"])
        last, best, stale, stopped = state.get if state.exists else (-1, float("inf"), 0, -1)
        out = []
        if not state.exists:
            out.append((key[0], last, None))
        # in the order of the epochs; of an epoch that comes twice in one batch the smaller loss
        for epoch, loss in seen.groupby("epoch")["loss"].min().sort_index().items():
            if epoch <= last:
                continue  # repeated or late: the epoch has been judged (or passed over) already
            last = int(epoch)
            improved = loss < best
            best, stale = (float(loss), 0) if improved else (best, stale + 1)
            if stale == patience and stopped < 0:
                stopped = last
                out.append((key[0], last, stopped))
        state.update((last, best, stale, stopped))
        yield pd.DataFrame(out, columns=["run", "seen_epoch", "stop_epoch"]).astype({"seen_epoch": "int64", "stop_epoch": "Int64"})

    return step


def stream_early_stop(spark: SparkSession, src: str, out: str, checkpoint: str, patience: int) -> DataFrame:
    """I5 on a stream: per run the first epoch after ``patience`` epochs without a new strict minimum, else null.

    ``src`` holds Parquet files of ``run, epoch, loss`` (one row per run and epoch, I3's result).  The state of a run is four
    numbers, kept across restarts by the checkpoint.  Epochs are judged in ascending order; one at or below the last
    judged epoch of its run is repeated or late and changes nothing.  Rows without epoch or loss are passed over, but make the run known.
    A run emits one row when it is first seen and one when it stops; what comes back folds these to a row per run.
    """
    ship_package(spark)
    s = spark.readStream.schema("run string, epoch bigint, loss double").parquet(src)
    events = s.groupBy("run").applyInPandasWithState(_watch(patience), STOP_SCHEMA, _STOP_STATE, "append", "NoTimeout")
    _run(events.writeStream.format("parquet").outputMode("append"), out, checkpoint)
    return spark.read.schema(STOP_SCHEMA).parquet(out).groupBy("run").agg(F.min("stop_epoch").alias("stop_epoch"))
