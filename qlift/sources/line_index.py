"""Line numbers of text files, without a sort and without moving the lines (A3, A4).

A text file has no order column; its order is the place of a line in the file.  Spark reads a file in splits, one task
a row of splits, each from its first line to its last.  So the number of a line is the number of lines in the splits before
its own, plus its place in the split:

1. one pass counts the lines per split (``_metadata.file_path`` and ``file_block_start``), and notes how many lines
   the task had read before: one row per split comes out (``split_index``);
2. running sums over the splits of each file give every split's first line;
3. the pass that reads the lines gets the running number inside its task from ``monotonically_increasing_id`` and adds the
   difference that belongs to its split.  The split table is broadcast up to ``BROADCAST_SPLITS`` counted rows, beyond that
   joined by shuffle.

Both passes must see the same splits.  Spark derives their size from the settings and from the cores it has at that
moment, so on a cluster that grows meanwhile it may differ (pin ``spark.sql.files.minPartitionNum`` there).  That is never
silent: a split that is not in the table, or a place outside ``0 .. lines`` of its split, raises ``SplitsChanged``; a shift by
any number of lines puts at least one line of the split out of that range.

Lines are what ``spark.read.text`` reads: they end with LF, CR LF or CR, a last line may lack it, blank lines count, an empty file has none.
Line numbers and indices begin at 0.  Files follow one another by path.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BROADCAST_SPLITS = 100_000
MOST_FILES = 10_000
_LOW = (1 << 33) - 1


def _scan(spark: SparkSession, paths) -> DataFrame:
    """``line`` with its split (``file, block, size``) and its running number in the task (``task, row``)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("size"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line")).select(
        "file", "block", "size", F.shiftright("mid", 33).alias("task"), F.col("mid").bitwiseAND(F.lit(_LOW)).alias("row"), "line")


def _as_path(uri: str) -> str:
    """A file of ``_metadata.file_path`` (percent-encoded) as a path to read: decoded, pattern signs taken literally."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(uri))


def split_index(scan: DataFrame) -> DataFrame:
    """``file, block, size, task, before, lines, first``: per split the rows its task read before it, its lines, and the
    number of its first line in the file.  Written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(scan.sparkSession)
    per = scan.groupBy("file", "block", "size", "task").agg(F.min("row").alias("before"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    return per.withColumn("first", F.coalesce(F.sum("lines").over(earlier), F.lit(0).cast("bigint"))).checkpoint(eager=True)


def _sized(df: DataFrame, most: int) -> DataFrame:
    """Broadcast up to ``most`` counted rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def _raise(said: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"SplitsChanged: {said} in "), F.col("file"), F.lit(", block "), F.col("block").cast("string"))).cast("bigint")


def _numbered(scan: DataFrame, splits: DataFrame) -> DataFrame:
    j = scan.join(_sized(splits, BROADCAST_SPLITS), ["file", "block", "size", "task"], "left")
    place = F.col("row") - F.col("before")
    number = (F.when(F.col("lines").isNull(), _raise("a split was not counted"))
              .when((place < 0) | (place >= F.col("lines")), _raise("lines moved"))
              .otherwise(F.col("first") + place))
    return j.select("file", number.alias("line_no"), "line")


def number_lines(spark: SparkSession, paths) -> DataFrame:
    """A3: ``file, line_no, line`` of all lines below ``paths`` (one path or a list)."""
    scan = _scan(spark, paths)
    return _numbered(scan, split_index(scan))


def file_index(spark: SparkSession, paths) -> DataFrame:
    """``file, lines, first_idx`` per file with lines: its lines and the index of its first one when the files follow one
    another by path.  One row per file; keep it as a table to serve many ranges of the same folder."""
    return _file_index(split_index(_scan(spark, paths)))


def _file_index(splits: DataFrame) -> DataFrame:
    per = splits.groupBy("file").agg(F.sum("lines").alias("lines"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, as the driver lists them
    return per.withColumn("first_idx", F.coalesce(F.sum("lines").over(earlier), F.lit(0).cast("bigint")))


def line_range(spark: SparkSession, paths, start_index: int = 0, max_limit: int = -1, index: DataFrame | None = None) -> DataFrame:
    """A4: ``idx, file, line_no, line`` of the lines with ``start_index <= idx < max_limit`` (``max_limit <= 0``: to the end).

    With an ``index`` (see ``file_index``) only the files that the range meets are read, if these are ``MOST_FILES`` at most.
    """
    scan = _scan(spark, paths)
    splits = None
    if index is None:
        splits = split_index(scan)
        index = _file_index(splits).checkpoint(eager=True)
    met = F.col("first_idx") + F.col("lines") > start_index
    if max_limit > 0:
        met = met & (F.col("first_idx") < max_limit)
    files = index.where(met)
    if splits is None:
        names = [_as_path(r["file"]) for r in files.select("file").limit(MOST_FILES + 1).collect()]
        if len(names) <= MOST_FILES:
            if not names:
                return _empty(spark)
            scan = _scan(spark, names)
        splits = split_index(scan)
    lines = _numbered(scan, splits).join(_sized(files.select("file", "first_idx"), BROADCAST_SPLITS), "file")
    out = lines.withColumn("idx", F.col("first_idx") + F.col("line_no"))
    cond = F.col("idx") >= start_index
    if max_limit > 0:
        cond = cond & (F.col("idx") < max_limit)
    return out.where(cond).select("idx", "file", "line_no", "line")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.col("id").alias("idx"), F.lit("").alias("file"), F.col("id").alias("line_no"), F.lit("").alias("line"))
