"""Readers and writers for the file shapes the workflow uses.

Every reader declares its schema (no inference pass) and keeps Spark's file splitting, so a
large input is read by many tasks without any line-number bookkeeping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("query", T.StringType()),
])


def read_queries(spark: SparkSession, path: str, schema: T.StructType = QUERY_SCHEMA, strict: bool = True,
                 required: str = "query"):
    """A1: JSON lines to typed rows.  Every line must parse and carry ``required``.

    ``strict=True`` fails the job that reads the rows (``InvalidRecords`` in its message) as soon
    as a line fails: one scan, no driver action; ``strict=False`` returns ``(rows, quarantine)`` where the
    quarantine keeps the raw text of the rejected lines.
    """
    s = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.schema(s).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    bad = F.col(CORRUPT).isNotNull() | F.col(required).isNull()
    good = raw.filter(~bad).drop(CORRUPT)
    if strict:
        said = F.concat(F.lit(f"InvalidRecords: a line in {path} is no JSON object with '{required}': "),
                        F.coalesce(F.substring(F.col(CORRUPT), 1, 200), F.lit("field missing")))
        return raw.filter(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop(CORRUPT)
    quarantine = raw.filter(bad).select(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*schema.names))).alias("raw"))
    return good, quarantine


def read_pairs(spark: SparkSession, path: str, header: bool = False,
               names: tuple[str, ...] = ("query", "enhanced_query")) -> DataFrame:
    """A2: tab-separated file, quoting off; the first column is the query.

    Blank lines are skipped, a missing column is null, an empty field is null, extra
    columns are ignored, whitespace inside fields is kept.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "")
            .option("header", str(header).lower()).option("mode", "PERMISSIVE").csv(path))


def read_lines(spark: SparkSession, path: str, col: str = "line") -> DataFrame:
    """A3: one row per line, newline removed, blank lines kept."""
    return spark.read.text(path).withColumnRenamed("value", col)


def write_jsonl(df: DataFrame, path: str) -> str:
    """One JSON object per row, UTF-8 (non-ASCII kept as is), overwrite; returns the path."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_jsonl_counted(df: DataFrame, path: str) -> int:
    """The same with the number of rows written, observed by the write itself (no second pass)."""
    from pyspark.sql import Observation

    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    return seen.get["rows"]


def write_lines(df: DataFrame, col: str, path: str) -> str:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
    return path


# A10: "<root>/<model>/level<n>.jsonl" as written by the generators, or Spark's own
# "<root>/model=<m>/level=<n>/part-*.json" layout.
TREE_RE = r"/(?:model=)?([^/=]+)/level=?(\d+)(?:\.jsonl)?(?:/[^/]*)?$"


def read_output_tree(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """A10: read every ``{model}/level{n}`` output at once and tag rows with ``model``, ``level``."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root)
    path = F.col("_metadata.file_path")
    return (df.withColumn("model", F.regexp_extract(path, TREE_RE, 1))
            .withColumn("level", F.regexp_extract(path, TREE_RE, 2).cast("bigint")))


def write_output_tree(df: DataFrame, root: str, model_col: str = "model", level_col: str = "level",
                      max_records_per_file: int = 1_000_000) -> str:
    """Write per-(model, level) outputs as partitioned JSON folders (one folder per pair).

    Rows are not shuffled onto one task per pair (a hot pair would then be written by a
    single task); every task writes its share of each pair, files capped in size.
    """
    (df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(model_col, level_col).json(root))
    return root
