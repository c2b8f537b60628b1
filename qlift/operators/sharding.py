"""Row ranges, shards, contiguous worker buckets and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import dense_index


def shard_round_robin(df: DataFrame, order_by, n: int, header: bool = False, col: str = "shard",
                      keep_index: bool = False) -> DataFrame:
    """``shard = idx % n``; with a header the header line is idx 0, so data row i has idx i+1."""
    out = dense_index(df, order_by, "_qx_i")
    out = out.withColumn(col, F.pmod(F.col("_qx_i") + F.lit(1 if header else 0), F.lit(n)).cast("bigint"))
    return out if keep_index else out.drop("_qx_i")


def with_header(sharded: DataFrame, header: str, line_col: str, n: int, col: str = "shard") -> DataFrame:
    """The shards as lines with ``header`` as the first line of each (``line_no`` 0)."""
    spark = sharded.sparkSession
    top = spark.range(n).select(F.col("id").alias(col), F.lit(0).cast("bigint").alias("line_no"), F.lit(header).alias(line_col))
    rows = sharded.select(col, (F.expr(f"_qx_i div {int(n)}") + 1).alias("line_no"), line_col)
    return top.unionByName(rows)


def write_shards(df: DataFrame, path: str, col: str = "shard") -> str:
    """Write one folder per shard (``partitionBy``), each written by the tasks holding its rows."""
    df.write.mode("overwrite").partitionBy(col).json(path)
    return path


def contiguous_buckets(df: DataFrame, order_by, workers: int):
    """Worker k gets rows ``[k*size, min((k+1)*size, rows))`` with ``size = ceil(rows/workers)``.

    Returns ``(rows_with_worker_and_pos, plan)``; the plan has one row per worker, late
    workers may be empty (never a negative count).  The row count is a scalar subquery of the
    plan, not a driver action.
    """
    spark = df.sparkSession
    rows = df.select(F.count(F.lit(1))).scalar()
    size = F.greatest(F.lit(1), F.ceil(rows / F.lit(workers))).cast("bigint")
    indexed = dense_index(df, order_by, "_qx_i").withColumn("_qx_size", size)
    assigned = (indexed.withColumn("worker", F.expr("_qx_i div _qx_size"))
                .withColumn("pos", F.col("_qx_i") - F.col("worker") * F.col("_qx_size"))
                .drop("_qx_i", "_qx_size"))
    k = F.col("id")
    plan = spark.range(workers).select(
        k.alias("worker"),
        F.least(k * size, rows).cast("bigint").alias("start_idx"),
        F.least((k + 1) * size, rows).cast("bigint").alias("end_idx"))
    plan = plan.withColumn("n_rows", (F.col("end_idx") - F.col("start_idx")).cast("bigint"))
    return assigned, plan


def merge_shards(parts, worker_col: str = "worker", pos_col: str = "pos", index_col: str = "merged_idx") -> DataFrame:
    """Union worker outputs (by name) and restore worker order, then in-worker order."""
    if isinstance(parts, DataFrame):
        merged = parts
    else:
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p, allowMissingColumns=True)
    return dense_index(merged, [worker_col, pos_col], index_col)


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a result yet (``left_anti``); re-running only these is safe."""
    return items.join(done.select(*keys), keys, "left_anti")
