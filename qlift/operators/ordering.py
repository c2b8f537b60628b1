"""Dense 0-based row index over an explicit order, without a single-task window.

``row_number() over (order by k)`` without ``partitionBy`` moves every row into one task.
``dense_index`` instead:

1. takes the order keys alone (the payload never passes the range exchange), range-partitions
   them into ``spark.sql.shuffle.partitions`` ranges, sorts inside each and writes them to the
   shared checkpoint folder, so that every later read sees the same ranges;
2. counts rows per range (one row per partition) and turns the counts into running offsets,
   which are broadcast (bounded by the partition count, not by the data);
3. adds the in-partition position (low 33 bits of ``monotonically_increasing_id``) and joins
   the index to the rows by their unique key.

The order key must be unique where other columns are joined back; callers pass a tie-break column when it is
not.  Equal keys stand side by side in one range, so a grouped count over the written ranges (no exchange) finds
them, and ``DuplicateKeys`` is raised instead of a join that would multiply rows.  Nothing is cached; Spark removes the checkpoint files with the plan that reads them where
``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_MASK = (1 << 33) - 1


class DuplicateKeys(ValueError):
    pass


def _order(order_by) -> list[tuple[str, bool]]:
    """Column names with their direction; ``-name`` is descending."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return [(n.removeprefix("-"), n.startswith("-")) for n in names]


def _sorted_by(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def index_keys(keys: DataFrame, order: list[Column], index_col: str, num_partitions: int | None = None, unique: bool = False) -> DataFrame:
    """``keys`` (order columns only) with their dense index; ``unique`` raises on equal keys."""
    spark = keys.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_qx_mid", F.monotonically_increasing_id()).checkpoint(eager=True))
    if unique and not ranged.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_qx_n")).where("_qx_n > 1").limit(1).isEmpty():
        raise DuplicateKeys("the order key is not unique: add a column that tells the rows apart")
    ranged = ranged.withColumn("_qx_pid", F.shiftright("_qx_mid", 33))
    counts = ranged.groupBy("_qx_pid").agg(F.count(F.lit(1)).alias("_qx_n"))
    # one row per range partition: a window over it is bounded by n, not by the data
    w = Window.orderBy("_qx_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_qx_pid", F.coalesce(F.sum("_qx_n").over(w), F.lit(0)).alias("_qx_off"))
    out = ranged.join(F.broadcast(offsets), "_qx_pid")
    out = out.withColumn(index_col, (F.col("_qx_off") + F.col("_qx_mid").bitwiseAND(F.lit(_MASK))).cast("bigint"))
    return out.drop("_qx_mid", "_qx_pid", "_qx_off")


def dense_index(df: DataFrame, order_by, index_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """``df`` with the dense index of its rows in the order of ``order_by`` (names; ``-name`` is descending)."""
    order = _order(order_by)
    names = [f"_qx_k{i}" for i in range(len(order))]
    keys = df.select(*[F.col(c).alias(n) for (c, _), n in zip(order, names)])
    alone = {c for c, _ in order} == set(df.columns)  # nothing but the keys: no join needed, equal rows are interchangeable
    indexed = index_keys(keys, [_sorted_by(n, d) for n, (_, d) in zip(names, order)], index_col, num_partitions, unique=not alone)
    if alone:
        return indexed.select(*[F.col(names[[o for o, _ in order].index(c)]).alias(c) for c in df.columns], index_col)
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for (c, _), n in zip(order, names)])
    return df.join(indexed, on).drop(*names)


def row_range(df: DataFrame, order_by, start_index: int = 0, max_limit: int = -1,
              index_col: str = "idx") -> DataFrame:
    """Rows with ``start_index <= idx < max_limit``; ``max_limit <= 0`` means no upper bound."""
    out = dense_index(df, order_by, index_col)
    cond = F.col(index_col) >= F.lit(start_index)
    if max_limit > 0:
        cond = cond & (F.col(index_col) < F.lit(max_limit))
    return out.filter(cond)


def first_n(df: DataFrame, order_by, n: int = -1) -> DataFrame:
    """First ``n`` rows in order (``-1`` = all), never more than exist; one plan whatever ``n``:
    the distributed index and a filter, so no task receives n rows from every partition."""
    if n is None or n < 0:
        return df.orderBy(*[_sorted_by(*o) for o in _order(order_by)])
    if n == 0:
        return df.limit(0)
    return row_range(df, order_by, 0, n, "_qx_first").drop("_qx_first")
