"""Segmented running aggregates over a global order, without a window per group.

"Gaps and islands" is usually a window partitioned by the group, which sorts a hot group in one task.  Here the rows are
cut by their order into ranges, whatever group they belong to (``spark.sql.shuffle.partitions`` of them, so a group with a third
of all rows lies in a third of the ranges), and each range is scanned alone:

1. inside a range a window per range gives the last segment start so far, and running sums;
2. every range is reduced to one row (its number of rows, its sums, its last start), and these rows, bounded by the number of ranges,
   are scanned once: what each range gets carried in from the ranges before it;
3. the carried row of the range is joined (broadcast) to its rows, and fills what the range could not know itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def segmented_scan(df: DataFrame, order_by: list[str], starts: Column, sums: dict[str, Column] | None = None,
                   firsts: dict[str, Column] | None = None, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``seg_first`` (the global 0-based index of the first row of the row's segment) and ``seg_pos`` (0-based place in it).

    A segment begins at every row for which ``starts`` holds (null: it doesn't), and at the first row of all.  ``sums`` adds
    running sums within the segment up to the row, ``firsts`` the value at the segment's first row (null values stay null).
    ``order_by`` should be unique; rows that tie are in no stated order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sums, firsts = sums or {}, firsts or {}
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    helper = {"_sx_start": F.coalesce(starts, F.lit(False)), **{f"_sx_s_{k}": c for k, c in sums.items()}, **{f"_sx_f_{k}": c for k, c in firsts.items()}}
    rows = (df.withColumns(helper).repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
            .withColumn("_sx_mid", F.monotonically_increasing_id()).checkpoint(eager=True))
    rows = rows.withColumn("_sx_range", F.shiftright("_sx_mid", 33)).withColumn("_sx_at", F.col("_sx_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # inside the ranges: a window partition is one range, never one group
    so_far = Window.partitionBy("_sx_range").orderBy("_sx_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.col("_sx_start") | (F.col("_sx_mid") == 0)
    rows = rows.withColumns({f"_sx_r_{k}": F.sum(f"_sx_s_{k}").over(so_far) for k in sums})
    zero = F.lit(0).cast("bigint")
    held = F.struct(F.col("_sx_at").alias("at"), *[F.col(f"_sx_f_{k}").alias(f"f_{k}") for k in firsts],
                    *[(F.coalesce(f"_sx_r_{k}", zero) - F.coalesce(f"_sx_s_{k}", zero)).alias(f"s_{k}") for k in sums])
    rows = rows.withColumn("_sx_begin", F.when(begun, held)).withColumn("_sx_last", F.last("_sx_begin", ignorenulls=True).over(so_far))
    # one row per range: its size, its sums, its last start
    per = rows.groupBy("_sx_range").agg(F.count(F.lit(1)).alias("n"), F.max_by("_sx_begin", F.when(F.col("_sx_begin").isNotNull(), F.col("_sx_at"))).alias("begin"),
                                        *[F.coalesce(F.sum(f"_sx_s_{k}"), zero).alias(f"t_{k}") for k in sums])
    before = Window.orderBy("_sx_range").rowsBetween(Window.unboundedPreceding, -1)  # bounded by the number of ranges
    per = per.withColumns({"off": F.coalesce(F.sum("n").over(before), zero), **{f"p_{k}": F.coalesce(F.sum(f"t_{k}").over(before), zero) for k in sums}})
    # starts with their place and sums counted from the first range on
    whole = F.when(F.col("begin").isNotNull(), F.struct((F.col("begin.at") + F.col("off")).alias("at"), *[F.col(f"begin.f_{k}").alias(f"f_{k}") for k in firsts],
                                                        *[(F.col(f"begin.s_{k}") + F.col(f"p_{k}")).alias(f"s_{k}") for k in sums]))
    per = per.withColumn("carried", F.last(whole, ignorenulls=True).over(before))
    out = rows.join(F.broadcast(per.select("_sx_range", "off", "carried", *[f"p_{k}" for k in sums])), "_sx_range")
    own = F.col("_sx_last").isNotNull()

    def of_segment(mine: Column, theirs: str) -> Column:
        return F.when(own, mine).otherwise(F.col(f"carried.{theirs}"))

    first = of_segment(F.col("_sx_last.at") + F.col("off"), "at")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns], first.alias("seg_first"), (F.col("off") + F.col("_sx_at") - first).alias("seg_pos"),
        *[(F.coalesce(f"_sx_r_{k}", zero) + F.col(f"p_{k}") - of_segment(F.col(f"_sx_last.s_{k}") + F.col(f"p_{k}"), f"s_{k}")).alias(k) for k in sums],
        *[of_segment(F.col(f"_sx_last.f_{k}"), f"f_{k}").alias(k) for k in firsts])
