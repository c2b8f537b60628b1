"""Relational operators over query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip_ws
from .ordering import dense_index

LEVELS = [1, 2, 3, 4]
LEVEL_COL = "enhanced_query_lvl_{}"


def unpivot_levels(wide: DataFrame, ids: list[str], levels=LEVELS) -> DataFrame:
    """``enhanced_query_lvl_1..4`` to ``(ids..., level, enhanced_query)`` (literal column list)."""
    cols = [LEVEL_COL.format(n) for n in levels]
    long = wide.unpivot(ids, cols, "level_col", "enhanced_query")
    return (long.withColumn("level", F.regexp_extract("level_col", r"(\d+)$", 1).cast("bigint"))
            .select(*ids, "level", "enhanced_query"))


def select_level(long: DataFrame, level: int) -> DataFrame:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, got {level}")
    return long.filter(F.col("level") == level)


def pivot_levels(long: DataFrame, ids: list[str], value: str, levels=LEVELS) -> DataFrame:
    """Inverse of D1 with a literal value list (no extra distinct job)."""
    wide = long.groupBy(*ids).pivot("level", levels).agg(F.first(value))
    return wide.select(*ids, *[F.col(str(n)).alias(LEVEL_COL.format(n)) for n in levels])


# Key prefixes per split.
SPLIT_PREFIX = {"train": "t", "val": "v"}


def parse_pair_line(line) -> Column:
    """Stripped line split on tabs: struct(head, tail, n_parts)."""
    parts = F.split(strip_ws(line), "\t", -1)
    return F.struct(parts[0].alias("head"), F.get(parts, 1).alias("tail"), F.size(parts).alias("n_parts"))


def ingest_reasons(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Per line: blank / missing_column / empty_query / empty_target / loaded, plus head and tail."""
    p = parse_pair_line(F.col(line_col))
    reason = (F.when(is_blank(line_col), F.lit("blank"))
              .when(p["n_parts"] < 2, F.lit("missing_column"))
              .when(is_blank(p["head"]), F.lit("empty_query"))
              .when(is_blank(p["tail"]), F.lit("empty_target"))
              .otherwise(F.lit("loaded")))
    return df.withColumn("reason", reason).withColumn("head", p["head"]).withColumn("tail", p["tail"])


def ingest_stats(df: DataFrame, split_col: str = "split", line_col: str = "line") -> DataFrame:
    """D3: per split, non-blank lines seen, loaded, skipped by reason, loaded/seen, ``dataset_len``."""
    r = ingest_reasons(df, line_col)
    return (r.groupBy(split_col).agg(
        F.count_if(F.col("reason") != "blank").alias("seen"),
        F.count_if(F.col("reason") == "loaded").alias("loaded"),
        F.count_if(F.col("reason") == "empty_query").alias("skipped_empty_query"),
        F.count_if(F.col("reason") == "empty_target").alias("skipped_empty_target"),
        F.count_if(F.col("reason") == "missing_column").alias("skipped_missing_column"))
        .withColumn("ratio", F.round(F.try_divide(F.col("loaded").cast("double"), F.col("seen").cast("double")), 6))
        .withColumn("dataset_len", F.col("loaded")))


def index_pairs(df: DataFrame, order_by, split_col: str = "split", line_col: str = "line") -> DataFrame:
    """Loaded pairs with a dense 0-based ``idx`` per split and key ``<t|v>:<idx>``."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ok = ingest_reasons(df, line_col).filter(F.col("reason") == "loaded")
    idx = dense_index(ok, [split_col, *keys], "_qx_g")
    # per-split start offsets: one row per split (bounded), broadcast
    starts = idx.groupBy(split_col).agg(F.min("_qx_g").alias("_qx_s"))
    out = idx.join(F.broadcast(starts), split_col).withColumn("idx", (F.col("_qx_g") - F.col("_qx_s")).cast("bigint"))
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPLIT_PREFIX.items() for x in kv]), F.col(split_col)),
                        F.substring(split_col, 1, 1))
    return out.select(split_col, "idx", F.concat(prefix, F.lit(":"), F.col("idx").cast("string")).alias("key"),
                      "head", "tail", *[k for k in keys if k not in (split_col,)])


def split_assign(df: DataFrame, key_col: str, col: str = "split") -> DataFrame:
    """D4 (derived): reproducible 8:1:1 train/val/test by the md5 of the key."""
    bucket = (F.conv(F.substring(F.md5(F.col(key_col).cast("string")), 1, 4), 16, 10).cast("bigint") % 10)
    return (df.withColumn("bucket", bucket)
            .withColumn(col, F.when(F.col("bucket") < 8, "train").when(F.col("bucket") == 8, "val").otherwise("test")))


def keyed_lookup(pairs: DataFrame, requests: DataFrame, keys=("split", "idx")) -> DataFrame:
    """Fetch the pairs for requested keys (equi-join; both sides partitioned on the key)."""
    return requests.join(pairs, list(keys), "inner")


def align_outputs(expected: DataFrame, outputs: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per group, inputs, outputs, missing, extra and duplicated outputs (full outer join)."""
    counts = outputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qx_n"))
    e = expected.select(*keys).withColumn("_qx_e", F.lit(True))
    j = e.join(counts, keys, "full_outer")
    return (j.groupBy(*group).agg(
        F.count_if(F.col("_qx_e")).alias("n_expected"),
        F.coalesce(F.sum("_qx_n"), F.lit(0)).cast("bigint").alias("n_outputs"),
        F.count_if(F.col("_qx_e") & F.col("_qx_n").isNull()).alias("missing"),
        F.count_if(F.col("_qx_e").isNull()).alias("extra"),
        F.count_if(F.col("_qx_n") > 1).alias("duplicated")))


def explode_suggestions(df: DataFrame, flat_col: str, n_inputs, num_seq: int, beam: int,
                        input_col: str = "input_pos") -> DataFrame:
    """Split a batch's flat prediction list into ``min(beam, num_seq)`` per input, ranked."""
    k = min(beam, num_seq)
    n = n_inputs if isinstance(n_inputs, Column) else F.lit(n_inputs)
    per = df.withColumn(input_col, F.explode(F.sequence(F.lit(0), n - 1)))
    per = per.withColumn("_qx_s", F.slice(flat_col, F.col(input_col) * k + 1, F.lit(k)))
    return per.select(*[c for c in df.columns if c != flat_col], input_col,
                      F.posexplode("_qx_s").alias("rank", "suggestion"))


def suggestion_records(df: DataFrame, prefix: str, lang: str, suggestions: str, rank: str, keys: list[str]) -> DataFrame:
    """D7 with B7: one record ``{prefix, suggestions: [..], lang}`` per input, suggestions in rank order
    (a group holds one input's suggestions, bounded by the beam)."""
    return (df.groupBy(*keys).agg(F.first(prefix).alias("prefix"),
                                  F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(suggestions).alias("s")))).alias("_qx_s"),
                                  F.first(lang).alias("lang"))
            .select(*keys, "prefix", F.transform("_qx_s", lambda x: x["s"]).alias("suggestions"), "lang"))


def pivot_models(df: DataFrame, row: str, col: str, values, text_col: str) -> DataFrame:
    """Row x level matrix of counts and mean text lengths (literal pivot values)."""
    return (df.groupBy(row).pivot(col, list(values))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(text_col)), 6).alias("mean_len")))
