"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def text_column(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the caller can't clash with ours."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def prepare(spark: SparkSession) -> None:
    """What operators with Python stages need: the package on the workers, a shared folder for checkpoints."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def count_blocks(docs: DataFrame, column: str, target_bytes: int, least: int) -> int:
    """How many blocks of about ``target_bytes`` the column fills (one scalar comes back)."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()["b"] or 0
    return max(least, math.ceil(total / target_bytes))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the folder of ``spark.checkpoint.dir``, which all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_sample(rows: DataFrame, n: int, *key: str, seed: int = 7) -> DataFrame:
    """About ``n`` of the rows (all, if there are fewer), chosen by a hash of the key columns: the same ones each run.

    One count comes back to the driver; the number kept varies around ``n`` by a few square roots of it.
    """
    total = rows.count()
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def chunks(lengths, limit: int):
    """Slices ``(from, to)`` of consecutive items whose lengths sum to about ``limit`` (one long item: a slice of its own)."""
    at, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, len(lengths)


def forest(near):
    """Connect what a boolean matrix connects: ``(rows, their root, columns, their root)``, roots being column numbers;
    rows and columns without a link are left out."""
    import numpy as np

    rows, cols = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
    m = near[np.ix_(rows, cols)]
    label, of_row = np.arange(len(cols)), np.zeros(len(rows), int)
    while len(cols):
        of_row = np.where(m, label[None, :], len(cols)).min(axis=1)
        new = np.minimum(label, np.where(m, of_row[:, None], len(cols)).min(axis=0))
        if (new == label).all():
            break
        label = new
    return rows, cols[of_row], cols, cols[label]
