"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions.  Two vectors collide on a direction if one lies in the window
of half-width ``h`` centred on the other.  At cosine ``tau`` their projections differ by a normal variable of deviation
``d = sqrt(2 - 2 tau)``, so with ``h = 2 d`` a true pair collides on each direction with probability 0.954: pairs that reach
the count ``l`` are verified by the cosine in double precision.  ``l`` is the largest count that a pair at exactly
``tau`` reaches with probability ``RECALL``.

Which pairs are counted: counting every pair would be quadratic, so vectors first meet in cells.  A table sorts ``k`` of the
directions into strips of width ``WIDTH`` at random offsets; a cell is one strip of each.  ``k`` grows with the logarithm of
the number of vectors (about ``CELL_MATES`` chance neighbours a cell), and there are as many tables as it takes for a
pair at ``tau`` to share a cell in one of them with probability ``RECALL``.  A pair is counted in the first table where it
meets, so link counts can simply be added up.

Scale: equal vectors are one row with a weight.  A cell of more than ``BLOCK`` vectors is dealt into blocks, and pairs of
blocks are compared apart, so that no task holds more than two blocks.  Tasks return per vector its number
of links and a root it hangs on, never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths; a row without id links with nothing, its component is null and it isn't kept; rows with equal ids are
vectors of their own; an empty table gives an empty result; other columns of the caller are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, forest, prepare, saved
from .components import connected

DIRECTIONS = 32
RECALL = 0.9995
WIDTH = 2.0
CELL_MATES = 48
BLOCK = 1024
SMALL = 24  # rows of a cell up to which its pairs are listed at once with those of other cells
PAIRS_AT_ONCE = 100_000
HOT_BROADCAST_ROWS = 100_000


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def least_count(p: float, m: int = DIRECTIONS, recall: float = RECALL) -> int:
    """The largest l with P(Binomial(m, p) >= l) >= recall."""
    total = 0.0
    for l in range(m, 0, -1):
        total += math.comb(m, l) * p ** l * (1 - p) ** (m - l)
        if total >= recall:
            return l
    return 1


def _same_strip(deviation: float, width: float = WIDTH) -> float:
    """Probability that two projections with a normal difference lie in one strip of random offset."""
    r = width / deviation
    return 2 * _normal(r) - 1 - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Directions and tables for n vectors of some length, the same for the same numbers."""

    def __init__(self, n: int, tau: float, seed: int = 11):
        self.tau, self.seed = tau, seed
        d = math.sqrt(max(2 - 2 * tau, 1e-12))
        self.half = 2 * d
        self.count = least_count(2 * _normal(2.0) - 1)
        self.k = max(3, math.ceil(math.log(max(n, 2) / CELL_MATES, 1 / _same_strip(math.sqrt(2)))))
        self.tables = math.ceil(math.log(1 - RECALL) / math.log(1 - _same_strip(d) ** self.k))
        self.by_dim: dict = {}

    def of(self, dim: int):
        """Counting directions, cell directions, offsets."""
        if dim not in self.by_dim:
            rng = np.random.default_rng((self.seed, dim))
            self.by_dim[dim] = (rng.standard_normal((dim, DIRECTIONS)), rng.standard_normal((dim, self.tables * self.k)),
                                rng.uniform(0, WIDTH, self.tables * self.k))
        return self.by_dim[dim]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each row in each table (a hash that also holds table and length)."""
        _, along, offset = self.of(unit.shape[1])
        strips = np.floor((unit @ along + offset) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), self.tables, self.k)
        h = np.full((len(unit), self.tables), unit.shape[1] << 32, np.uint64) + np.arange(self.tables, dtype=np.uint64)
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # or a table's number could cancel against a strip's
        h ^= h >> np.uint64(32)
        for i in range(self.k):
            h = (h ^ strips[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def windows(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.of(unit.shape[1])[0]).astype(np.float32)


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    # by a power of two first (exact), so that no square overflows or vanishes
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _to_cells(plan):
    def run(batches):
        for b in batches:
            for dim, g in b.groupby(b["v"].map(len)):
                for at in range(0, len(g), 2000):
                    part = g.iloc[at:at + 2000]
                    raw = [np.asarray(v, np.float64).tobytes() for v in part["v"]]
                    cells = plan.value.cells(_unit(raw))
                    for t in range(cells.shape[1]):
                        yield pd.DataFrame({"nth": np.int32(t), "cell": cells[:, t], "node": part["node"].to_numpy(), "weight": part["weight"].to_numpy(), "v": raw})

    return run


class _Group:
    """The rows of one slot or of several, with what is needed to compare them."""

    def __init__(self, plan, rows: pd.DataFrame):
        self.plan, self.unit = plan, _unit(rows["v"].tolist())
        self.node, self.weight, self.nth = rows["node"].to_numpy(), rows["weight"].to_numpy(), rows["nth"].to_numpy()
        self.window, self.cell = plan.windows(self.unit), plan.cells(self.unit)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the listed pairs of rows link here for the first time."""
        out = np.zeros(len(a), bool)
        for i in range(0, len(a), PAIRS_AT_ONCE):
            p, q = a[i:i + PAIRS_AT_ONCE], b[i:i + PAIRS_AT_ONCE]
            count = (np.abs(self.window[p] - self.window[q]) <= self.plan.half).sum(axis=1)
            c = np.nonzero(count >= self.plan.count)[0]
            p, q = p[c], q[c]
            good = np.einsum("ij,ij->i", self.unit[p], self.unit[q]) >= self.plan.tau
            met = (self.cell[p] == self.cell[q]).argmax(axis=1) == self.nth[p]
            out[i + c[good & met]] = True
        return out

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same as a matrix for all rows ``a`` against all rows ``b``."""
        count = np.zeros((len(a), len(b)), np.int8)
        for i in range(DIRECTIONS):
            count += np.abs(self.window[a, i][:, None] - self.window[b, i][None, :]) <= np.float32(self.plan.half)
        near = count >= self.plan.count
        if near.any():
            near &= self.unit[a] @ self.unit[b].T >= self.plan.tau
            for t in range(int(self.nth[a[0]])):
                near &= self.cell[a, t][:, None] != self.cell[b, t][None, :]
        return near


def _rows(node, root, links):
    return pd.DataFrame({"node": node, "root": root, "links": links})


def _compare_small(plan, rows: pd.DataFrame, sizes: np.ndarray):
    g = _Group(plan, rows)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = first + np.repeat(sizes, sizes) - np.arange(len(rows)) - 1  # mates after each row
    a = np.repeat(np.arange(len(rows)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    hit = g.listed(a, b)
    a, b = a[hit], b[hit]
    if len(a):
        yield _rows(np.concatenate([g.node[a], g.node[b]]), np.concatenate([g.node[b], g.node[a]]), np.concatenate([g.weight[b], g.weight[a]]))


def _compare_large(plan, rows: pd.DataFrame):
    """One slot: rows of one block, or of two blocks that are compared with each other."""
    g = _Group(plan, rows)
    sides = rows["side"].to_numpy()
    one, two = (np.nonzero(sides == s)[0] for s in (0, 1))
    alone = not rows["apart"].iloc[0]
    if alone:
        one = two = np.arange(len(rows))
    for i in range(0, len(one), 512):
        a = one[i:i + 512]
        b = two[i:] if alone else two
        if not len(b):
            continue
        near = g.block(a, b)
        if alone:
            near &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
        if near.any():
            r, r_root, c, c_root = forest(near)
            yield _rows(g.node[a[r]], g.node[b[r_root]], (near @ g.weight[b])[r])
            yield _rows(g.node[b[c]], g.node[b[c_root]], (near.T @ g.weight[a])[c])


def _compare(plan):
    def done(rows):
        starts = np.nonzero(np.r_[True, rows["slot"].to_numpy()[1:] != rows["slot"].to_numpy()[:-1]])[0]
        sizes = np.diff(np.append(starts, len(rows)))
        few = np.repeat((sizes > 1) & (sizes <= SMALL) & ~rows["apart"].to_numpy()[starts], sizes)
        for dim, part in rows[few].groupby(rows["v"].map(len)[few], sort=False):
            n = part.groupby("slot", sort=False).size().to_numpy()
            at = np.append(0, np.cumsum(n))
            for i, j in chunks(n.tolist(), 20_000):
                yield from _compare_small(plan.value, part.iloc[at[i]:at[j]], n[i:j])
        for s, n in zip(starts, sizes):
            if n > 1 and not few[s]:
                yield from _compare_large(plan.value, rows.iloc[s:s + n])

    def run(batches):
        held = []
        for b in batches:
            last = b["slot"].iloc[-1] if len(b) else None
            if last is None:
                continue
            whole = b["slot"].to_numpy() != last
            if held and (whole.any() or held[-1]["slot"].iloc[-1] != last):
                yield from done(pd.concat([*held, b[whole]], ignore_index=True))
                held = []
            elif whole.any():
                yield from done(b[whole].reset_index(drop=True))
            held.append(b[~whole])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return run


def links(uniq: DataFrame, n: int, tau: float) -> DataFrame:
    """Partial results ``node, root, links`` over the distinct vectors ``node, weight, v``."""
    spark = uniq.sparkSession
    prepare(spark)
    plan = spark.sparkContext.broadcast(Plan(n, tau))
    rows = uniq.mapInPandas(_to_cells(plan), "nth int, cell long, node long, weight long, v binary")
    sizes = uniq.mapInPandas(_to_cells(plan), "nth int, cell long, node long, weight long, v binary").groupBy("cell").count()
    hot = saved(sizes.where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    n_hot = hot.count()
    rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST_ROWS else hot, "cell", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select(F.when(F.col("blocks") > 1, F.xxhash64("cell", low, high)).otherwise(F.col("cell")).alias("slot"), "nth", "node", "weight", "v",
                       (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") != F.col("other")).alias("apart"))
    return rows.repartition("slot").sortWithinPartitions("slot").mapInPandas(_compare(plan), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, tau: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = (F.col("vec_id").isNotNull() & F.col("v").isNotNull()
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sound = F.coalesce(sound, F.lit(False))
    uniq = saved(d.where(sound).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
                 .withColumn("node", F.monotonically_increasing_id()))
    found = saved(links(uniq.select("node", "weight", "v"), uniq.count(), tau))
    per = uniq.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    parts = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = per.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    firsts = per.groupBy("part").agg(F.min("first").alias("component_id")).select((-F.col("part")).alias("np"), "component_id")
    per = per.withColumn("np", -F.col("part")).join(firsts, "np")
    per = saved(per.select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = d.where(sound).join(per, "v").select("vec_id", "n_links", "component_id")
    lone = d.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, reach) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
  (SELECT min(reach) FROM r WHERE r.node = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(reach) FROM r WHERE r.node = e.vec_id) AS kept
FROM embeddings e
"""
