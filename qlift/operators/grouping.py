"""Groups of near-equal texts, splits that keep them together, and a leak report.

Two texts belong together if they share a run of ``n`` words (a shorter text: all of it).  Runs that more than ``common`` of all rows
hold (a licence line, a greeting) link nothing and count as no leak.  The runs are cut in one pass over the texts and exchanged once, as
packed digests (some 12 bytes a run) by ranges of the digest.  In a range equal digests stand together: how many rows hold the run and
the least of them, its head.  Runs that the same rows hold (of a copied passage all) are one block with a weight, so that two rows that
share hundreds of runs have one block.  A row is linked to the heads of its blocks only, once each: a block with thousands of rows costs
thousands of rows, not pairs.  The groups are the connected components of these links, by alternating star operations.
"""

from __future__ import annotations

from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from ..session import Stored, ship_package

RUN = 8
COMMON = 0.02
MAX_GROUP = 0.005
# The key of the word hashes and the factor from word to word of the two halves of a digest; bytes of text cut at once, and
# of those whose runs are compared at once.
LANES = (("runs of words, 1", 0x9E3779B97F4A7C15), ("runs of words, 2", 0xC2B2AE3D27D4EB4F))
PART = 1 << 20
RANGE = 8 << 20


def _digests(words: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different runs of ``n`` words of each text as (number of the text, 128-bit digest, least hash of its pieces of half as many
    words); a shorter text is one run, one without words has none.  A digest is the sum of keyed 64-bit hashes of the words, each times its
    place's power, in two lanes.  Neighbours often have the same least piece."""
    size = np.array([len(w) for w in words])
    room = np.where(size > 0, np.maximum(size, n), 0)  # a shorter text is filled up with zeros
    codes, different = pd.factorize(np.array([*chain.from_iterable(words)], dtype=object))
    start = np.cumsum(room) - room
    at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    per_text = np.where(size > 0, room - n + 1, 0)
    text = np.repeat(np.arange(len(words)), per_text)
    first = np.arange(per_text.sum()) + np.repeat(start - (np.cumsum(per_text) - per_text), per_text)

    def summed(h, n, power):
        out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            out = out * np.uint64(power) + h[k : k + len(out)]
        return out

    lanes = []
    for key, power in LANES:
        h = np.zeros(room.sum(), np.uint64)
        h[at] = hash_array(different, hash_key=key, categorize=False)[codes]
        lanes.append(summed(h, n, power)[first])
    half = max(n // 2, 1)
    pieces = summed(h, half, power)
    near = pieces[: max(len(pieces) - (n - half), 0)]
    for k in range(1, n - half + 1):
        near = np.minimum(near, pieces[k : k + len(near)])
    # equal runs of a text stand side by side in the order of text and digest folded into 64 bits
    order = np.argsort(lanes[0] ^ (text.astype(np.uint64) * np.uint64(LANES[1][1])))
    text, runs = text[order], np.stack(lanes, 1)[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (runs[1:] != runs[:-1]).any(1)
    return text[new], runs[new], near[first][order][new]


def _over_texts(df: DataFrame, key: str, text: str, n: int, make, schema: str, *fixed) -> DataFrame:
    """``make`` of the nodes and ``_digests`` of parts of the texts, whose words are those of ``tokens.tokenize``: lower case by Spark, cut by
    ``str.split``, which knows the same white space.  ``fixed``: columns with one value, which ``make`` gets too."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            nodes, texts = b.column(0), b.column(1)
            values = [b.column(i)[0].as_py() for i in range(2, b.num_columns) if len(nodes)]
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PART
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]):
                yield make(nodes.slice(i, j - i), *_digests([t.split() for t in texts.slice(i, j - i).to_pylist()], n), *values)

    return df.select(F.col(key).alias("node"), F.lower(F.coalesce(text, F.lit(""))).alias("text"), *fixed).mapInArrow(run, schema)


def word_runs(df: DataFrame, key: str, text: str, n: int = RUN) -> DataFrame:
    """``node, block``: the different runs of ``n`` words of every text as 128-bit digests."""

    def make(nodes, of, runs, near):
        offsets = pa.py_buffer(np.arange(0, 16 * len(runs) + 1, 16, dtype=np.int32))
        blocks = pa.Array.from_buffers(pa.binary(), len(runs), [None, offsets, pa.py_buffer(np.ascontiguousarray(runs))])
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(of)), blocks], names=["node", "block"])

    return _over_texts(df, key, text, n, make, f"node {df.schema[key].dataType.simpleString()}, block binary")


def run_counts(df: DataFrame, key: str, text: str, n: int = RUN) -> DataFrame:
    """``node, runs``: how many different runs every text has."""

    def make(nodes, of, runs, near):
        return pa.RecordBatch.from_arrays([nodes, pa.array(np.bincount(of, minlength=len(nodes)), pa.int32())], names=["node", "runs"])

    return _over_texts(df, key, text, n, make, f"node {df.schema[key].dataType.simpleString()}, runs int")


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as the eight byte planes of their differences, which compress well where neighbours are close."""
    return np.ascontiguousarray(np.diff(numbers, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel(), dtype=np.int64)


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, and where in it each pair starts."""
    order = np.argsort(first)
    x, y = first[order], second[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # rare: different pairs with an equal first half
        order = np.lexsort((second, first))
        x, y = first[order], second[order]
        same = x[1:] == x[:-1]
    return order, np.flatnonzero(np.r_[True, ~(same & (y[1:] == y[:-1]))][: len(order)])


def _mixed(numbers: np.ndarray, key: int) -> np.ndarray:
    """Keyed 64-bit hashes of numbers (the finish of splitmix64)."""
    x = numbers.astype(np.uint64) * np.uint64(LANES[0][1]) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_runs(df: DataFrame, key: str, text: str, n: int = RUN, common: float = COMMON) -> DataFrame:
    """``node, block, head, weight``: the ``blocks`` of the rows, and for every row of ``df`` one with the number of its different runs
    as ``weight``, whose ``block`` is null.

    A run travels as 80 bits of its digest to a range that its least piece tells, so that much of a copied passage stays together: among
    ``N`` different runs in ``R`` ranges any two are taken for one with a chance of some ``N ** 2 / R / 2 ** 81``.  A range holds the runs of
    some ``RANGE`` bytes of text.  Whole numbers as keys travel as packed differences, other keys as they are."""
    kind, whole = df.schema[key].dataType, isinstance(df.schema[key].dataType, IntegralType)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = F.greatest(F.lit(least), F.ceil(df.select(F.sum(F.octet_length(F.col(text).cast("string")))).scalar() / RANGE))
    most = F.lit(common) * df.select(F.count(F.lit(1))).scalar()
    schema = f"range long, most double, nodes {'binary' if whole else f'array<{kind.simpleString()}>'}, nulls boolean, runs binary, counts binary"

    def sent(nodes, of, runs, near, ranges, most):
        counts = np.bincount(of, minlength=len(nodes)).astype(np.int32)
        into = ((_mixed(near, LANES[1][1]) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        null = nodes.is_null().to_numpy(zero_copy_only=False)
        numbers = nodes.fill_null(0).cast(pa.int64()).to_numpy() if whole else None
        rows = []

        def put(where, texts, null, runs=None, counts=None):
            said = _packed(numbers[texts]) if whole else nodes.take(pa.array(texts)).to_pylist()
            rows.append((where, most, said, null, runs, counts))

        for none in (False, True):
            some = np.flatnonzero(null == none)
            if len(some):
                put(int(some[0]) % ranges, some, none, counts=counts[some].tobytes())
            some = np.flatnonzero(null[of] == none)
            order = some[np.argsort(into[some] * np.uint64(len(nodes)) + of[some].astype(np.uint64))]
            ends = np.flatnonzero(np.diff(into[order])) + 1
            for part in np.split(order, ends) if len(order) else []:
                digests = runs[part, 0].tobytes() + (runs[part, 1] >> np.uint64(16)).astype(np.uint16).tobytes()
                put(int(into[part[0]]), of[part], none, runs=digests)
        columns = [*zip(*rows)] or [()] * 6
        kinds = [pa.int64(), pa.float64(), pa.binary() if whole else pa.list_(nodes.type), pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "most", "nodes", "nulls", "runs", "counts"])

    def nodes_of(rows):
        lists = rows["nodes"].to_pylist()
        if not whole:
            return pa.array([*chain.from_iterable(lists)], rows.schema.field("nodes").type.value_type)
        lists = [_unpacked(x) for x in lists]
        null = np.repeat(np.array(rows["nulls"].to_pylist(), bool), [len(x) for x in lists])
        return pa.array(np.concatenate([np.empty(0, np.int64), *lists]), mask=null)

    def hashed(values):
        """Numbers in the order of the values, whether they are null, and two hashes of each."""
        null = values.is_null().to_numpy(zero_copy_only=False)
        if whole:
            numbers = values.fill_null(0).to_numpy(zero_copy_only=False)
            return numbers, null, [np.where(null, np.uint64(k), _mixed(numbers, k)) for _, k in LANES]
        spelled = values.to_pylist()
        numbers, _ = pd.factorize(pd.Series(spelled, dtype=object), sort=True)
        spelled = np.array([repr(x) for x in spelled], dtype=object)
        return numbers.astype(np.int64), null, [hash_array(spelled, hash_key=k, categorize=False) for k, _ in LANES]

    def made(values, block, head, weight):
        columns = [values, block, head, pa.array(weight, pa.int64())]
        return pa.table([c.cast(as_arrow) if whole and i in (0, 2) else c for i, c in enumerate(columns)], names=names)

    def compared(rows):
        counted, rows = rows.filter(pc.is_valid(rows["counts"])), rows.filter(pc.is_valid(rows["runs"]))
        values = nodes_of(counted)
        counts = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in counted["counts"].to_pylist())])
        out = [made(values, pa.nulls(len(counts), pa.binary()), pa.nulls(len(counts), values.type), counts)]
        if not len(rows):
            return out[0]
        parts = rows["runs"].to_pylist()
        order, start = _groups(np.concatenate([np.frombuffer(x, np.uint64, len(x) // 10) for x in parts]),
                               np.concatenate([np.frombuffer(x, np.uint16, offset=len(x) // 10 * 8) for x in parts]))
        size = np.diff(np.r_[start, len(order)])
        held = (size > 1) & (size <= rows["most"][0].as_py())
        values = nodes_of(rows).take(pa.array(order[np.repeat(held, size)]))  # of the runs that are held, run by run
        size = size[held]
        start = np.cumsum(size) - size
        if len(values):
            numbers, null, hashes = hashed(values)
            marks = [np.add.reduceat(h, start) for h in hashes]
            alike, lead = _groups(*marks)  # runs that the same rows hold: one of them, and how many
            weight, one = np.diff(np.r_[lead, len(alike)]), alike[lead]
            size, begin = size[one], start[one]
            start = np.cumsum(size) - size
            members = np.arange(size.sum()) + np.repeat(begin - start, size)
            values, numbers, null = values.take(pa.array(members)), numbers[members], null[members]
            least = np.minimum.reduceat(np.where(null, np.iinfo(np.int64).max, numbers), start)
            at = np.flatnonzero((numbers == np.repeat(least, size)) & ~null)
            head = np.full(len(one), -1)
            head[np.repeat(np.arange(len(one)), size)[at]] = at
            head = np.repeat(head, size)
            marks = np.ascontiguousarray(np.repeat(np.stack(marks, 1)[one], size, axis=0))
            offsets = pa.py_buffer(np.arange(0, 16 * len(marks) + 1, 16, dtype=np.int32))
            block = pa.Array.from_buffers(pa.binary(), len(marks), [None, offsets, pa.py_buffer(marks)])
            out.append(made(values, block, values.take(pa.array(head, mask=head < 0)), np.repeat(weight, size)))
        return pa.concat_tables(out)

    names, as_arrow = ["node", "block", "head", "weight"], to_arrow_type(kind) if whole else None
    raw = _over_texts(df, key, text, n, sent, schema, ranges.cast("long").alias("ranges"), most.alias("most")).groupBy("range")
    raw = raw.applyInArrow(compared, f"node {kind.simpleString()}, block binary, head {kind.simpleString()}, weight long")
    row = F.when(F.col("block").isNull(), F.monotonically_increasing_id())
    raw = raw.withColumn("_qx_row", row).repartition("block", "_qx_row")  # a block's rows side by side, as they are made
    return raw.groupBy("block", "_qx_row", "node").agg(F.min("head").alias("head"), F.sum("weight").alias("weight")).select(*names)


def blocks(df: DataFrame, key: str, text: str, n: int = RUN, common: float = COMMON) -> DataFrame:
    """``node, block, head, weight`` of the runs that two rows at least hold, but not more than ``common`` of all: runs that the same
    rows hold are one block, ``weight`` of them, with the least row that holds them; ``key`` must be unique."""
    return shared_runs(df, key, text, n, common).where("block IS NOT NULL")


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def group_labels(held: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, label``: the least node that is reached through shared blocks, for every node of ``node, head`` that has a link.

    Each round hangs every node's larger neighbours on the least node it knows, then its smaller ones, until every group is a star
    around its least node.  The tables of the rounds stand in the shared folder; two numbers a round reach the driver."""
    tables = Stored(held.sparkSession, "groups")
    links = tables.put(held.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # two 64-bit hashes of every link, summed and by exclusive or: equal for different links in one of 2**128 cases
        now = tuple(links.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(11), "u", "v"))).first())
        if now == before:
            centres = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.put(large)
        least = _least_neighbour(large)
        small = (large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        links = tables.put(small)
        tables.forget(1)
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def grouped_split(df: DataFrame, key: str, text: str, n: int = RUN, common: float = COMMON, max_group: float = MAX_GROUP,
                  held: DataFrame | None = None) -> DataFrame:
    """D9 (derived): ``df`` with ``group_id`` (the least key of its group) and ``split``, 8:1:1 by rows, whole groups.

    A group of more than ``max_group`` of all rows goes to ``train``; the others are dealt by the md5 of the group id, with the
    shares of ``val`` and ``test`` raised so that each expects a tenth of all rows.  As no dealt group is larger, either share's
    standard deviation is below ``sqrt(0.1 * max_group)`` of all rows (2.3 % for the default).  ``val`` and ``test`` share no run
    with ``train`` but common ones.  ``held``: the ``blocks`` of ``df``, where the caller has them.
    """
    labels = group_labels(blocks(df, key, text, n, common) if held is None else held)
    d = df.join(labels.withColumnRenamed("node", key), key, "left").withColumn("group_id", F.coalesce("label", key)).drop("label")
    sizes = d.groupBy("group_id").agg(F.count(F.lit(1)).alias("_qx_n"))
    total = df.select(F.count(F.lit(1))).scalar().cast("double")
    large = F.col("_qx_n") > F.lit(max_group) * total
    sizes = sizes.withColumn("_qx_large", large)
    held = sizes.where("_qx_large").select(F.coalesce(F.sum("_qx_n"), F.lit(0))).scalar()
    u = F.conv(F.substring(F.md5(F.col("group_id").cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    p = F.least(F.lit(0.5), F.try_divide(F.lit(0.1), F.lit(1.0) - held / total))
    split = F.when(F.col("_qx_large"), "train").when(u < p, "test").when(u < p * 2, "val").otherwise("train")
    return d.join(sizes.select("group_id", split.alias("split")), "group_id").select(*[F.col(f"`{c}`") for c in df.columns], "group_id", "split")


def leak_report(df: DataFrame, key: str, text: str, split: str = "split", n: int = RUN, common: float = COMMON,
                held: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """D9 (derived): ``split, rows, leaking, max_containment`` of the rows outside ``train``: how many share a run with a training row,
    and the largest share of a row's runs that training rows hold.  ``held``: the ``blocks`` of ``df``, where the caller has them;
    ``runs``: its ``run_counts`` (of a ``df`` whose split goes by key), so that no text is cut again."""
    held = blocks(df, key, text, n, common) if held is None else held
    inc = held.select("node", "block", "weight").join(df.select(F.col(key).alias("node"), F.col(split).alias("_qx_s")), "node")
    seen = F.max(F.col("_qx_s") == "train").over(Window.partitionBy("block"))
    leaks = inc.withColumn("_qx_seen", seen).where("_qx_seen AND _qx_s <> 'train'").groupBy("node").agg(F.sum("weight").alias("shared"))
    rest = df.where(F.col(split) != "train")
    if runs is None:
        counts = run_counts(rest.withColumn("_qx_row", F.struct(F.col(key).alias("node"), F.col(split).alias("split"))), "_qx_row", text, n)
        rest = counts.select("node.node", "node.split", "runs")
    else:
        keys = rest.select(F.col(key).alias("_qx_node"), F.col(split).alias("split")).distinct()
        rest = runs.join(keys, F.col("node").eqNullSafe(F.col("_qx_node"))).select("node", "split", "runs")
    share = F.try_divide(F.coalesce("shared", F.lit(0)).cast("double"), F.col("runs"))
    return (rest.join(leaks, "node", "left").groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("shared").alias("leaking"), F.round(F.max(F.coalesce(share, F.lit(0.0))), 6).alias("max_containment")))
