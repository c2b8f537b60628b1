"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is 64 bits wide: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's word
shingles.  Two fingerprints link at ``max_bits`` (3) or fewer differing bits.

Candidates: the fingerprint is cut into segments of 22, 21 and 21 bits.  Of three errors at most one can lie in each
of *some* two segments (drop the one with the most errors), so it is enough to join on segment pairs whose parts
differ by at most one bit.  The perfect binary Golay code (23, 12) maps each segment to the index of the only codeword
within 3 bits.  A segment's several keys are the indices of itself and of its one-bit neighbours (1 to 6 different
ones): a segment that differs by one bit is one of those neighbours, so its own index is among the keys.  Every
distinct fingerprint is stored under the own indices of its 3 segment pairs (24-bit keys) and asked for under all keys
of its pairs; what meets is verified by the bit distance.

Scale: equal fingerprints are one row; rows meet in partitions sorted by key and pass in Arrow batches, the stored
side first.  A key that stores more than ``KEY_ROWS`` fingerprints is dealt over salts, each with its share of the
stored rows (the askers go to each), so no task holds more.  Only links leave a task: for a
key with many stored rows those of a spanning forest of each batch, not all pairs.  Texts never move.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; fewer words than ``n`` make
one shingle; rows without id get the component of their fingerprint (null if no member has an id); repeated rows
share everything; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, only, prepare, saved, text_column
from .components import connected

SEED = 42
KEY_ROWS = 4096
HOT_BROADCAST_ROWS = 100_000  # the map of hot keys is broadcast up to this count and joined by shuffle beyond it
MANY = 32  # stored rows under a key from which links are thinned to a forest
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # offset, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
# Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, n: int = 3) -> int:
    """Signed 64-bit SimHash of a text over its ``n``-word shingles, repeats included."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and blank, tab to carriage return only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        shingles = [line]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [line[s:e] for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist())]
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        ones += np.unpackbits(h[i:i + 16384], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def _digest():
    return F.unhex(F.sha2(text_column("`text`"), 256))


def _fp(n: int):
    """``fingerprint`` of a text column, one text at a time out of each Arrow batch."""

    @F.arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), n) for t in text], pa.int64())

    return fp


def fingerprints(docs: DataFrame, n: int = 3, digest: bool = False) -> DataFrame:
    """``doc_id, fp`` per row of ``docs`` and, if asked for, ``digest`` of the text."""
    prepare(docs.sparkSession)
    fp = _fp(n)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), fp(text_column()).alias("fp"), *[_digest().alias("digest")] * digest)


def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit high part, and the error pattern (at most 3 bits) of each 11-bit remainder."""
    high = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        high = np.where(high >> bit & 1, high ^ (GENERATOR << (bit - 11)), high)

    def rest(x):
        return (x & 0x7FF) ^ high[x >> 11]

    one = 1 << np.arange(23, dtype=np.int64)
    errors = np.unique(np.concatenate([[0], one, (one[:, None] | one).ravel(), (one[:, None, None] | one[:, None] | one).ravel()]))
    pattern = np.zeros(1 << 11, np.int64)
    pattern[rest(errors)] = errors
    return high, pattern


_TABLES: list = []


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the only codeword within 3 bits of each 23-bit word."""
    if not _TABLES:
        _TABLES.extend(_syndrome_tables())
    high, pattern = _TABLES
    return (x ^ pattern[(x & 0x7FF) ^ high[x >> 11]]) >> 11


def segment_keys(fp: np.ndarray) -> list[np.ndarray]:
    """Per segment an array (rows, 1 + bits): the own index first, then those of the one-bit neighbours; repeats -1."""
    u = fp.view(np.uint64)
    out = []
    for offset, bits in SEGMENTS:
        x = ((u >> np.uint64(offset)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        k = golay_index(x[:, None] ^ np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64))))
        order = np.sort(k, axis=1)
        first = np.concatenate([np.ones((len(k), 1), bool), order[:, 1:] != order[:, :-1]], axis=1)
        rest = np.where(first & (order != k[:, :1]), order, -1)
        rest = -np.sort(-rest, axis=1)[:, :8]  # at most 5 others; the rest of the columns is -1
        out.append(np.concatenate([k[:, :1], rest], axis=1))
    return out


def _stored_and_asked(batches):
    """Rows ``key, asks, fp``: every fingerprint stored under 3 keys and asked for under all its keys."""
    for b in batches:
        for at in range(0, len(b), 20_000):
            fp = b["fp"].to_numpy()[at:at + 20_000]
            keys = segment_keys(fp)
            for p, (i, j) in enumerate(PAIRS):
                k = (np.int64(p) << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :]
                good = (keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0)
                yield pd.DataFrame({"key": k[:, 0, 0], "asks": np.zeros(len(fp), np.int8), "fp": fp})
                row = np.broadcast_to(np.arange(len(fp))[:, None, None], good.shape)[good]
                yield pd.DataFrame({"key": k[good], "asks": np.ones(len(row), np.int8), "fp": fp[row]})


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(asked: np.ndarray, stored: np.ndarray, max_bits: int):
    """Links that connect what ``asked`` x ``stored`` connects, at most one per row of either."""
    rows, row_root, cols, col_root = forest(_distance(asked[:, None], stored[None, :]) <= max_bits)
    return np.concatenate([asked[rows], stored[cols]]), np.concatenate([stored[row_root], stored[col_root]])


def _links(max_bits: int):
    def run(batches):
        stored_key = np.empty(0, np.int64)
        stored_fp = np.empty(0, np.int64)
        for b in batches:
            key, asks, fp = b["slot"].to_numpy(), b["asks"].to_numpy() > 0, b["fp"].to_numpy()
            stored_key = np.concatenate([stored_key, key[~asks]])
            stored_fp = np.concatenate([stored_fp, fp[~asks]])
            qk, q = key[asks], fp[asks]
            lo, hi = np.searchsorted(stored_key, qk, "left"), np.searchsorted(stored_key, qk, "right")
            count = hi - lo
            few = np.nonzero((count > 0) & (count <= MANY))[0]
            at = np.repeat(few, count[few])
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count[few]) - count[few], count[few])
            a, s = q[at], stored_fp[lo[at] + nth]
            hit = (a > s) & (_distance(a, s) <= max_bits)
            out = [(a[hit], s[hit])]
            many = np.nonzero(count > MANY)[0]
            for k in np.unique(qk[many]):
                rows = many[qk[many] == k]
                mine = stored_fp[lo[rows[0]]:hi[rows[0]]]
                for i in range(0, len(rows), 512):
                    out.append(_forest(q[rows[i:i + 512]], mine, max_bits))
            a, s = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
            links = np.unique(np.stack([np.minimum(a, s), np.maximum(a, s)], axis=1)[a != s], axis=0)
            if len(links):
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})
            keep = stored_key == key[-1] if len(key) else slice(0, 0)
            stored_key, stored_fp = stored_key[keep], stored_fp[keep]

    return run


def near_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``a, b`` that connect every two of the distinct fingerprints ``fp`` at ``max_bits`` or fewer bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("segment pairs with at most one error each cover up to 3 differing bits")
    rows = fps.select("fp").mapInPandas(_stored_and_asked, "key long, asks byte, fp long")
    hot = saved(rows.where("asks = 0").groupBy("key").count().where(F.col("count") > KEY_ROWS)
                .select("key", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("salts")))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST_ROWS else hot, "key", "left")
        salt = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(
            F.col("asks") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))).otherwise(
            F.sequence(F.lit(0), F.col("salts") - 1))
        rows = rows.withColumn("salt", F.explode(salt))
    else:
        rows = rows.withColumn("salt", F.lit(0))
    slots = rows.select((F.col("key") * (1 << 32) + F.col("salt")).alias("slot"), "asks", "fp")
    return slots.repartition("slot").sortWithinPartitions("slot", "asks").mapInPandas(_links(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, n: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; ``component_id`` is the smallest id reachable by links."""
    return _groups(fingerprints(docs, n), max_bits).select("doc_id", "fp", "component_id")


def _groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fps`` with ``component`` (a fingerprint of the group) and ``component_id``."""
    d = saved(fps)
    per = saved(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = connected(near_links(per, max_bits))
    per = per.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = per.groupBy("component").agg(F.min("first").alias("component_id"))
    per = saved(per.select("fp", (-F.col("component")).alias("nc")).join(
        firsts.select((-F.col("component")).alias("nc"), "component_id"), "nc").select("fp", (-F.col("nc")).alias("component"), "component_id"))
    return d.join(per, "fp")


def dedupe(docs: DataFrame, n: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; of a group's rows with that id the one of the least
    digest of its text stays (of equal texts, that of the least hash of all columns).
    Of a group without any id one row stays: of its least fingerprint the one of the least digest, then hash."""
    g = _groups(fingerprints(docs, n, digest=True), max_bits)
    ids = g.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id"), "component").agg(F.min("digest").alias("kept_digest"))
    ids = ids.select("kept_id", "kept_digest")  # texts of one digest are in one component
    named = docs.where(F.col("`doc_id`").isNotNull()).select(
        F.struct("*").alias("row"), F.col("`doc_id`").cast("long").alias("kept_id"), _digest().alias("kept_digest"), F.xxhash64("*").alias("hash"))
    kept = named.join(ids, ["kept_id", "kept_digest"], "left_semi").groupBy("kept_id", "kept_digest").agg(F.min_by("row", "hash").alias("row")).select("row.*")
    lone = g.where("doc_id is null and component_id is null").groupBy("component").agg(F.min("fp").alias("fp")).select("fp")
    return kept.unionByName(_unnamed(docs, lone, n))


def _unnamed(docs: DataFrame, lone: DataFrame, n: int) -> DataFrame:
    """One row without id per fingerprint of ``lone``, by a fixed order."""

    fp = _fp(n)
    packed = docs.where(F.col("`doc_id`").isNull()).select(
        F.struct(F.col("*")).alias("row"), fp(text_column("`text`")).alias("fp"), F.struct(_digest().alias("d"), F.xxhash64("*").alias("h")).alias("order"))
    return packed.join(lone, "fp", "left_semi").groupBy("fp").agg(F.min_by("row", "order").alias("row")).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
