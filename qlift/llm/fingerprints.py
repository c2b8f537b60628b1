"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (its lines).  Every paragraph is hashed to a wide vector and the vectors are summed,
so the order of the paragraphs does not matter, and paragraphs can be inserted or deleted by adding or subtracting:

* 8 exact lanes modulo 2**64, the 512 bits of the paragraph's BLAKE2b digest: equal multisets have equal lanes, and two
  given different ones have equal lanes with a probability of about 2**-512 (it is no defence against texts made up to collide);
* 256 lanes of +1 or -1 modulo 2**32 (a text has under 2**30 pieces) for the likeness, where the unit is smaller: a paragraph is cut after words that a hash
  picks (one in four), so that an edit changes only the pieces it touches.  The inner product of these lanes estimates how much two texts
  share, so the cosine of two fingerprints is their likeness (0 to 1, error about 0.06).

A paragraph, or a piece, is its words; white space inside it does not count.  ``op6`` compares each text with its edited text and with
the next document's.  For that, documents are dealt into buckets of consecutive ids; a bucket also gets a copy of the first
document of the next one, and one pass over the sorted bucket sees every neighbour.  Texts are shuffled once.

Edge cases: a null text is empty; texts without words have the zero fingerprint, like each other (likeness 1) and
nothing else (0); rows without id come first in the order, rows of one id follow each other by text; a single document is
its own next; an empty table gives an empty result; other columns of the caller are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_blocks, prepare, text_column

EXACT_LANES = 8
SIGN_WORDS = 4  # 64 signs each
WIDTH = EXACT_LANES * 4 + SIGN_WORDS * 64 * 2  # in 16-bit units
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 10_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[list[bytes]]:
    """The words of each paragraph that has any."""
    return [w for w in map(bytes.split, text.encode("utf-8", "replace").split(b"\n")) if w]


def exact_lanes(lines: list[list[bytes]]) -> np.ndarray:
    """The sum of the paragraphs' 512-bit digests, lane by lane modulo 2**64."""
    digests = b"".join([hashlib.blake2b(b" ".join(ws)).digest() for ws in lines])
    return np.frombuffer(digests, "<u8").reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)


def pieces(lines: list[list[bytes]]) -> np.ndarray:
    """A 64-bit hash per piece of the paragraphs."""
    if not lines:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lines)), np.uint64)
    ends = (words & np.uint64(3)) == 0
    ends[np.cumsum([len(w) for w in lines]) - 1] = True
    starts = np.concatenate(([0], np.nonzero(ends)[0][:-1] + 1))
    nth = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    return _mixed(np.add.reduceat(_mixed(words + _ODD) * _POWERS[nth % len(_POWERS)], starts))


def sign_lanes(hashes: np.ndarray) -> np.ndarray:
    """The sum of the pieces' signs."""
    signs = np.zeros(SIGN_WORDS * 64, np.int64)
    for i in range(0, len(hashes), 8192):
        h = hashes[i:i + 8192, None]
        s = _mixed(h + _ODD * np.arange(101, 101 + SIGN_WORDS, dtype=np.uint64))
        ones = np.unpackbits(s.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
        signs += 2 * ones - len(h)
    return signs


def fingerprint(text: str | None) -> np.ndarray:
    """``WIDTH`` 16-bit units, the exact lanes first."""
    lines = paragraphs(text or "")
    return np.concatenate([exact_lanes(lines).view(np.uint16), sign_lanes(pieces(lines)).astype(np.uint32).view(np.uint16)])


def _summed(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    n = EXACT_LANES * 4
    x, y = a[:n].view(np.uint64), b[:n].view(np.uint64)
    s, t = a[n:].view(np.uint32), b[n:].view(np.uint32)
    return np.concatenate([(x + y if sign > 0 else x - y).view(np.uint16), (s + t if sign > 0 else s - t).view(np.uint16)])


def insert(fp: np.ndarray, text: str) -> np.ndarray:
    """The fingerprint with the paragraphs of ``text`` added."""
    return _summed(fp, fingerprint(text), 1)


def delete(fp: np.ndarray, text: str) -> np.ndarray:
    """The fingerprint with the paragraphs of ``text`` taken out."""
    return _summed(fp, fingerprint(text), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated cosine of the two multisets, 0 to 1; exactly 1 for equal fingerprints."""
    if (a == b).all():
        return 1.0
    x, y = (v[EXACT_LANES * 4:].view(np.int32).astype(float) for v in (a, b))
    norm = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / norm, 0.0, 1.0)) if norm else 0.0


def spelled(fp: np.ndarray) -> str:
    return base64.b64encode(fp.tobytes()).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (one of that name is replaced)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: spelled(fingerprint(t)))

    return docs.withColumn("fingerprint", of(text_column("`text`")))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``key, doc_id, text, bucket, copy`` in partitions sorted by bucket and key; each bucket ends with a copy
    (``copy = 1``) of the row that follows its last one.  ``key`` is the id, null as the least number."""
    d = docs.select(F.coalesce(F.col("`doc_id`").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("`doc_id`").cast("long").alias("doc_id"), text_column("`text`").alias("text"))
    n = min(count_blocks(d, "text", BUCKET_BYTES, 16), MOST_BUCKETS)
    cuts = sorted(set(map(int, d.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) or [])))
    shared = d.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), "right").astype(np.int32))

    heads = d.select("key", bucket("key").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    follows = [(h["key"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]  # at most MOST_BUCKETS rows
    follows = d.sparkSession.createDataFrame(follows, "key long, bucket int")
    copies = d.join(F.broadcast(follows), "key").select("key", "doc_id", "text", "bucket", F.lit(1).alias("copy"))
    rows = d.select("key", "doc_id", "text", bucket("key").alias("bucket"), F.lit(0).alias("copy")).unionByName(copies)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", "key", "text")


def _compare(batches):
    held = None  # the row that waits for its next one
    for b in batches:
        out = []
        for bucket, copy, doc_id, text in zip(b["bucket"], b["copy"], b["doc_id"], b["text"]):
            fp = fingerprint(text)
            if held and held[0] == bucket:
                _, old_id, old, old_fp = held
                cut = len(old) // 4
                edited = old[: len(old) - cut] + text[:cut]
                edited_fp = fingerprint(edited)
                out.append((old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), spelled(old_fp), spelled(edited_fp),
                            likeness(old_fp, edited_fp), likeness(old_fp, fp)))
            held = None if copy else (bucket, None if pd.isna(doc_id) else int(doc_id), text, fp)
        if out:
            d = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield d.astype({"doc_id": "Int64"})


def edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the fingerprints of its text and its edited text, and what they are like."""
    prepare(docs.sparkSession)
    return with_next(docs).mapInPandas(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
