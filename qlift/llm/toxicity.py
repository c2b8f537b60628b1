"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = 1 / (1 + exp(theta_k - w . x))`` with one weight vector for all ordered thresholds ``theta``; the
result is the expected severity, the sum of these probabilities.  Features are the presence of a text's lower-case words
and of their beginnings (4 to 7 letters), hashed into ``1 << BITS`` buckets; kept are those that occur in ``least_docs``
documents of the sample and whose log-odds between toxic and clean ones are ``least_z`` standard errors away from zero.

Grades: labels only say toxic or not, so the learning rows get grades in two steps.  Words at least ``lift`` times as
likely in toxic as in clean documents (smoothed, one-sided) are marker words; a clean document has grade 0, a toxic one grade 1, 2 or 3 by
the different markers it holds (up to 2, 3 to 5, more).  A word that the ordinal model alone would not trust (rare) carries no marker.

Learning reads a bounded, hash-chosen sample of labelled documents (``max_rows``, default 20,000); only their bucket
numbers reach the driver.  The weights (one float a bucket) are broadcast.

Edge cases: a null or empty text has no features and gets the severity of the bare thresholds; labels of one class
or none give severity 0 for all; repeated labels of a document count once (the highest); very long texts are read whole;
repeated rows are judged one by one; an empty table gives an empty result; other columns never enter a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, prepare

BITS = 20
GRADES = 3
TOXIC_AT = 0.3  # probability of any grade above 0
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: np.ndarray  # float32 per bucket
    thresholds: np.ndarray  # GRADES of them, rising


_BUCKETS: dict[str, tuple[int, ...]] = {}


def _of_word(word: str) -> tuple[int, ...]:
    """Buckets of the word itself and of its beginnings; known words are kept in a table of bounded size."""
    b = _BUCKETS.get(word)
    if b is None:
        if len(_BUCKETS) >= 200_000:
            _BUCKETS.clear()
        names = [word, *(f"{word[:n]}-" for n in (4, 5, 6, 7) if len(word) > n)]
        b = _BUCKETS[word] = tuple(xxhash.xxh64_intdigest(x, 1) & ((1 << BITS) - 1) for x in names)
    return b


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words."""
    return np.fromiter(set(chain.from_iterable(map(_of_word, set(_WORD.findall((text or "").lower()))))), np.int32)


def above(x: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) per row and threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - x[:, None], -30, 30)))


def fit(sets: list[np.ndarray], toxic: np.ndarray, least_docs: int = 5, lift: float = 8.0, least_z: float = 4.0,
        ridge: float = 1e-5, rounds: int = 400) -> Model | None:
    """Ordinal weights and thresholds by Adam on the mean log-likelihood; None if a class is missing."""
    if len(set(toxic.tolist())) < 2:
        return None
    n = [int((toxic == c).sum()) for c in (0, 1)]
    seen = [np.bincount(np.concatenate([s for s, t in zip(sets, toxic) if t == c]), minlength=1 << BITS) for c in (0, 1)]
    odds = [(seen[c] + 0.5) / (n[c] - seen[c] + 0.5) for c in (0, 1)]
    spread = np.sqrt(sum(1 / (seen[c] + 0.5) + 1 / (n[c] - seen[c] + 0.5) for c in (0, 1)))
    z = (np.log(odds[1]) - np.log(odds[0])) / spread
    used = np.nonzero((seen[0] + seen[1] >= least_docs) & (np.abs(z) >= least_z))[0]
    marker = (z >= least_z) & (seen[1] >= least_docs) & (odds[1] >= lift * odds[0])
    count = np.array([marker[s].sum() for s in sets])
    y = np.where(toxic == 1, 1 + (count >= 3) + (count >= 6), 0)  # the learning grades
    index = np.full(1 << BITS, -1)
    index[used] = np.arange(len(used))
    cols = [index[s][index[s] >= 0] for s in sets]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.empty(0, int)
    w, gaps = np.zeros(len(used)), np.array([2.0, 0.0, 0.0])  # thresholds: first, then logs of the steps
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for i in range(1, rounds + 1):
        theta = np.cumsum([gaps[0], np.exp(gaps[1]), np.exp(gaps[2])])
        x = np.bincount(row, w[col], len(y))
        p = above(x, theta)
        full = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], axis=1)
        mass = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = p * (1 - p)
        upper = np.where(y > 0, slope[np.arange(len(y)), np.maximum(y - 1, 0)], 0.0)  # d P(grade >= y) / dx
        lower = np.where(y < GRADES, slope[np.arange(len(y)), np.minimum(y, GRADES - 1)], 0.0)
        gx = -(upper - lower) / mass / len(y)
        gt = np.zeros((len(y), GRADES))
        at = np.nonzero(y > 0)[0]
        gt[at, y[at] - 1] += (upper / mass)[at]
        at = np.nonzero(y < GRADES)[0]
        gt[at, y[at]] -= (lower / mass)[at]
        gt = gt.sum(axis=0) / len(y)
        grad = np.concatenate([np.bincount(col, gx[row], len(w)) + ridge * w,
                               [gt.sum(), gt[1:].sum() * np.exp(gaps[1]), gt[2] * np.exp(gaps[2])]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = 0.05 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
        w, gaps = w - step[:-3], gaps - step[-3:]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum([gaps[0], np.exp(gaps[1]), np.exp(gaps[2])]))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 7) -> Model | None:
    prepare(docs.sparkSession)
    marks = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`toxic`").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    marks = bounded_sample(marks.groupBy("doc_id").agg(F.max("y").alias("y")), max_rows, "doc_id", seed=seed)
    texts = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").cast("string").alias("text"))

    @F.pandas_udf("binary")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda t: buckets(t).tobytes())

    # the sample is bounded by max_rows (16 bytes a row)
    rows = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "y", words("text").alias("x")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    return fit([np.frombuffer(r["x"], np.int32) for r in rows], np.array([r["y"] for r in rows]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the whole input row), ``severity`` (0 to 3) and ``p_toxic`` (probability of any grade above 0)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double")
    def of(text: pd.Series) -> pd.DataFrame:
        model = shared.value
        if model is None:
            return pd.DataFrame({"severity": np.zeros(len(text)), "p_toxic": np.zeros(len(text))})
        x = np.array([model.weights[buckets(t)].sum(dtype=float) for t in text], float)
        p = above(x, model.thresholds)
        return pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0]})

    return (docs.select(F.struct(F.col("*")).alias("row"), of(F.col("`text`").cast("string")).alias("p"))
            .select("row", "p.severity", "p.p_toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select(F.col("row.doc_id").alias("doc_id"), "severity", "p_toxic",
                                       (F.col("p_toxic") >= TOXIC_AT).cast("int").alias("toxic"))
