"""Quality classifier by Bradley-Terry pairwise ranking.

Each preference pair sets a document of label 1 against one of label 0.  The model is a score ``w . x`` over the text's
form (repetition, case, signs, word lengths, lines), learned by logistic loss on the feature differences of the pairs
(Newton steps with a ridge).  The cut is a quantile of the learning rows' scores, the one that makes the fewest
errors; the reported score is ``1 / (1 + exp(-(s - cut)))`` shifted so that the cut reads as ``CUT`` (0.3).

Learning reads a bounded, hash-chosen sample of labelled documents (``max_rows``, default 20,000) and ``pairs_per_row``
partners for each; only their feature vectors reach the driver.

Edge cases: a null or empty text has the features of an empty text and gets a score; labels of one class only, or none, give
every document the score 0.5; repeated labels of a document count once (the highest); very long texts are read whole;
repeated rows are scored one by one; an empty table gives an empty result; other columns never enter a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby, islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, prepare
from .langid import remainder

CUT = 0.3
_SIGNS = re.compile(r"[^\w\s.,;:'\"()-]")
_END = re.compile(r"[.!?](?:\s|$)")
FEATURES = 19


def features(text: str | None) -> list[float]:
    """The form of a text as numbers of about unit size; independent of the words themselves."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    per = 1.0 / n
    twins = sum(map(eq, words, islice(words, 1, None))) * per
    longest = max(sum(1 for _ in g) for _, g in groupby(words))
    upper = sum(map(str.isupper, words)) * per
    signs = len(_SIGNS.findall(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, words)) * per
    ends = len(_END.findall(text)) * per
    return [
        np.sqrt(twins), twins, np.log1p(longest), np.sqrt(upper), upper,
        np.sqrt(signs * per), min(signs * per, 3.0), np.sqrt(text.count("!") * per), np.sqrt(text.count("|") * per),
        len(set(words)) * per, len(set(words)) / n ** 0.7, np.log1p(n) / 3, (chars - n) * per / 5,
        1 - len(set(lines)) / max(len(lines), 1), letters, np.sqrt(ends), np.sqrt(sum(map(str.isdigit, text)) / chars), per, 0.0,
    ]


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(s + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs_per_row: int = 10, ridge: float = 1.0, seed: int = 7) -> Model | None:
    """Bradley-Terry weights from rows of features and labels 0/1; None if a class is missing."""
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = pairs_per_row * len(y)
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) + ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cuts = np.unique(np.quantile(s, np.linspace(0.002, 0.998, 500)))
    good_s, bad_s = np.sort(s[good]), np.sort(s[bad])
    lost = np.searchsorted(good_s, cuts) + len(bad) - np.searchsorted(bad_s, cuts)
    best = cuts[lost == lost.min()]
    return Model(w, mean, scale, float(np.median(best)))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 7) -> Model | None:
    """Fit on labelled documents; rows whose id's CRC-32 leaves 0 modulo 5 are held out."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`quality`").cast("int").alias("y"))
    marks = marks.where("y in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), 5) != 0)
    marks = bounded_sample(marks.groupBy("doc_id").agg(F.max("y").alias("y")), max_rows, "doc_id", seed=seed)
    texts = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").cast("string").alias("text"))

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return text.map(lambda t: np.array(features(t), np.float32).tobytes())

    # the sample is bounded by max_rows (16 bytes a row)
    rows = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "y", vector("text").alias("x")).orderBy("doc_id", "x").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), FEATURES).astype(float)
    return fit(x, np.array([r["y"] for r in rows]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the whole input row) and ``score``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(text), 0.5))
        return pd.Series(shared.value.scores(np.array([features(t) for t in text], float).reshape(len(text), FEATURES)))

    return docs.select(F.struct(F.col("*")).alias("row"), of(F.col("`text`").cast("string")).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return predict(docs, model).select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score",
                                       (F.col("score") >= CUT).cast("int").alias("predicted"))
