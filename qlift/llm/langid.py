"""Language identification by bit-sliced Bloom filters of n-grams.

One table of ``1 << BITS`` positions holds a bitmask of languages at each position: bit ``l`` of all positions is the
Bloom filter of language ``l``.  The AND of an n-gram's positions is the set of all languages that contain it.  A text
is decided by the popcount per language over its n-grams, corrected for the filter's false positives
(``(hits - n * rate) / (1 - rate)``, the rate from the fill of that language's bits).

Learning: n-grams (4 bytes of the lower-cased UTF-8 text, everything but letters read as one blank) of a bounded sample of
labelled documents, ``per_language`` each (parameter, default 2,000, hash-chosen).  An n-gram is put into a language's
filter if it occurs at least 3 times there and at least a tenth as often as in the language that uses it most.  All
languages are learned; a position has a mask of 64 bits for every 64 of them (8 MB of table each), whatever the corpus.

Edge cases: a null text or one without any letter is ``und`` with score 0; letters without a known n-gram give the most
frequent language with score 0; nothing to learn from gives ``und``; very long texts are read whole, in one pass;
repeated rows are judged one by one; an empty table gives an empty result; other columns never enter a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, prepare, text_column

GRAM = 4
BITS = 20
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = 64  # languages in one mask
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
CHUNK = 1 << 17  # bytes of text whose n-grams are looked up together; also of the texts of a batch held as Python's
CHANCE = 1e-9  # that a text of which no language knows anything passes as known by false positives


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # masks of the narrowest type that holds them; over 64 languages, a column of uint64 per 64
    rates: np.ndarray  # per language: share of foreign n-grams that pass its filter


def remainder(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string")) % m


def _letters(text: str | None) -> bytes:
    """The text's words in lower case between single blanks; empty without any letter."""
    if not text:
        return b""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(c.isalpha() for c in set(clean)):
        return b""
    return f" {clean} ".encode("utf-8", "replace")


def _codes(data: bytes) -> np.ndarray:
    """The 4-byte window that begins at each byte."""
    x = np.frombuffer(data, np.uint8)
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = x[:n].astype(np.uint32)
    for i in range(1, GRAM):
        out |= x[i:n + i].astype(np.uint32) << np.uint32(8 * i)
    return out.astype(np.uint64)


def _positions(codes: np.ndarray) -> list[np.ndarray]:
    return [((codes * np.uint64(c)) >> np.uint64(64 - BITS)).astype(np.int64) for c in HASHES]


def _gram_counts(batches):
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            codes, n = np.unique(np.concatenate([_codes(_letters(t)) for t in texts]), return_counts=True)
            if len(codes):
                yield pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": n.astype(np.int64)})


def learn(docs: DataFrame, per_language: int = 2000, seed: int = 7) -> Model:
    """Fit on ``doc_id, text, lang`` rows; rows whose id's CRC-32 leaves 2 modulo 4 are held out, as are null labels."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").cast("string").alias("text"), F.col("`lang`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~(F.coalesce(remainder(F.col("doc_id"), 4), F.lit(0)) == 2))
    freq = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    names = [r["lang"] for r in freq]
    if not names:
        return Model([], np.zeros(1 << BITS, np.uint8), np.zeros(0))
    known = docs.sparkSession.createDataFrame([(n, i, min(1.0, per_language / r["count"])) for i, (n, r) in enumerate(zip(names, freq))], "lang string, l int, share double")
    words = -(-len(names) // WORD)
    coin = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(known), "lang").where(coin < F.col("share"))
    grams = sample.select("lang", "text").mapInPandas(_gram_counts, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 3")
    sizes = {r["lang"]: r["s"] for r in grams.groupBy("lang").agg(F.sum("n").alias("s")).collect()}
    if not sizes:
        return Model(names, np.zeros(1 << BITS, np.uint8), np.zeros(len(names)))
    size = docs.sparkSession.createDataFrame([(n, i, float(sizes[n])) for i, n in enumerate(names) if n in sizes], "lang string, l int, size double")
    by_gram = grams.join(F.broadcast(size), "lang").groupBy("gram").agg(F.collect_list(F.struct("l", (F.col("n") / F.col("size")).alias("r"))).alias("u"))
    used = by_gram.select("gram", F.filter("u", lambda x: x["r"] >= 0.1 * F.array_max(F.transform("u", lambda y: y["r"]))).alias("u"))
    masks = used.select("gram", "u", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word")).select("gram", "word", F.aggregate(
        F.filter("u", lambda x: F.floor(x["l"] / WORD) == F.col("word")), F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["l"] % WORD))).alias("mask")).where("mask != 0")

    def place(batches):
        for b in batches:
            for p in _positions(b["gram"].to_numpy().astype(np.uint64)):
                yield pd.DataFrame({"position": p, "word": b["word"], "mask": b["mask"]})

    filled = masks.mapInPandas(place, "position long, word int, mask long").groupBy("position", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(len(names), WORD))
    table = np.zeros((1 << BITS, words), kind)
    table[filled["position"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(kind)
    fill = np.array([np.count_nonzero(table[:, i // WORD] >> kind(i % WORD) & kind(1)) for i in range(len(names))]) / (1 << BITS)
    return Model(names, table[:, 0].copy() if words == 1 else table, fill ** len(HASHES))


def _evident(data: list[bytes], model: Model) -> np.ndarray:
    """Whether some language has more of a text's different n-grams than false positives explain: the bound
    ``exp(-n * KL(hits / n, rate))`` of that chance, times the number of languages, is below ``CHANCE``."""
    out = np.zeros(len(data), bool)
    columns = model.table.reshape(len(model.table), -1).T
    kind, need = model.table.dtype.type, np.log(max(len(model.languages), 1) / CHANCE)
    for d, text in enumerate(data):
        codes = np.unique(_codes(text))
        if not len(codes):
            continue
        first, second = _positions(codes)
        masks = [column[first] & column[second] for column in columns]
        for lang, rate in enumerate(model.rates):
            share = np.count_nonzero(masks[lang // WORD] >> kind(lang % WORD) & kind(1)) / len(codes)
            if share > rate:
                rest = (1 - share) * np.log((1 - share) / (1 - rate)) if share < 1 else 0.0
                if rate == 0 or len(codes) * (share * np.log(share / rate) + rest) > need:
                    out[d] = True
                    break
    return out


def judge(texts, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    return _judge([_letters(t) for t in texts], model)


def _judge(data: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    n_lang = len(model.languages)
    names, scores = [], np.zeros(len(data))
    if not n_lang:
        return [UNKNOWN] * len(data), scores
    kind = model.table.dtype.type
    columns = model.table.reshape(len(model.table), -1).T
    for a, b in chunks([len(d) + n_lang for d in data], CHUNK):
        length = np.array([len(d) for d in data[a:b]])
        codes = _codes(b"".join(data[a:b]))
        hits = np.zeros((b - a, n_lang))
        grams = np.maximum(length - GRAM + 1, 0)
        has = np.nonzero(grams)[0]
        if len(has):
            first, second = _positions(codes)
            start = (np.cumsum(length) - length)[has]
            for word, column in enumerate(columns):
                mask = column[first] & column[second]
                for s, n in zip(start, grams[has]):  # windows over a border belong to no text
                    mask[s + n:s + n + GRAM - 1] = 0
                for lang in range(word * WORD, min((word + 1) * WORD, n_lang)):
                    hits[has, lang] = np.add.reduceat((mask >> kind(lang % WORD)) & kind(1), start, dtype=np.int64)
        true = np.maximum((hits - grams[:, None] * model.rates) / (1 - model.rates), 0)
        best = true.argmax(axis=1)
        ranked = np.sort(true, axis=1)
        top, second = ranked[:, -1], ranked[:, -2] if n_lang > 1 else np.zeros(b - a)
        scores[a:b] = np.where(top > 0, top / np.maximum(top + second, 1e-9), 0)
        names += [model.languages[i] if n else UNKNOWN for i, n in zip(best, length)]
    return names, scores


def _verdicts(texts: pa.Array, model: Model, evident: bool) -> pa.Array:
    """``lang_pred, score`` and, if asked for, ``evident`` of a batch; its texts pass in parts of about ``CHUNK`` bytes, each cleaned once."""
    names, scores, known = [], [], []
    for i, j in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK):
        data = [_letters(t) for t in texts.slice(i, j - i).to_pylist()]
        n, s = _judge(data, model)
        names += n
        scores.append(s)
        if evident:
            known.append(_evident(data, model))
    out = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate([np.zeros(0), *scores]))}
    if evident:
        out["evident"] = pa.array(np.concatenate([np.zeros(0, bool), *known]))
    return pa.StructArray.from_arrays(list(out.values()), list(out))


def predict(docs: DataFrame, model: Model, evident: bool = False) -> DataFrame:
    """``row`` (the whole input row), ``lang_pred``, ``score``; if asked for ``evident``: whether some language knows more of
    the text's n-grams than chance explains."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double" + ", evident boolean" * evident)
    def of(text: pa.Array) -> pa.Array:
        return _verdicts(text, shared.value, evident)

    return docs.select(F.struct(F.col("*")).alias("row"), of(F.col("`text`").cast("string")).alias("p")).select("row", "p.*")


def keep_known(docs: DataFrame, short: int = 20) -> DataFrame:
    """The rows of ``docs`` with a known language (columns unchanged).  Rejected are texts without letters and texts of
    ``short`` characters or more of which no language knows more n-grams than chance explains; shorter ones can't be told
    apart and stay."""
    known = F.col("evident") | (F.length("row.text") < short)
    return predict(docs, learn(docs), evident=True).where((F.col("lang_pred") != UNKNOWN) & known).select("row.*")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("row.doc_id"), 4) == 2, F.lit(False))
    return predict(docs, learn(docs)).select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
