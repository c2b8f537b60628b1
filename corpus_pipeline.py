"""The corpus pipeline: language, near-duplicates, personal data, source mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qlift.llm import bpe, langid, mixing, pii, simhash
from qlift.session import Stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: no letter, or nothing that a learned language knows.

    Null and empty texts go (no letter); texts under 20 characters with a letter stay; repeated rows are judged one by one, alike; the
    languages are learned from the rows with a ``lang`` (null ids count as any other), and if no row has one every text goes;
    an empty table stays empty; extra columns are kept."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group.

    Null and empty texts share the fingerprint zero, so one of them stays; of several rows with the kept id one stays, by the digest of
    its text, then a hash of all columns; of a group in which no row has an id one row stays by the same order; an empty
    table stays empty; extra columns are kept."""
    return simhash.dedupe(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind.

    A null text stays null, an empty one empty; ``n_chars`` follows the text where it changed; repeated rows are cleaned one by one;
    where spans overlap the first names the cut; an empty table stays empty; extra columns are kept."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources get their target shares.

    Null sources are one source of their own; null and empty texts weigh nothing but are repeated like the rest of their source (a source
    without words goes); rows of one id flip one coin, rows without id another; an empty table stays empty; extra
    columns are kept."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids`` of every document of the mix.

    A null or empty text has no ids; repeated rows are encoded one by one; an empty table gives an empty result; other columns
    end here."""
    return bpe.encode(docs.select("doc_id", "source", "lang", "text"), carried=["doc_id", "source", "lang"]).selectExpr(
        "doc_id", "source", "lang", "size(ids) as n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Fingerprints, trained filters and tokenization have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What lies between them goes to the shared checkpoint folder; a table is deleted as soon as the next
    stage has read it, but for the last one, on which the result rests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Stored(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.forget(1)
    return STAGES[-1][1](spark, docs, sf_dir)
