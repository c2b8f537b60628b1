import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from qlift.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Every document's score for every query, by the stated formula alone."""
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(n for _, _, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in queries.items():
        scored = []
        for i, c, n in tfs:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "İ", "x-y", "A_b", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 40])))) for i in range(n)]
    return docs + [(n + i, docs[3][1]) for i in range(40)] + [(5, docs[5][1]), (None, docs[3][1]), (7777, None), (7778, ""), (7779, " .,-"), (7780, "w1 " * 30000)]


ITEMS = [(1, "w1 w2 W50"), (2, "w0"), (3, "w59 É x-y 日本 a"), (4, None), (5, "nowhere"), (6, " ".join(f"w{i}" for i in range(60))), (7, "w3"), (7, "w40 w3"), (None, "w7 w8"), (8, "...")]


@pytest.mark.parametrize("block,stride,query_bytes,k", [(1 << 20, 32, 1 << 20, 10), (60, 1, 20, 10), (300, 2, 1 << 20, 3)])
def test_against_brute_force(spark, monkeypatch, block, stride, query_bytes, k):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "STRIDE", stride)
    docs = corpus(300)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = R.search(df, items, k, query_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, ITEMS, k)


def test_stops_before_the_ends_of_the_lists():
    """Blocks in one process: fewer accesses than the lists hold, equal results."""
    rng = np.random.default_rng(3)
    n, vocab = 4000, 6
    sizes = np.full(n, vocab)
    tf = np.maximum(1, (rng.pareto(1.0, n * vocab) * 2).astype(np.int64))
    terms_ = np.tile(np.arange(vocab), n)
    length = tf.reshape(n, vocab).sum(axis=1)
    total = int(length.sum())
    block = R.Block(np.arange(n), np.zeros(n, bool), length, sizes, terms_, tf, n, total, vocab)
    best = R.Best(10)
    q, w = np.arange(vocab), np.array([900, 700, 500, 300, 200, 100])
    accesses = block.search(q, w, best)
    scores = (w[None, :] * R.impacts(tf, np.repeat(length, vocab), n, total).reshape(n, vocab)).sum(axis=1)
    want = np.lexsort((np.arange(n), -scores))[:10]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()
    assert accesses < 0.6 * n * vocab  # impacts here are independent of one another, the hardest case
    worse = R.Block(np.arange(n) + n, np.zeros(n, bool), length * 1000, sizes, terms_, np.ones_like(tf), n, total, vocab)
    assert worse.search(q, w, best) == 0  # the k-th score of the first block rules the whole second one out


def test_terms():
    assert R.terms_of("Ab-cD É x\x00y_z 1a") == [t.encode() for t in terms("Ab-cD É x\x00y_z 1a")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.search(docs.limit(0), items).collect() == []
    assert R.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in R.search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")], 10)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = R.op11_ranked_search(spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(R.OP11_SQL).fetchall()
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
