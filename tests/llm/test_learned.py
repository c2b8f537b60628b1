"""Language ID, quality and toxicity: held-out accuracy and edge rows."""

import math
import random
import zlib

import numpy as np
import pytest

from qlift.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
EDGE = [(1_000_001, None), (1_000_002, ""), (1_000_003, "1234 !! ²½ 😀"), (1_000_003, "1234 !! ²½ 😀"), (None, "the of and"), (1_000_004, "x"), (1_000_005, "word " * 40_000)]


def with_edges(spark, columns):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = spark.createDataFrame([(i, t, None, "s") for i, t in EDGE], "doc_id long, text string, lang string, source string")
    return docs.unionByName(extra).selectExpr("*", *[f"'c' as {c}" for c in columns])


def test_language(spark):
    docs = with_edges(spark, ["score", "lang_pred", "row"])
    got = langid.predict(docs, langid.learn(docs)).selectExpr("row.doc_id", "row.lang", "row.text", "lang_pred", "score").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.lang and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert langid.keep_known(docs).columns == docs.columns and langid.keep_known(docs).where("text is null or text = ''").count() == 0


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, lang string")
    r = langid.predict(docs, langid.learn(docs)).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.predict(docs.limit(0), langid.learn(docs.limit(0))).count() == 0


def test_more_than_64_languages(spark):
    """Every language has a bit, the rarest too."""
    r = random.Random(9)
    words = {f"l{k:03}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for k in range(130)}
    rows = [(k * 1000 + i, " ".join(r.choices(words[l], k=40)), l) for k, l in enumerate(words) for i in range(8 if k < 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert sorted(model.languages) == sorted(words) and model.table.shape == (1 << langid.BITS, 3)
    names, scores = langid.judge([t for _, t, _ in rows], model)
    assert names == [l for *_, l in rows] and (scores > 0.5).all()
    few = langid.learn(docs.where("lang < 'l005'"))
    assert few.table.shape == (1 << langid.BITS,) and few.table.dtype == np.uint8


def test_unseen_script_goes_out_at_any_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    def unseen(k):  # noqa: E306
        return " ".join("".join(chr(r.randrange(0x10D0, 0x10F1)) for _ in range(r.randint(2, 9))) for _ in range(k))
    more = [(2_000_000 + i, unseen(k), None) for i, k in enumerate([8, 30, 300, 3000, 20_000] * 12)]
    odd = spark.createDataFrame(more + [(3_000_000, "\n".join([unseen(9)] * 500), None)], "doc_id long, text string, lang string")
    n = docs.where("doc_id is not null and length(text) >= 20").count()
    kept = langid.keep_known(docs.unionByName(odd))
    assert kept.where("doc_id >= 2000000").count() == 0 and kept.where("length(text) >= 20").count() == n


def test_bloom_counts_against_sets():
    """The corrected popcounts decide as exact n-gram sets do."""
    r = random.Random(2)
    words = {l: ["".join(r.choice(a) for _ in range(5)) for _ in range(60)] for l, a in (("x", "abcde"), ("y", "defgh"))}
    grams = {l: set(np.concatenate([langid._codes(langid._letters(w)) for w in ws]).tolist()) for l, ws in words.items()}
    table = np.zeros(1 << langid.BITS, np.uint8)
    for bit, l in enumerate(words):
        for p in langid._positions(np.array(sorted(grams[l]), np.uint64)):
            table[p] |= 1 << bit
    model = langid.Model(list(words), table, np.array([0.0, 0.0]))
    texts = [" ".join(r.choice(words[l]) for _ in range(8)) for l in words for _ in range(50)]
    names, _ = langid.judge(texts, model)
    for t, n in zip(texts, names):
        hits = {l: sum(c in g for c in langid._codes(langid._letters(t)).tolist()) for l, g in grams.items()}
        assert hits[n] == max(hits.values())


def test_quality(spark):
    docs, labels = with_edges(spark, ["score", "quality"]), spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None), (0, 1, 0)], labels.schema))
    got = {(r.doc_id, r.text): r.score for r in quality.predict(docs, quality.learn(docs, labels)).selectExpr("row.doc_id", "row.text", "score").collect()}
    mark = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = [(s, mark[i]) for (i, _), s in got.items() if i in mark and zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([(s >= quality.CUT) == y for s, y in held]) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[1_000_001, None] == got[1_000_002, ""]


def test_quality_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.predict(docs, quality.learn(docs, labels)).collect()] == [0.5, 0.5]
    assert quality.predict(docs.limit(0), None).count() == 0


def test_toxicity_fit_orders_severity():
    r = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    bad = ["grukak", "grukel", "blorp", "znarf", "qwist", "hoxur", "vimble", "drask"]
    def doc(k):  # noqa: E306
        return " ".join(r.sample([*r.choices(plain, k=40), *r.choices(bad, k=k)], 40 + k))
    texts = [(doc(0), 0) for _ in range(900)] + [(doc(r.choice([1, 2, 4, 9])), 1) for _ in range(150)]
    r.shuffle(texts)
    model = toxicity.fit([toxicity.buckets(t) for t, _ in texts[:800]], np.array([y for _, y in texts[:800]]))
    assert (np.diff(model.thresholds) > 0).all()
    def severity(t):  # noqa: E306
        return toxicity.above(np.array([model.weights[toxicity.buckets(t)].sum(dtype=float)]), model.thresholds)[0]
    caught = [(severity(t)[0] >= toxicity.TOXIC_AT) == y for t, y in texts[800:]]
    assert np.mean(caught) > 0.97
    assert np.mean([severity(doc(9)).sum() for _ in range(30)]) > np.mean([severity(doc(1)).sum() for _ in range(30)]) + 0.5
    assert severity("").sum() < 0.1
    assert toxicity.fit([np.array([1], np.int32)], np.array([0])) is None


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity_edges(spark, labelled):
    docs, labels = with_edges(spark, ["severity", "toxic"]), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels if labelled else labels.limit(0))
    got = toxicity.predict(docs, model).selectExpr("row.doc_id", "severity", "p_toxic").collect()
    assert len(got) == docs.count() and all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in got)
    assert labelled or all(r.severity == 0 for r in got)
    assert toxicity.predict(docs.limit(0), model).count() == 0


def _ordinal_loss(sets, y, weights, theta, ridge=1e-5):
    """The cumulative-link likelihood, said plainly, row by row."""
    loss = 0.0
    for s, grade in zip(sets, y):
        x = sum(float(weights[b]) for b in s)
        above = [1.0, *(1 / (1 + math.exp(t - x)) for t in theta), 0.0]
        loss -= math.log(max(above[grade] - above[grade + 1], 1e-9))
    return loss / len(y) + ridge / 2 * sum(float(w) ** 2 for w in weights[np.nonzero(weights)[0]])


def test_toxicity_fit_against_plain_steps():
    """Forty Adam steps with gradients of the plain likelihood by differences end at the same weights and thresholds."""
    rng = np.random.default_rng(4)
    toxic = rng.integers(0, 2, 150)
    sets = [np.unique(np.concatenate([rng.integers(0, 12, 4), rng.integers(20, 26, rng.integers(1, 7)) if t else rng.integers(40, 46, 4)])).astype(np.int32) for t in toxic]
    model = toxicity.fit(sets, toxic, least_z=2.0, rounds=40)
    used = np.nonzero(model.weights)[0]
    marker = set(range(20, 26))
    assert marker <= set(used.tolist())
    y = [1 + (len(marker & set(s.tolist())) >= 3) + (len(marker & set(s.tolist())) >= 6) if t else 0 for s, t in zip(sets, toxic)]

    def loss(v):
        weights = np.zeros(64)
        weights[used] = v[:-3]
        return _ordinal_loss(sets, y, weights, [v[-3], v[-3] + math.exp(v[-2]), v[-3] + math.exp(v[-2]) + math.exp(v[-1])])

    v = np.concatenate([np.zeros(len(used)), [2.0, 0.0, 0.0]])
    first, second = np.zeros(len(v)), np.zeros(len(v))
    for i in range(1, 41):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        v = v - 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    assert np.abs(model.weights[used] - v[:-3]).max() < 2e-3
    assert np.abs(model.thresholds - np.cumsum([v[-3], math.exp(v[-2]), math.exp(v[-1])])).max() < 2e-3


def test_quality_fit_against_plain_steps():
    """The weights solve the Bradley-Terry likelihood of the same pairs (plain gradient, pair by pair); the cut has the fewest errors of its quantiles."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120)
    x = rng.standard_normal((120, 4)) + np.outer(y, [1.0, -0.5, 0.0, 0.2])
    m = quality.fit(x, y, pairs_per_row=5, seed=3)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    again = np.random.default_rng(3)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    a, b = again.choice(good, 600), again.choice(bad, 600)
    gradient = m.weights.copy()
    for i, j in zip(a, b):
        d = z[i] - z[j]
        gradient -= d / (1 + math.exp(float(d @ m.weights)))
    assert np.abs(gradient).max() < 1e-4
    s = z @ m.weights
    errors = {c: sum(v < c for v in s[y == 1]) + sum(v >= c for v in s[y == 0]) for c in np.quantile(s, np.linspace(0.002, 0.998, 500))}
    assert sum(v < m.cut for v in s[y == 1]) + sum(v >= m.cut for v in s[y == 0]) <= min(errors.values()) + 1


def test_language_holds_a_part_of_a_batch():
    """The verdicts of a batch are those of its texts one by one; beside the batch only parts of it are held."""
    import tracemalloc

    import pyarrow as pa

    words = np.random.default_rng(3).choice(["the", "und", "les", "fünf", "ночь", "12", "of"], (2000, 1000))
    texts = [None, "", "12 !", "x", *[" ".join(w) for w in words], "the " * 100_000]
    model = langid.Model(["a", "b", "c"], np.random.default_rng(4).integers(0, 8, 1 << langid.BITS).astype(np.uint8), np.full(3, 0.25))
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    got = langid._verdicts(batch, model, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 8e6 and most < 1.5 * len(texts[-1]) * 40  # the longest text is read whole, in arrays of 8 bytes a letter
    names, scores = langid.judge(texts, model)
    assert got.field("lang_pred").to_pylist() == names and got.field("score").to_pylist() == scores.tolist()
    assert got.field("evident").to_pylist() == [bool(langid._evident([langid._letters(t)], model)[0]) for t in texts]
    assert len(langid._verdicts(batch.slice(0, 0), model, False)) == 0
