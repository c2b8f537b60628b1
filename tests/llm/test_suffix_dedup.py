import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from qlift.llm import suffix_dedup as S


def brute(rows):
    """Per row (id, text): bytes, removed, spans, digest."""
    data = [(S.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(first.get(s, S.NO_ID), i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["the", "on", "er", "é", "in", "st", "ü"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(20) for _ in range(4)] + ["ab" * 60, "x" * 200, "0123456789" * 5, "0123456789" * 4 + "012345678"]
    rows = [(None, shared[0]), (None, shared[0]), (7, None), (8, ""), (9, "short")]
    for i in range(20, 60):
        rows.append((i, text(r.randint(1, 40)) + r.choice(shared) + text(r.randint(0, 30)) + r.choice(shared) * r.randint(1, 3)))
    rows += [(61, rows[10][1]), (61, rows[10][1]), (3, rows[12][1]), (62, "x" * 5000 + shared[1] + "y" * 49), (63, "y" * 49), (64, "y" * 50), (65, "z" + "y" * 51)]
    return rows


def test_minimizer_runs_cover_each_string_once():
    texts = [t.encode() for _, t in corpus() if t]
    of, start, size, least = S.pieces(texts)
    seen = {}
    for n, s, k, h in zip(of, start, size, least):
        for p in range(s, s + k):
            assert seen.setdefault((n, p), h) == h and (n, p)
    assert len(seen) == size.sum() == sum(max(0, len(t) - 49) for t in texts)
    by_text = {}
    for (n, p), h in seen.items():
        assert by_text.setdefault(texts[n][p:p + 50], h) == h


def test_deep_shallow_classes():
    r = np.random.default_rng(1)
    data = b"".join([b"ab" * 40, b"abababac" * 10, bytes(r.integers(97, 99, 400, dtype=np.uint8)), b"q" * 300])
    starts = np.arange(len(data) - 49)
    cls = S.suffix_classes(data, starts)
    names = {}
    for s, c in zip(starts, cls):
        assert names.setdefault(c, data[s:s + 50]) == data[s:s + 50]
    assert len(names) == len({data[s:s + 50] for s in starts})


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(S, "HOT_BLOCKS", 0)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    want = sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute(rows)))
    out = S.remove_repeats(df).collect()
    got = sorted((-1 if o.doc_id is None else o.doc_id, o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) for o in out)
    assert got == want
    assert all(hashlib.sha256(o.kept).hexdigest() == o.kept_sha256 for o in out)


@pytest.mark.parametrize("blocks", [1, 2])
def test_repeats_within_a_block(spark, monkeypatch, blocks):
    """A passage in different surroundings goes to its last byte, also if no other block holds it."""
    monkeypatch.setattr(S, "count_blocks", lambda *_: blocks)
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abcdefghij ", k=n))
    rows = corpus()
    for i in range(100, 160, 2):
        passage = text(r.choice([50, 51, 60, 75, 200]))
        rows += [(i, text(90) + passage + text(90)), (i + 1, text(70) + passage + text(70))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute(rows)))
    got = S.remove_repeats(df, with_text=False).collect()
    assert sorted((-1 if o.doc_id is None else o.doc_id, o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) for o in got) == want


def test_a_phrase_in_many_surroundings_is_spread(spark, monkeypatch):
    """Few blocks, many different pieces with one minimizer: no bucket takes them all."""
    judge, phrase = S._judge_bucket, b"the one phrase that all of these hold"

    def guarded(rows):
        assert sum(phrase in p for p in rows["piece"].dropna()) < 300
        return judge(rows)

    monkeypatch.setattr(S, "HOT_PIECES", 100, raising=False)
    monkeypatch.setattr(S, "_judge_bucket", guarded)
    monkeypatch.setattr(S, "count_blocks", lambda *_: 3)
    r = random.Random(7)
    text = lambda: "".join(r.choices("abcdefghijklmnop", k=60))
    rows = [(i, text() + phrase.decode() + text()) for i in range(600)] + [(i, "left side of it " + phrase.decode() + text()) for i in range(600, 620)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted((o.doc_id, o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) for o in got) == sorted((i, *b) for (i, _), b in zip(rows, brute(rows)))
    # equal pieces count once, so a passage in many texts of a block is not hot by that
    same = pd.DataFrame({"digest": [bytes([i]) for i in range(9)], "text": [f"{i}" + "\n" * 49 + "0123456789" * 12 for i in range(9)]})
    assert S._minimizers((0,), same)["pieces"].max() < 9


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), with_text=False).count() == 0
