import base64
import hashlib
import random

import numpy as np

from qlift.llm import embed_dedup as E
from qlift.llm import fingerprints as P


def test_homomorphic():
    a, b, c = "one two three\nfour", "five six\n\nseven", "one two three"
    both = P.fingerprint(f"{a}\n{b}")
    assert (P.insert(P.fingerprint(a), b) == both).all() and (P.delete(both, b) == P.fingerprint(a)).all()
    assert (P.fingerprint("four\none  two three") == P.fingerprint(a)).all()
    assert (P.fingerprint(f"{c}\n{c}") != P.fingerprint(c)).any()
    assert (P.delete(P.fingerprint(a), a) == 0).all()


def test_different_words_of_one_checksum_are_different():
    """Two words with the same CRC-32."""
    a, b = "the price of gnyijstj rose", "the price of etislvlf rose"
    assert (P.fingerprint(a) != P.fingerprint(b)).any() and P.likeness(P.fingerprint(a), P.fingerprint(b)) < 1.0
    assert (P.fingerprint(f"x\n{a}\n{b}") == P.fingerprint(f"{b}\n\n{a}\nx")).all()


def test_exact_lanes_are_the_sum_of_digests():
    """Restated without numpy: paragraphs, their digests, sums modulo 2**64."""
    import collections

    text = "one  two\nthree\n\n one two \n\tlast é"
    lanes = [0] * 8
    for words, times in collections.Counter(" ".join(x.split()) for x in text.split("\n") if x.split()).items():
        d = hashlib.blake2b(words.encode()).digest()
        for k in range(8):
            lanes[k] = (lanes[k] + times * int.from_bytes(d[8 * k : 8 * k + 8], "little")) % 2**64
    assert P.fingerprint(text)[:32].view(np.uint64).tolist() == lanes


def test_likeness_follows_the_share_kept():
    r = random.Random(1)
    lines = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(6)) for _ in range(400)]
    full = P.fingerprint("\n".join(lines))
    near = [P.likeness(full, P.fingerprint("\n".join(lines[:k]))) for k in (400, 300, 200, 100)]
    other = P.likeness(full, P.fingerprint("\n".join("".join(r.choices("xyz", k=9)) + f" {i} q" for i in range(400))))
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] > other and other < 0.25
    assert abs(near[1] - 0.75 ** 0.5) < 0.15


def test_many_equal_pieces(spark):
    """Sign lanes far from zero do not wrap."""
    fps = {k: P.fingerprint("one line\n" * k) for k in (30_000, 40_000, 70_000)}
    assert all(P.likeness(a, b) > 0.999 for a in fps.values() for b in fps.values())
    joined = P.insert(fps[30_000], "one line\n" * 40_000)
    assert (joined == fps[70_000]).all() and (P.delete(joined, "one line\n" * 40_000) == fps[30_000]).all()
    rows = [(i, "one line\n" * k) for i, k in enumerate(fps)] + [(9, "unlike words here\n" * 50)]
    out = sorted(P.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(r.near_edited > 0.99 for r in out[:3]) and all(r.near_next > 0.999 for r in out[:2]) and out[2].near_next < 0.3


def brute_edits(rows):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    out = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        fp, fe, fn = P.fingerprint(t), P.fingerprint(e), P.fingerprint(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.spelled(fp), P.spelled(fe), P.likeness(fp, fe), P.likeness(fp, fn)))
    return sorted(out, key=str)


def test_edits(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i * 7, "".join(r.choices("ab é😀\n", k=r.randint(0, 200)))) for i in range(150)]
    rows += [(None, "no id"), (None, None), (700, ""), (701, None), (1050, "tie"), (1050, "tie"), (9_999, "long words " * 20_000)]
    monkeypatch.setattr(P, "BUCKET_BYTES", 500)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, copy int")
    assert sorted((tuple(x) for x in P.edits(df).collect()), key=str) == brute_edits(rows)
    one = P.edits(df.where("doc_id = 7")).first()
    assert one.near_next == 1.0 and len(base64.b64decode(one.fingerprint)) == 2 * P.WIDTH
    assert P.edits(df.limit(0)).count() == 0


def brute_vectors(rows, tau=0.95):
    ok = [(k, np.array(v, float)) for k, (i, v) in enumerate(rows)
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {k: set() for k, _ in enumerate(rows)}, {k: k for k, _ in enumerate(rows)}
    for a, x in ok:
        for b, y in ok:
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= tau:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        c = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(links[k]), c, i is not None and i == c))
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(8)
    rows = [(int(i), r.standard_normal(24).tolist()) for i in range(100, 400)]
    for i in range(60):  # at cosines around the threshold
        v = np.array(rows[i][1])
        rows.append((1000 + i, (v + r.standard_normal(24) * np.linalg.norm(v) * r.uniform(0.01, 0.06)).tolist()))
    centre = r.standard_normal(24)
    rows += [(2000 + i, (centre + r.standard_normal(24) * 0.1).tolist()) for i in range(260)]
    rows += [(50 + i, [0.5] * 24) for i in range(30)] + [(7, [1.0] * 24), (7, rows[0][1])]
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [None] + [1.0] * 23), (6, [float("inf")] + [1.0] * 23), (None, [0.5] * 24), (8, [0.5] * 23)]
    return rows


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    assert sorted((tuple(x) for x in E.near_duplicates(df).collect()), key=str) == brute_vectors(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_huge_and_tiny_components_link(spark):
    """Vectors whose squares overflow or vanish are compared like any other."""
    r = np.random.default_rng(2)
    base = r.standard_normal(24)
    scales = [1.0, 1e200, 1e-200, 1e300, 1e-310]
    rows = [(i, (base * s).tolist()) for i, s in enumerate(scales)] + [(10 + i, r.standard_normal(24).tolist()) for i in range(40)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (4, 0) for i in range(5)) and all(got[10 + i] == (0, 10 + i) for i in range(40))


def test_calibration():
    assert E.least_count(0.9545) == max(l for l in range(33) if sum(
        __import__("math").comb(32, k) * 0.9545 ** k * 0.0455 ** (32 - k) for k in range(l, 33)) >= E.RECALL)
    plan = E.Plan(50_000, 0.95)
    assert plan.k >= 6 and 1 - (1 - E._same_strip(0.316228) ** plan.k) ** plan.tables >= E.RECALL - 1e-6
