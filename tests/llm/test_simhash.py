import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from qlift.llm import simhash as S


def slow_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return v - (1 << 64) if v >> 63 else v


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB É\t\n\x0b\x1c\xa0z"), max_size=40))
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_golay_code_is_perfect():
    x = np.random.default_rng(3).integers(0, 1 << 23, 4000)
    index = S.golay_index(x)
    assert len(set(S.golay_index(np.arange(1 << 23)[:: 2048]).tolist())) > 1
    words = {int(i): None for i in np.unique(index)}
    high, _ = S._syndrome_tables()
    code = (index << 11) | (high[index] & 0x7FF)
    assert (np.bitwise_count(code ^ x) <= 3).all() and words


def components(fps, bits=3):
    label = list(range(len(fps)))
    u = np.array(fps, np.int64).view(np.uint64)
    todo, seen = list(range(len(fps))), [False] * len(fps)
    for i in todo:
        if seen[i]:
            continue
        stack, members = [i], []
        seen[i] = True
        while stack:
            k = stack.pop()
            members.append(k)
            for j in np.nonzero(np.bitwise_count(u ^ u[k]) <= bits)[0].tolist():
                if not seen[j]:
                    seen[j] = True
                    stack.append(j)
        for m in members:
            label[m] = min(members)
    return label


def near_rows():
    """Fingerprints at 1 to 5 bits of each other, a chain, a large ball and unrelated ones."""
    r = random.Random(9)
    rows = [r.getrandbits(64) for _ in range(300)]
    for base in rows[:60]:
        for k in (1, 2, 3, 4, 5):
            rows.append(base ^ sum(1 << b for b in r.sample(range(64), k)))
    centre = r.getrandbits(64)
    rows += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(700)]
    chain = r.getrandbits(64)
    for _ in range(40):
        chain ^= sum(1 << b for b in r.sample(range(64), 3))
        rows.append(chain)
    return sorted({x - (1 << 64) if x >> 63 else x for x in rows})


def check_links(spark):
    fps = near_rows()
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    nodes = {r.node: r.component for r in S.connected(S.near_links(df)).collect()}
    want = components(fps)
    first = {}
    for x, c in zip(fps, want):
        first.setdefault(c, x)
    assert {x: nodes.get(x, x) for x in fps} == {x: first[c] for x, c in zip(fps, want)}


def test_links_against_brute_force(spark):
    check_links(spark)


def test_links_with_hot_keys_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "KEY_ROWS", 40)
    check_links(spark)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "a b c d"), (2, "A b\tc  D"), (2, "a b c d"), (9, None), (7, ""), (8, " \n"), (11, "x y"), (None, "x y"), (None, "only here"), (None, "only here"), (1, long), (30, long)]
    df = spark.createDataFrame([(i, t, 0, "e") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = {(r.doc_id, r.fp): r.component_id for r in S.simhash_groups(df).collect()}
    assert got[5, S.fingerprint("a b c d")] == got[2, S.fingerprint("a b c d")] == 2
    assert got[9, 0] == got[7, 0] == got[8, 0] == 7
    assert got[None, S.fingerprint("x y")] == 11 and got[None, S.fingerprint("only here")] is None and got[30, S.fingerprint(long)] == 1
    kept = S.dedupe(df)
    assert kept.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 1, 2, 7, 11]
    assert S.dedupe(df.limit(0)).count() == 0


def test_one_id_on_two_texts(spark):
    """Texts are judged by their own group, not by that of another text with their id."""
    r = random.Random(11)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(5, a, "x"), (5, b, "x"), (3, a, "x"), (7, c, "x"), (7, c, "y"), (9, c, "x"), (8, text(), "x"), (8, text(), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(o.doc_id, o.text) for o in S.dedupe(df).collect()]
    assert sorted(got) == sorted([(3, a), (5, b), (7, c), rows[6][:2], rows[7][:2]])
