import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from qlift.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(sequences):
    """The trie of ``{conv_id: [(role, text), ...]}``, node by node."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def lists(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in out.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def same(got, want):
    """Equal as multisets; shows the first differences only."""
    got, want = (sorted(map(str, map(tuple, x))) for x in (got, want))
    if got != want:
        raise AssertionError(([x for x in got if x not in want][:3], [x for x in want if x not in got][:3], len(got), len(want)))


def check(spark, rows, by_family=False):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = T.trie(T.rebuilt(df)) if by_family else T.prefix_trie(df)
    own = lists(rows)
    same(got.collect(), brute(rebuild(own) if by_family else own))


def random_rows(n, seed, alphabet=3, longest=9):
    rng = random.Random(seed)
    return [(c, i, rng.choice(["user", "assistant"]), "ab"[: rng.randrange(alphabet)] * (i % 3)) for c in range(n) for i in range(rng.randrange(longest + 1))]


HARD = [(1, 0, "user", "é"), (1, 1, None, None), (2, 0, "user", "é"), (2, 1, "", ""), (3, None, "user", "é"), (3, 5, "", None), (3, 5, "", None), (3, 5, "a", "b"),
        (4, 2, "us", "eré"), (5, 0, "user", "é"), (7, 1, "ab", "c"), (8, 1, "a", "bc"), (None, 0, "user", "é"), (9, -4, "x", "y"), (9, None, "x", "z"), (10**12, 0, "user", "é")]


def test_all_shapes(spark, monkeypatch):
    """Hard rows, many branches, a chain of prefixes, a comb, copies of one conversation (its ids in many pieces)."""
    monkeypatch.setattr(T, "PIECE", 7)
    chain = [(1000 + c, i, "u", f"t{i}") for c in range(40) for i in range(c + 1)]
    comb = [(2000 + c, i, "u", f"t{i}" if i < c else "off") for c in range(40) for i in range(c + 1)]
    copies = [(3000 + c, i, "u", f"same {i}") for c in range(600) for i in range(3)] + [(5000 + c, i, "u", f"same {i}" if i < 2 else str(c)) for c in range(50) for i in range(4)]
    check(spark, HARD + [(c + 7000, *r) for c, *r in random_rows(250, 1)] + chain + comb + copies)


def test_rebuilt_families(spark):
    check(spark, HARD + [(c + 100, t, r, x) for c, t, r, x in random_rows(60, 7, 4)], by_family=True)


def test_two_fattest(spark):
    from pyspark.sql import functions as F

    got = spark.range(64).selectExpr("cast(id as int) a").crossJoin(spark.range(1, 65).selectExpr("cast(id as int) b")).where("a < b")
    for r in got.select("a", "b", T.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(df).collect() == [] and T.trie(T.rebuilt(df)).collect() == []


def test_query_against_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet')")
    got = T.op12_prefix_trie(spark, path)
    want = con.execute(T.OP12_SQL)
    assert [c[0] for c in want.description] == got.columns
    got = got.collect()
    same(got, want.fetchall())
    same(got, brute(rebuild(lists(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))))
