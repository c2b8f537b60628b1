"""dense_index, shards, token arrays, padding, labels."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from qlift.functions import arrays as AR
from qlift.operators import sharding
from qlift.operators import tokens as TK
from qlift.operators.ordering import dense_index
from qlift.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    got = dense_index(df, ["k", "id"], "idx")
    ref = df.withColumn("idx", F.row_number().over(Window.orderBy("k", "id")) - 1)
    assert got.select("k", "id", "idx").exceptAll(ref.select("k", "id", "idx")).count() == 0
    assert got.count() == 5000


def test_dense_index_moves_keys_only(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("k"), "id", F.repeat(F.lit("x"), 50).alias("payload"))
    out = dense_index(df, ["-k", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    ref = df.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("k"), "id")) - 1)
    assert out.exceptAll(ref.select(out.columns)).count() == 0 and out.count() == 1000


def test_merge_of_buckets_is_identity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assigned, plan = sharding.contiguous_buckets(docs, "doc_id", 7)
    parts = [assigned.filter(F.col("worker") == w) for w in range(7)]
    merged = sharding.merge_shards(parts)
    ref = dense_index(docs, "doc_id", "merged_idx")
    assert merged.select("merged_idx", "doc_id").exceptAll(ref.select("merged_idx", "doc_id")).count() == 0
    rows = {r.worker: r.n_rows for r in plan.collect()}
    assert sum(rows.values()) == docs.count() and all(v >= 0 for v in rows.values())


def test_overprovisioned_workers_are_empty(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    _, plan = sharding.contiguous_buckets(df, "k", 5)
    assert [(r.worker, r.n_rows) for r in plan.orderBy("worker").collect()] == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)]


def test_array_edges(spark):
    df = spark.createDataFrame([([],), ([1, 2, 3],), ([1, 2, 3, 4, 5],)], "a array<bigint>")
    head = [r[0] for r in df.select(AR.truncate_ids("a", 3, "head")).collect()]
    tail = [r[0] for r in df.select(AR.truncate_ids("a", 3, "tail")).collect()]
    assert head == [[], [1, 2, 3], [1, 2, 3]] and tail == [[], [1, 2, 3], [3, 4, 5]]
    right = [r[0] for r in df.select(AR.pad_ids("a", 4, 0, "right")).collect()]
    left = [r[0] for r in df.select(AR.pad_ids("a", 4, 0, "left")).collect()]
    assert right == [[0, 0, 0, 0], [1, 2, 3, 0], [1, 2, 3, 4, 5]]
    assert left == [[0, 0, 0, 0], [0, 1, 2, 3], [1, 2, 3, 4, 5]]
    mask = [r[0] for r in df.select(AR.attention_mask("a", 4, "left")).collect()]
    assert mask == [[0, 0, 0, 0], [0, 1, 1, 1], [1, 1, 1, 1, 1]]


def test_mask_labels(spark):
    df = spark.createDataFrame([([10, 11], [20, 21, 22])], "p array<bigint>, t array<bigint>")
    r = df.select(TK.mask_labels("p", "t", 6).alias("e")).first().e
    assert r.input_ids == [10, 11, 20, 21, 22, TK.EOS_ID]
    assert r.labels == [-100, -100, 20, 21, 22, TK.EOS_ID]
    assert r.attention_mask == [1] * 6
    r = df.select(TK.mask_labels("p", "t", 9).alias("e")).first().e
    assert r.input_ids == [TK.BOS_ID, 10, 11, 20, 21, 22, TK.EOS_ID, TK.PAD_ID, TK.PAD_ID]
    assert r.labels == [TK.BOS_ID, -100, -100, 20, 21, 22, TK.EOS_ID, -100, -100]
    assert r.attention_mask == [1] * 7 + [0, 0]


def test_encode_decode_roundtrip_and_join_paths(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Hello  world hello", "a"), (2, "", "b"), (3, "unseen words here world", None), (4, None, "d")], "k long, text string, more string")
    vocab = TK.build_vocab(df.filter("k = 1"), "text")
    want = None
    for head in (10_000, 5, 6):  # all tokens broadcast, all joined by shuffle, both
        monkeypatch.setattr(TK, "HEAD", head)
        a = TK.encode(df, "text", vocab, keys=["k"])
        ids = {r.k: (r.ids, r.more) for r in a.collect()}
        assert want is None or ids == want
        want = ids
        assert ids[2] == ([], "b") and ids[4] == ([], "d") and ids[3][0][:3] == [TK.UNK_ID] * 3
        back = {r.k: r.text for r in TK.decode(a.drop("text"), "ids", vocab, keys=["k"]).collect()}
        assert back[1] == "hello world hello" and back[2] == ""


def test_pad_batch(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [4, 5, 6])], "k long, ids array<bigint>")
    b = TK.assign_batches(df, "k", 2)
    p = {r.k: (r.batch_id, r.ids, r.attention_mask) for r in TK.pad_batch(b, "ids").collect()}
    assert p == {0: (0, [1, 2], [1, 1]), 1: (0, [3, TK.PAD_ID], [1, 0]), 2: (1, [4, 5, 6], [1, 1, 1])}


def test_vocab_paths_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    full = {r.token: r.id for r in TK.build_vocab(docs, "text", None).collect()}          
    capped = {r.token: r.id for r in TK.build_vocab(docs, "text", 300).collect()}        
    assert len(capped) == 300 and all(full[t] == i for t, i in capped.items())
    assert sorted(full.values()) == list(range(len(full)))


def test_dense_index_refuses_ties(spark):
    from qlift.operators.ordering import DuplicateKeys

    df = spark.range(6).select((F.col("id") % 2).alias("k"), "id")
    with pytest.raises(DuplicateKeys):
        dense_index(df, "k")
    assert dense_index(df, ["k", "id"]).count() == 6
    keys = dense_index(df.select("k"), "k", "i")  # nothing to join back: equal rows are interchangeable
    assert sorted((r.i, r.k) for r in keys.collect()) == [(i, int(i > 2)) for i in range(6)]
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, v long")
    with pytest.raises(DuplicateKeys):
        dense_index(nulls, "k")


def test_tokens_are_cut_once_and_not_sorted(spark):
    """The vocabulary cuts its words in the explode alone, and the look-up sorts no items (one row a token)."""
    df = spark.createDataFrame([(1, "B a b"), (2, ""), (3, None), (4, "a zz Ä")], "k long, text string")
    counts = TK.build_vocab(df, "text")
    assert {(r.token, r.n) for r in counts.where("n IS NOT NULL").collect()} == {("a", 2), ("b", 2), ("zz", 1), ("ä", 1)}
    vocab = spark.createDataFrame([("a", 5, 2), ("b", 6, 2), ("zz", TK.HEAD + 7, 1)], "token string, id long, n long")
    enc = TK.encode(df, "text", vocab, keys=["k"])
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert {r.k: list(r.ids) for r in enc.collect()} == {1: [6, 5, 6], 2: [], 3: [], 4: [5, TK.HEAD + 7, TK.UNK_ID]}


def test_encode_sends_each_word_of_a_part_once(spark, monkeypatch):
    """Parts of a few texts, a head of a few words: ids against plain Python, also of rows that share a key (or have none); no row per token."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=i % 40))) for i in range(120)] + [(5, "W1 w1 w0 new"), (None, "w3 w2"), (None, "w1"), (7, None)]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("more", F.col("k") * 2)
    monkeypatch.setattr(TK, "HEAD", 12)
    monkeypatch.setattr(TK, "PART", 64)
    vocab = TK.build_vocab(df.where("k < 60"), "text")
    ids = {r.token: r.id for r in vocab.collect()}
    placed = {}
    for k, t in rows:
        placed.setdefault(k, []).extend((i, ids.get(w, TK.UNK_ID)) for i, w in enumerate((t or "").lower().split()))
    want = {k: [v for _, v in sorted(p)] for k, p in placed.items()}
    enc = TK.encode(df, "text", vocab, keys=["k"])
    assert enc.columns == ["k", "text", "more", "ids"] and "Generate" not in enc._jdf.queryExecution().optimizedPlan().toString()
    got = enc.collect()
    assert len(got) == len(want) and {r.k: r.ids for r in got} == want and all(r.more == (r.k and r.k * 2) or r.k == 0 for r in got)
    beside = spark.createDataFrame([(5, "a"), (5, "b"), (7, "c"), (None, "d"), (999, "e")], "k int, tag string")
    both = TK.encode(df, "text", vocab, keys=["k"], carry=[], beside=beside)
    assert both.columns == ["k", "ids", "tag"] and sorted((r.k, r.tag) for r in both.collect()) == [(5, "a"), (5, "b"), (7, "c")]
    assert all(r.ids == want[r.k] for r in both.collect())


def test_padding_exchanges_no_ids(spark):
    """The batches' longest rows are known before the texts are encoded; after that nothing is exchanged."""
    df = spark.createDataFrame([(0, [1, 2], 0, 3), (1, [3], 0, 3)], "k long, ids array<bigint>, batch_id long, longest int")
    assert {r.k: (r.ids, r.attention_mask) for r in TK.pad_batch(df, "ids", longest="longest", side="left").collect()} == {
        0: ([TK.PAD_ID, 1, 2], [0, 1, 1]), 1: ([TK.PAD_ID, TK.PAD_ID, 3], [0, 0, 1])}
    plan = load_all()["c07_pad_batch"].fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange")
