"""Segmented scans and follow-up chains against plain windows; weighted relatedness."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from qlift.operators import conversations as CV
from qlift.operators import relatedness as RW
from qlift.operators.scans import segmented_scan


def test_equals_a_plain_window(spark):
    # one group holds more than a third of all rows and one segment spans many ranges
    rows = [(0, t, t in (0, 7, 8, 1500), t % 5, f"r{t}" if t % 3 else None) for t in range(3000)]
    rows += [(g, t, t % g == 0, None if t % 4 == 0 else t, "x") for g in range(1, 60) for t in range(40)]
    df = spark.createDataFrame(rows, "g long, t long, s boolean, v long, name string")
    for n in (1, 8, 40):
        got = segmented_scan(df, ["g", "t"], F.col("s"), sums={"total": F.col("v")}, firsts={"head": F.col("name")}, num_partitions=n)
        w = Window.orderBy("g", "t")
        ref = df.withColumn("i", F.row_number().over(w) - 1).withColumn("seg_first", F.max(F.when(F.col("s"), F.col("i"))).over(w).cast("bigint"))
        seg = Window.partitionBy("seg_first").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ref = ref.select("g", "t", "s", "v", "name", "seg_first", (F.col("i") - F.col("seg_first")).alias("seg_pos"),
                         F.coalesce(F.sum("v").over(seg), F.lit(0)).alias("total"), F.first("name").over(seg).alias("head"))
        assert got.exceptAll(ref).count() == 0 and got.count() == len(rows)


def test_no_start_and_no_rows(spark):
    df = spark.range(10).withColumn("s", F.lit(None).cast("boolean"))
    assert {(r.seg_first, r.seg_pos) for r in segmented_scan(df, ["id"], F.col("s")).collect()} == {(0, i) for i in range(10)}
    assert segmented_scan(df.limit(0), ["id"], F.col("s")).collect() == []


def test_hot_group_spreads_over_the_ranges(spark):
    df = spark.range(8000).selectExpr("0L AS g", "id AS t")
    got = segmented_scan(df, ["g", "t"], F.col("t") == 0, num_partitions=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan
    assert got.where("seg_first = 0 AND seg_pos = t").count() == 8000


def _queries(spark, texts):
    return spark.createDataFrame([(c, t, c * 100 + t, x) for c, said in enumerate(texts) for t, x in enumerate(said)], "conv_id long, turn long, query_id long, query string")


def test_a_common_word_alone_never_relates(spark):
    texts = [["the cat", "the dog", "the"], ["the", "the"], ["the rare fish", "a rare fish the"], [None, "", "the rare"]] + [[f"the word{i}"] for i in range(40)]
    q = _queries(spark, texts)
    got = {r.query_id: r for r in RW.weighted_relatedness(CV.followup_pairs(q), RW.query_vectors(q, RW.word_weights(q))).collect()}
    assert not got[1].related and not got[2].related and not got[101].related and got[201].related
    assert got[101].cosine is None and got[1].cosine == 0.0 and not got[301].related


def test_weights_look_up_rare_words_by_shuffle(spark, monkeypatch):
    from qlift.operators import tokens as TK

    q = _queries(spark, [[f"w{i} w{i + 1} x{i % 3}", f"w{i} z w{i + 1}"] for i in range(30)])
    pairs, weights = CV.followup_pairs(q), RW.word_weights(q)
    want = sorted(map(tuple, RW.weighted_relatedness(pairs, RW.query_vectors(q, weights)).collect()))
    monkeypatch.setattr(TK, "HEAD", 3)
    assert sorted(map(tuple, RW.weighted_relatedness(pairs, RW.query_vectors(q, weights)).collect())) == want
    assert sum(w[4] for w in want) == 30


def test_chains_and_the_draft_that_covers_them(spark):
    q = _queries(spark, [["red fox", "red fox jumps", "blue sea", "blue sea deep"], ["green"], []] + [[f"filler{i}"] for i in range(40)])
    chains = RW.chains_of(q)
    got = {r.query_id: (r.chain_id, r.chain_pos) for r in chains.where("conv_id < 2").collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 3: (2, 1), 100: (100, 0)}
    drafts = spark.createDataFrame([(0, 1, 1, "nothing"), (0, 2, 2, "red fox jumps"), (0, 1, 2, "red fox jumps high"), (2, 1, 1, "sea")],
                                   "query_id long, model_id long, level long, draft string")
    rep = {r.chain_id: (r.first_turn, r.length, r.covered_level, r.covered_model) for r in RW.chain_report(chains, drafts).where("conv_id < 2").collect()}
    assert rep == {0: (0, 2, 2, 1), 2: (2, 2, None, None), 100: (0, 1, None, None)}
