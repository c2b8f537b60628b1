"""Inference invariants, strict reading, run logs, edit distance, streaming restarts."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from qlift.fixtures import Tables
from qlift.operators import inference as INF
from qlift.operators import judging as J
from qlift.operators import runlogs as RL
from qlift.session import scratch_path
from qlift.plans.standins import enhancer_factory
from qlift.sources import files
from qlift.streaming import jobs as ST

SF = "/root/testdata/sf0.001"


def test_generate_independent_of_batch_size(spark):
    q = Tables(spark, SF).fx_queries
    outs = [{r.query_id: r.enhanced_query for r in INF.generate(q, enhancer_factory, batch_size=b).collect()} for b in (1, 7, 64)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == q.count()


def test_generate_requires_one_output_per_input(spark):
    q = Tables(spark, SF).fx_queries

    def _bad_model(tag=None):  # local: shipped to workers by value
        return lambda batch: batch[:-1]

    with pytest.raises(Exception, match="came back"):
        INF.generate(q, factory=_bad_model, batch_size=4).collect()


def test_factories_of_one_closure_are_two_models(spark):
    q = Tables(spark, SF).fx_queries.limit(20).coalesce(1)

    def make(word):
        return lambda tag=None: lambda batch: [word] * len(batch)

    for word in ("first", "second", "first"):
        assert {r.enhanced_query for r in INF.generate(q, make(word)).collect()} == {word}


def test_impossible_date_and_plain_loss(spark):
    lines = [(1, "13/45/2024 10:00:00 AM [INFO] epoch : 3 - average_val_loss : 2.5"), (2, "no level here"), (3, "02/03/2024 01:02:03 PM [WARN] x")]
    p = RL.parse_log(spark.createDataFrame(lines, "event_id long, line string"))
    got = {r.event_id: r for r in p.collect()}
    assert got[1].ts is None and got[2].msg is None and got[2].level is None and str(got[3].ts) == "2024-02-03 13:02:03"
    assert RL.epoch_losses(p).first().mean_loss == 2.5


def test_strict_json(spark):
    from qlift.functions import text as TX

    rows = [('{"a":"x"}', "x"), (' {"a":"x"} ', "x"), ('{"a":"x"} see note', None), ('{"a":"x"}{"a":"y"}', None), ('{"a":"x"},{"a":"y"}', None),
            ('{"a":5}', None), ('{"a":null}', None), ('[{"a":"x"}]', None), ('{"a":"x', None), ('```{"a":"x"}```', None), ('{"a":"x"}] y', None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", TX.json_field("t", "a").alias("v")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(rows)}


def test_nothing_stays_cached(spark):
    from qlift.plans.registry import load_all

    for k in ("a04_row_range", "c03_decode", "g01_followup_pairs"):
        load_all()[k].fn(spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_read_queries_strict_and_permissive(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"query_id": 1, "query": "ok"}) + "\n{not json\n" + json.dumps({"query_id": 2}) + "\n")
    with pytest.raises(Exception, match="InvalidRecords"):
        files.read_queries(spark, d, strict=True).collect()
    good, bad = files.read_queries(spark, d, strict=False)
    assert [r.query for r in good.collect()] == ["ok"] and bad.count() == 2


def test_early_stop_cases(spark):
    def stop(losses, patience):
        df = spark.createDataFrame([("val", i, float(v)) for i, v in enumerate(losses)], "split string, epoch long, mean_loss double")
        return RL.early_stop(df, patience).first().stop_epoch

    assert stop([5, 4, 3, 2, 1], 2) is None          # never reached
    assert stop([5, 4, 4, 4], 2) == 3                # plateau of equal losses is no improvement
    assert stop([3, 1, 2, 2, 0.5, 1, 1, 1], 3) == 7  # reached at the end


def py_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_edit_distance_brute_force(spark):
    t = Tables(spark, SF)
    got = J.edit_distance(t.fx_drafts, t.fx_finals).collect()
    src = {(r.query_id, r.model_id, r.level): r for r in t.fx_drafts.join(t.fx_finals, ["query_id", "model_id", "level"]).collect()}
    for r in got:
        s = src[(r.query_id, r.model_id, r.level)]
        dw, fw = s.draft.split(" "), s.final_query.split(" ")
        assert r.levenshtein == py_lev(s.draft, s.final_query)
        assert r.words_added == len(set(fw) - set(dw)) and r.words_removed == len(set(dw) - set(fw))


def test_stream_enhance_restart_is_exactly_once(spark):
    q = Tables(spark, SF).fx_queries
    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    q.filter("query_id % 2 = 0").write.json(src + "/part1")
    first = ST.stream_enhance(spark, src + "/*", out, ck, enhancer_factory).count()
    q.filter("query_id % 2 = 1").write.json(src + "/part2")
    res = ST.stream_enhance(spark, src + "/*", out, ck, enhancer_factory)
    assert first < q.count()
    assert res.count() == q.count() and res.select("query_id").distinct().count() == q.count()


def test_stream_pending_drops_late_redelivery(spark):
    schema = "event_id long, ts timestamp_ntz"
    src, out, ck = scratch_path(spark, "p-src"), scratch_path(spark, "p-out"), scratch_path(spark, "p-ck")
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    batch1 = [(1, base), (2, base + dt.timedelta(hours=5))]
    spark.createDataFrame(batch1, schema).write.parquet(src + "/b1")
    from pyspark.sql import types as T
    sch = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    ST.stream_pending(spark, src + "/*", out, ck, sch)
    # id 1 re-delivered long after the watermark passed it: dropped as late; id 2 inside: deduplicated
    spark.createDataFrame([(1, base), (2, base + dt.timedelta(hours=5)), (3, base + dt.timedelta(hours=6))], schema) \
        .write.parquet(src + "/b2")
    res = ST.stream_pending(spark, src + "/*", out, ck, sch)
    assert sorted(r.event_id for r in res.collect()) == [1, 2, 3]


def test_sharded_generation_equals_unsharded(spark):
    q = Tables(spark, SF).fx_queries
    one = {r.query_id: r.enhanced_query for r in INF.generate(q.coalesce(1), enhancer_factory, batch_size=16).collect()}
    many = {r.query_id: r.enhanced_query for r in INF.generate(q.repartition(7), enhancer_factory, batch_size=16).collect()}
    assert one == many


def test_sweep_skips_finished_pairs(spark):
    q = Tables(spark, SF).fx_queries
    done = q.limit(5).select(F.lit("c1").alias("checkpoint"), "query_id")
    out = INF.sweep(q, ["c1", "c2"], done, enhancer_factory)
    n = q.count()
    assert out.count() == 2 * n - 5
    assert out.filter("checkpoint = 'c2'").first().enhanced_query.endswith("[c2]")


def test_stream_log_levels_drops_late_lines(spark):
    src, out, ck = scratch_path(spark, "l-src"), scratch_path(spark, "l-out"), scratch_path(spark, "l-ck")

    def line(h, m, level):
        ampm, hh = ("AM", h if h else 12) if h < 12 else ("PM", h - 12 if h > 12 else 12)
        return f"01/02/2024 {hh:02d}:{m:02d}:00 {ampm} [{level}] epoch : 1 - average_val_loss : 10"

    first = [line(0, 5, "INFO"), line(0, 40, "INFO"), line(2, 0, "WARN"), line(5, 30, "INFO")]
    spark.createDataFrame([(x,) for x in first], "value string").coalesce(1).write.text(src + "/b1")
    ST.stream_log_levels(spark, src + "/*", out, ck)
    # watermark is now 04:30: a line for 00:10 is late and dropped; a line for 05:10 still counts
    late = [line(0, 10, "INFO"), line(5, 10, "INFO"), line(9, 0, "INFO")]
    spark.createDataFrame([(x,) for x in late], "value string").coalesce(1).write.text(src + "/b2")
    res = ST.stream_log_levels(spark, src + "/*", out, ck)
    got = {(str(r.window_start), r.level): r.n for r in res.collect()}
    assert got[("2024-01-02 00:00:00", "INFO")] == 2          # the late 00:10 line was dropped
    assert got[("2024-01-02 02:00:00", "WARN")] == 1
    assert got[("2024-01-02 05:00:00", "INFO")] == 2          # closed by the 09:00 line, includes 05:10
    assert ("2024-01-02 09:00:00", "INFO") not in got          # still open (watermark 08:00)


def test_write_jsonl_keeps_non_ascii(spark):
    q = Tables(spark, SF).fx_queries
    path = files.write_jsonl(q, scratch_path(spark, "w-json"))
    raw = spark.read.text(path)
    assert raw.filter(F.col("value").rlike("[^\\x00-\\x7f]")).count() > 0      # accents written as UTF-8
    assert raw.filter(F.col("value").contains("\\u00")).count() == 0           # not as \\u escapes
    assert files.read_queries(spark, path).count() == q.count()


def _echo():
    return lambda tag: lambda batch: [None if t is None else t.upper() for t in batch]


def test_one_partial_batch_a_partition(spark):
    """Arrow batches of 10 rows, model batches of 12: the rows of a partition are carried over, and come back in order."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        q = spark.range(1000).selectExpr("id AS query_id", "repeat(concat('w', id, ' '), cast(id * 7 % 23 as int)) AS query").repartition(3, "query_id")
        sizes = [r.n for r in q.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        for window in (1, 2, 64):
            stats = INF.BatchStats(spark)
            got = INF.generate(q, _echo(), batch_size=12, profile="gpt2", window=window, stats=stats).collect()
            assert {r.query_id: r.enhanced_query for r in got} == {r.query_id: r.query.upper() for r in got} and len(got) == 1000
            n = stats.report()
            assert n["calls"] == sum(-(-s // 12) for s in sizes) and n["partial"] == sum(s % 12 > 0 for s in sizes) and n["texts"] == 1000
            assert n["padded"] <= n["padded_in_order"] and (window < 64 or n["padded"] < n["padded_in_order"] / 5)
        respond = INF.BatchStats(spark)
        out = INF.respond(q.withColumnRenamed("query", "draft"), _echo(), batch_size=12, stats=respond)
        assert out.count() == 1000 and respond.report()["partial"] <= len(sizes)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rows_keep_their_order_and_windows_stay_bounded():
    import pandas as pd

    frames = [pd.DataFrame({"i": range(a, a + n), "t": ["x" * ((a + k) * 5 % 7) for k in range(n)]}) for a, n in ((0, 3), (3, 0), (3, 50), (53, 1))]
    seen = []

    def model(batch):
        seen.append(len(batch))
        return [f"{t}!" for t in batch]

    parts = list(INF.in_batches(iter(frames), lambda tag: model, "t", "out", 4, window=3))
    got = pd.concat(parts)
    assert got["i"].tolist() == list(range(54)) and (got["out"] == got["t"] + "!").all()
    assert max(map(len, parts)) == 12 and sorted(seen) == [2] + [4] * 13


def test_sweep_spreads_by_counted_rows_and_batches_by_checkpoint(spark):
    q = spark.range(400).selectExpr("id AS query_id", "concat('q', id) AS query")
    done = spark.createDataFrame([("c1", 3)], "checkpoint string, query_id long")
    stats = INF.BatchStats(spark)
    out = INF.sweep(q, ["c1", "c2"], done, enhancer_factory, batch_size=16, rows_per_task=50, stats=stats)
    assert out.rdd.getNumPartitions() == 16
    rows = out.collect()
    assert len(rows) == 799 and all(r.enhanced_query.endswith(f"[{r.checkpoint}]") for r in rows)
    groups = out.groupBy(F.spark_partition_id().alias("p"), "checkpoint").count().collect()
    assert stats.report()["partial"] <= 3 * len(groups)  # the stats counted each of the three runs above


def test_chat_budget(spark):
    """Below, at and over the budget; a cut inside a message, between two, and inside the generation prompt."""
    from qlift.functions import templates as TP
    from qlift.operators import tokens as TK

    chat = [("user", "One two three"), ("assistant", "four  five"), ("user", "SIX")]
    rows = [(b, chat) for b in range(-1, 14)] + [(100, None), (101, []), (102, [("user", None)]), (3, chat)]
    df = spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(rows)], "chat_id long, budget long, m array<struct<role:string,content:string>>")
    words = "one two three<|end|> four five<|end|> <|user|> <|assistant|>".split()  # "six<|end|>" is unknown
    vocab = TK.build_vocab(spark.createDataFrame([(" ".join(words),)], "t string"), "t")
    got = {r.chat_id: r for r in TK.chat_budget(df, "m", F.col("budget"), vocab, ["chat_id"]).collect()}
    text = "<|user|>\nOne two three<|end|>\n<|assistant|>\nfour  five<|end|>\n<|user|>\nSIX<|end|>\n<|assistant|>\n"
    tokens = text.lower().split()
    sizes = [4, 3, 2, 1]
    assert len(got) == len(rows) and len(tokens) == 10
    for i, (b, m) in enumerate(rows):
        r = got[i]
        if m != chat:
            assert (r.text, r.trimmed_text, r.is_trimmed) == (TK_EMPTY[i - 15], TK_EMPTY[i - 15], False)
            continue
        keep = max(0, min(b, 10))
        whole = max(n for n in range(5) if sum(sizes[4 - n:]) <= keep)
        cut = keep - sum(sizes[4 - whole:])
        assert (r.text, r.n_tokens, r.n_kept, r.whole, r.cut, r.cut_kept) == (text, 10, keep, whole, 3 - whole if cut else None, cut)
        assert r.is_trimmed == (b < 10)
        assert r.trimmed_text == (text if b >= 10 else " ".join(t for t in tokens[10 - keep:] if t in words))


TK_EMPTY = ["<|assistant|>\n", "<|assistant|>\n", "<|user|>\n<|end|>\n<|assistant|>\n"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_word_edits(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    texts = [("a a b", "a b"), ("", "x"), ("x", ""), (None, None), ("a b c d", "d c b a"), ("one two three", "three one two"), (" a  b ", "a b")]
    texts += [tuple(" ".join(rng.choices("abcdefgh", k=rng.randrange(n))) for _ in range(2)) for n in (5, 70, 130, 200) for _ in range(6)]
    texts += [(" ".join(map(str, range(400))), " ".join(map(str, range(200, 600)))), ("w " * 130, "w " * 124)]
    d = spark.createDataFrame([(i, 0, 0, a) for i, (a, _) in enumerate(texts)], "query_id long, model_id long, level long, draft string")
    f = spark.createDataFrame([(i, 0, 0, b) for i, (_, b) in enumerate(texts)], "query_id long, model_id long, level long, final_query string")
    got = {r.query_id: r for r in J.word_edits(d, f).collect()}
    for i, (a, b) in enumerate(texts):
        a, b = ([w for w in (x or "").split(" ") if w] for x in (a, b))
        kept, shared = _lcs(a, b), sum((Counter(a) & Counter(b)).values())
        r = got[i]
        assert (r.kept, r.moved, r.added, r.removed) == (kept, shared - kept, len(b) - shared, len(a) - shared), (i, a, b)


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = [r.w for r in spark.range(65536).select(J.poisson_weight(F.lpad(F.hex("id"), 4, "0")).alias("w")).collect()]
    mean = sum(w) / len(w)
    assert abs(mean - 1) < 1e-3 and abs(sum((x - mean) ** 2 for x in w) / len(w) - 1) < 2e-3 and max(w) == 8


def test_bootstrap_interval_holds_the_uplift(spark):
    rows = [(q, m, lv, "Overall score", 1 + (q * 7 + m * 3 + lv * q) % 4) for q in range(300) for m in (1, 2) for lv in (0, 1, 2)]
    rows += [(q, 3, 1, "Overall score", 2) for q in range(5)]  # no level 0: no uplift
    rows += [(0, 1, 1, "Clarity", 4), (1, 1, 1, "Overall score", None)]
    scored = spark.createDataFrame(rows, "query_id long, model_id long, level long, criterion string, score int")
    got = {(r.model_id, r.level): r for r in J.bootstrap_uplift(scored).collect()}
    assert set(got) == {(m, lv) for m in (1, 2) for lv in (1, 2)} | {(3, 1)}
    assert got[3, 1].uplift is None and got[3, 1].low is None
    for k in set(got) - {(3, 1)}:
        r = got[k]
        assert r.n_replicates == 200 and r.low <= r.uplift <= r.high and abs(r.boot_mean - r.uplift) < 0.05 and 0 < r.high - r.low < 0.4
    again = {(r.model_id, r.level): r for r in J.bootstrap_uplift(scored.repartition(5)).collect()}
    assert again == got


def test_model_rating(spark):
    import math

    def wins(level, games):
        return [(level, a, b, w, t, lo) for (a, b), (w, t, lo) in games.items()]

    rows = wins(1, {(1, 2): (30, 0, 10), (1, 3): (20, 10, 10), (2, 3): (15, 0, 25)})
    rows += wins(2, {(1, 2): (10, 0, 0), (1, 3): (4, 0, 0), (2, 3): (6, 2, 4)})  # 1 never lost
    rows += wins(3, {(1, 2): (5, 0, 5), (3, 4): (9, 0, 3)})  # two groups that never met
    rows += wins(4, {(1, 2): (3, 0, 0)})
    got = {(r.level, r.model_id): r for r in J.model_rating(spark.createDataFrame(rows, "level long, model_a long, model_b long, wins long, ties long, losses long")).collect()}
    r = [1.0, 1.0, 1.0]
    points, games = [30 + 25, 10 + 15, 15 + 25], [[0, 40, 40], [40, 0, 40], [40, 40, 0]]
    for _ in range(5000):
        r = [points[i] / sum(games[i][j] / (r[i] + r[j]) for j in range(3) if j != i) for i in range(3)]
        r = [x * 3 / sum(r) for x in r]
    assert [got[1, m].rating for m in (1, 2, 3)] == pytest.approx(r, abs=2e-6) and {got[1, m].component for m in (1, 2, 3)} == {1}
    assert [got[2, m].component for m in (1, 2, 3)] == [1, 2, 2] and got[2, 1].rating == 1.0
    assert got[2, 2].rating / got[2, 3].rating == pytest.approx(7 / 5, abs=1e-5)
    assert [got[3, m].component for m in (1, 2, 3, 4)] == [1, 1, 3, 3] and got[3, 1].rating == got[3, 2].rating == 1.0
    assert got[3, 3].rating == pytest.approx(1.5, abs=1e-5) and [got[4, m].component for m in (1, 2)] == [1, 2]
    assert got[4, 1].rating == got[4, 2].rating == 1.0 and math.isclose(got[4, 1].points, 3.0)
