"""Groups of texts that share word runs, the split that keeps them together, and the stream of early stops."""

import math
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from qlift.operators import grouping as GR
from qlift.operators import runlogs as RL
from qlift.operators import tables as TB
from qlift.session import Stored, scratch_path
from qlift.streaming import jobs as ST


def _runs(text, n):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def _components(texts, n, common):
    count = Counter(r for t in texts.values() for r in _runs(t, n))
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for k in sorted(texts):
        for r in _runs(texts[k], n):
            if 1 < count[r] <= common * len(texts):
                a, b = find(first.setdefault(r, k)), find(k)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}


def _texts():
    rng = random.Random(4)
    word = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(rng.choices(word, k=rng.randrange(3, 30))) for i in range(300)}
    texts |= {300 + i: " ".join(f"c{j}" for j in range(i, i + 9)) for i in range(60)}  # a chain: each shares a run with the next only
    texts |= {400 + i: "this licence line stands in very many texts " + texts[i] for i in range(40)}  # copies with a common line
    return texts | {500: None, 501: "", 502: "short", 503: "SHORT ", 504: "short text"}


def test_groups_against_plain_components(spark):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    for n, common in ((8, 0.02), (3, 0.5)):
        want = _components(texts, n, common)
        got = {r.k: r.group_id for r in GR.grouped_split(df, "k", "text", n, common).collect()}
        assert got == want


def test_split_keeps_groups_whole_and_leaks_nothing(spark):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    out = GR.grouped_split(df, "k", "text", max_group=0.05)
    rows = out.collect()
    assert len(rows) == len(texts) and out.columns == ["k", "text", "group_id", "split"]
    by_group = {}
    for r in rows:
        by_group.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    sizes = Counter(r.group_id for r in rows)
    assert {r.split for r in rows if sizes[r.group_id] > 0.05 * len(texts)} == {"train"}
    report = {r.split: r for r in GR.leak_report(out, "k", "text").collect()}
    assert all(r.leaking == 0 and r.max_containment == 0 for r in report.values()) and set(report) == {"val", "test"}
    plain = {r.split: r for r in GR.leak_report(TB.split_assign(df, "k"), "k", "text").collect()}
    assert sum(r.leaking for r in plain.values()) > 5


def test_split_sizes(spark):
    """Groups of 1 to 4 rows: an eighth, a tenth and a tenth within three standard deviations of the stated bound."""
    texts = [(i, f"group {i // 1000} {(i * i) % 997 if i % 3 else i - i % 3} " + " ".join(f"x{i // (1 + i % 4)}q{j}" for j in range(9))) for i in range(8000)]
    df = spark.createDataFrame(texts, "k long, text string")
    n = Counter(r.split for r in GR.grouped_split(df, "k", "text").collect())
    for part in ("val", "test"):
        assert abs(n[part] / 8000 - 0.1) < 3 * math.sqrt(0.1 * 0.005)
    assert sum(n.values()) == 8000


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert GR.grouped_split(df, "k", "text").collect() == []
    one = GR.grouped_split(spark.createDataFrame([(7, None)], "k long, text string"), "k", "text").collect()
    assert [(r.k, r.group_id, r.split) for r in one] == [(7, 7, "train")]


def test_stream_early_stop_across_restarts(spark):
    losses = [("a", e, v) for e, v in enumerate([5.0, 4.0, 4.0, 4.5, 4.1, 3.0, 3.5, 3.5, 3.0])] + [("b", e, 9.0 - e) for e in range(9)]
    losses += [("c", 2, 1.0), ("c", 5, 2.0), ("c", 9, 2.0), ("c", 11, 2.0)]
    df = spark.createDataFrame(losses, "run string, epoch long, loss double")
    for patience in (1, 3):
        src, out, ck = (scratch_path(spark, f"j4-{x}") for x in "soc")
        want = {r.run: r.stop_epoch for r in RL.early_stop(df.withColumnRenamed("loss", "mean_loss"), patience, "run").collect()}
        for low, high in ((0, 3), (3, 4), (4, 100)):
            df.where(f"epoch >= {low} AND epoch < {high}").write.mode("append").parquet(src)
            got = ST.stream_early_stop(spark, src, out, ck, patience)
        assert {r.run: r.stop_epoch for r in got.collect()} == want


def test_late_and_repeated_epochs_change_nothing(spark):
    src, out, ck = (scratch_path(spark, f"j4l-{x}") for x in "soc")
    parts = [[("a", 1, 5.0), ("a", 1, 4.0), ("a", 0, 6.0)], [("a", 1, 0.1), ("a", 0, 0.1), ("a", 2, 4.5), ("b", None, 1.0), ("c", 4, None)], [("a", 3, 4.2), ("a", 3, 4.1)]]
    for p in parts:
        spark.createDataFrame(p, "run string, epoch long, loss double").write.mode("append").parquet(src)
        got = {r.run: r.stop_epoch for r in ST.stream_early_stop(spark, src, out, ck, 2).collect()}
    assert got == {"a": 3, "b": None, "c": None}


def test_the_state_function_alone():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    s = State()
    step = ST._watch(2)
    frames = [pd.DataFrame({"run": "r", "epoch": [1, 2], "loss": [3.0, 3.0]}), pd.DataFrame({"run": "r", "epoch": [3], "loss": [3.5]})]
    rows = pd.concat(step(("r",), iter(frames), s))
    assert rows["stop_epoch"].tolist() == [pd.NA, 3] and s.get == (3, 3.0, 2, 3)


def test_runs_of_long_and_odd_texts(spark):
    """Runs against plain Python; a text of 60,000 words that repeats itself is cut in time linear in its length."""
    texts = {1: " ".join(f"w{(i * i) % 20011}" for i in range(60_000)), 2: None, 3: "", 4: " \t ", 5: "One\x1ctwo THREE", 6: "one two three", 7: "a " * 30, 8: "É é\x00 x"}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    got = {r.node: r.runs for r in GR.run_counts(df, "k", "text").collect()}
    assert got == {k: len(_runs(t, 8)) for k, t in texts.items()}
    rows = [(r.node, bytes(r.block)) for r in GR.word_runs(df, "k", "text").collect()]
    assert len(rows) == len(set(rows)) == sum(got.values())
    assert len({b for _, b in rows}) == len(set().union(*[_runs(t, 8) for t in texts.values()]))


def test_blocks_are_cut_once(spark):
    """One pass over the texts and one exchange of the runs, also where the split and both reports need them."""
    df = spark.createDataFrame(list(_texts().items()), "k long, text string")
    held = GR.blocks(df, "k", "text")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    split = GR.grouped_split(df, "k", "text", held=held)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, GR.grouped_split(df, "k", "text").collect()), key=str)
    assert GR.leak_report(TB.split_assign(df, "k"), "k", "text", held=held).collect() == GR.leak_report(TB.split_assign(df, "k"), "k", "text").collect()


def test_blocks_against_plain_sets(spark, monkeypatch):
    """Blocks, weights, heads and counts against plain Python, in many ranges; also of text keys, null keys and rows that come twice."""
    rows = [*_texts().items()] + [(None, "n0 n1 n2 n3"), (None, "n0 n1 n2 n4"), (11, _texts()[11]), (600, _texts()[11])]
    monkeypatch.setattr(GR, "RANGE", 256)
    for kind in ("long", "string"):
        data = [(k if k is None or kind == "long" else f"k{k:04d}", t) for k, t in rows]
        members = {}
        for k, t in data:
            for r in _runs(t, 3):
                members.setdefault(r, []).append(k)
        sets = Counter(tuple(sorted(m, key=str)) for m in members.values() if 1 < len(m) <= 0.1 * len(data))
        want = Counter()
        for m, n in sets.items():
            for k in set(m):
                want[(k, min((x for x in m if x is not None), default=None), n * m.count(k))] += 1
        got = GR.shared_runs(spark.createDataFrame(data, f"k {kind}, text string"), "k", "text", 3, 0.1).collect()
        assert Counter((r.node, r.head, r.weight) for r in got if r.block is not None) == want
        assert len({r.block for r in got if r.block is not None}) == len(sets)
        assert Counter((r.node, r.weight) for r in got if r.block is None) == Counter((k, len(_runs(t, 3))) for k, t in data)


def test_copies_share_one_block_and_reports_cut_no_text(spark):
    """A passage that two rows share is one block; with the counts at hand a report reads no text, and says the same."""
    df = spark.createDataFrame([(i, " ".join(f"w{i % 50}x{j}" for j in range(60))) for i in range(200)], "k long, text string")
    shared = Stored(spark, "shared").put(GR.shared_runs(df, "k", "text"))
    held, runs = shared.where("block IS NOT NULL"), shared.where("block IS NULL").select("node", F.col("weight").alias("runs"))
    per_block = Counter(bytes(r.block) for r in held.select("block").collect())
    assert held.agg(F.sum("weight")).first()[0] == 200 * 53 and len(per_block) <= 50 * 1.01 and set(per_block.values()) == {4}
    split = TB.split_assign(df.select("k"), "k")
    quick = GR.leak_report(split, "k", "text", held=held, runs=runs)
    assert "MapInArrow" not in quick._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(quick.collect()) == sorted(GR.leak_report(TB.split_assign(df, "k"), "k", "text").collect())
