"""The pipeline against a plain version of its stages on a small table."""

import re
from collections import defaultdict

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as P
from qlift.llm import langid, mixing, simhash

SF = "/root/testdata/sf0.001"
MASKS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "source_mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, None, "s", None), (900_002, "123 ...", None, "s", 7), (900_003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    known = corpus_pipeline.language(spark, docs, SF)
    assert known.columns == docs.columns
    names, scores = langid.judge([r.text for r in docs.collect()], langid.learn(docs))
    want = sorted(r.doc_id for r, n, s in zip(docs.collect(), names, scores) if n != "und" and (s > 0 or len(r.text) < 20))
    assert sorted(r.doc_id for r in known.collect()) == want and not {900_001, 900_002, 900_003} & set(want)

    single = corpus_pipeline.near_duplicates(spark, known, SF)
    rows = {r.doc_id: simhash.fingerprint(r.text) for r in known.collect()}
    ids = sorted(rows)
    label = {i: i for i in ids}
    for a in ids:  # ids rise, so a document takes the label of the first it reaches; repeat until nothing moves
        for b in ids:
            if bin((rows[a] ^ rows[b]) & (1 << 64) - 1).count("1") <= 3:
                low, high = sorted((label[a], label[b]))
                for k in ids:
                    label[k] = low if label[k] == high else label[k]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(label.values()))

    clean = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, single, SF).collect()}
    for r in single.collect():
        left = clean[r.doc_id]
        for kind, pattern in MASKS:
            assert not re.search(pattern, left.text) and left.text.count(f"[{kind.upper()}]") >= len(re.findall(pattern, r.text))
        if not re.search(r"[0-9@]", r.text):
            assert left.text == r.text and left.n_chars == r.n_chars

    frame = spark.createDataFrame(list(clean.values()), docs.schema)
    mixed = corpus_pipeline.source_mix(spark, frame, SF).collect()
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id] += 1
    expected = {r.row.doc_id: r.copies for r in mixing.mixed(frame).collect() if r.copies}
    assert copies == expected and max(copies.values()) <= 3

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in corpus_pipeline.tokens(spark, frame, SF).collect():
        ids = lib.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids"] and out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    words = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert out.select("doc_id").distinct().count() <= words


def test_stages_on_odd_tables(spark):
    """An empty table, only null ids, repeated rows and ties, extra columns with names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, fp string, ids string, spans int"
    text = "the of and to in a is that for it as was with be by on not he i this are or his from at"
    same = (None, f"{text} mail bob@example.org", "en", "s", None, "r", 1, "f", "x", 2)
    rows = [same, same, (None, None, None, None, None, None, None, None, None, None), (None, "", "en", None, 0, "r", 1, "f", "x", 2),
            *[(None, f"{text} {i} word{i} and more of the {i * i}", "en", "s", None, None, None, None, None, None) for i in range(12)]]
    tie = [(7, f"{text} and one", "en", "t", 1, "b", 1, "f", "x", 2), (7, f"{text} and one", "en", "t", 1, "a", 1, "f", "x", 2)]
    for table in ([], rows, rows + tie):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert sorted(out.columns) == sorted(docs.columns), name
            docs = spark.createDataFrame(out.select(*docs.columns).collect(), schema)
            if name == "near_duplicates":
                assert docs.where("text like '%bob@%'").count() <= 1 and docs.where("doc_id = 7").count() <= 1
                again = stage(spark, spark.createDataFrame(list(reversed(table)), schema), SF) if table else docs
                assert sorted(map(str, again.select(*docs.columns).where("doc_id = 7").collect())) == sorted(map(str, docs.where("doc_id = 7").collect())) if len(table) > 20 else True
            if name == "personal_data" and table:
                assert docs.where("text like '%bob@%'").count() == 0
        out = corpus_pipeline.tokens(spark, docs, SF)
        assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids"] and out.count() == docs.count()
        assert (out.count() > 0) == bool(table)


def test_run_leaves_one_table(spark):
    import os

    from qlift.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:") + "/qlift-scratch"
    before = {d for d in os.listdir(base) if d.startswith("pipeline-")} if os.path.isdir(base) else set()
    out = corpus_pipeline.run(spark, SF)
    assert len({d for d in os.listdir(base) if d.startswith("pipeline-")} - before) == 1 and out.count() > 0
